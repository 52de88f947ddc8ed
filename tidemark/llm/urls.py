"""URL filtering by rules and by empirical-Bayes host reputation (DataFrame operations only)."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, small, table

#: (verdict, host, path): holds for the host and its subdomains where the url's path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Public suffixes of more than one label; all others have one.
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "github.io", "gov.uk", "org.uk")
#: A host is blocked if its bad rate lies above the rate of all labelled pages by Z standard deviations of its posterior: it is
#: then worse than the average, not by chance. So a third of all pages can't be blocked for what pages are like everywhere.
Z = 1.0
#: Prior strengths, in pages, for levels whose spread can't be estimated, and their range.
DEFAULT_STRENGTH, STRENGTHS = 10.0, (1.0, 1000.0)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first `://`, A-Z lower-cased, and the path after it; both empty if there is none or url is null."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    raw = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(raw) + 1, F.length(after)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    fits = []
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        here = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        fits.append(F.when(here, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _last_labels(host: Column, n: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.array_join(F.slice(labels, -F.least(n, F.size(labels)), F.least(n, F.size(labels))), ".")


def domain_and_suffix(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain (suffix and one label more) and public suffix; an IPv4 address is its own domain without suffix."""
    parts = F.when(_last_labels(host, F.lit(2)).isin(*long_suffixes), 2).otherwise(1)
    address = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    return F.when(address, host).otherwise(_last_labels(host, parts + 1)), F.when(address, F.lit("")).otherwise(_last_labels(host, parts))


def prior_strength(k: int, total: int, y: int, spread: float, squares: int) -> float:
    """Beta prior strength of a level of k groups with total outcomes, y bad, spread = sum of bad^2/n and squares = sum of n^2,
    by the moments of a beta-binomial: 1/r - 1 for the intraclass correlation r. Groups that differ no more than chance would
    make them give the largest strength."""
    mean = y / total if total else 0.0
    free = (total - squares / total - (k - 1)) if total else 0.0
    if k < 2 or free <= 0 or not 0 < mean < 1:
        return DEFAULT_STRENGTH
    r = (spread - mean * mean * total - (k - 1) * mean * (1 - mean)) / (mean * (1 - mean) * free)
    return round(min(max(1 / r - 1, STRENGTHS[0]), STRENGTHS[1]), 6) if r > 0 else STRENGTHS[1]


def host_reputation(hosts: DataFrame) -> DataFrame:
    """host_labelled, bad_rate, bad_bound and worse for rows (host, n, bad): pages with a labelled outcome and bad ones among
    them, 0 and 0 allowed.

    A suffix is shrunk towards the rate of all pages, a registered domain towards its suffix, and a host towards its domain;
    bad_bound is the lower bound of the host's beta posterior (mean less Z standard deviations), worse whether it lies above the
    rate of all pages. hosts is a written table, summed up; one aggregate over it gives the three strengths.
    """
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    levels = [df.filter("n > 0").select(F.lit(level).alias("level"), F.col("n").cast("double").alias("n"), F.col("bad").cast("double").alias("bad")) for level, df in enumerate((hosts, domains, suffixes))]
    n, bad = F.col("n"), F.col("bad")
    moments = levels[0].union(levels[1]).union(levels[2]).groupBy("level").agg(F.count("*"), F.sum(n), F.sum(bad), F.sum(bad * bad / n), F.sum(n * n)).collect()
    told = {row[0]: row[1:] for row in moments}
    by_host, by_domain, by_suffix = (prior_strength(*told.get(level, (0, 0, 0, 0.0, 0))) for level in range(3))
    total, y = told[0][1:3] if told else (0, 0)
    overall = (y + 1) / (total + 2)
    suffixes = suffixes.select("suffix", ((F.col("bad") + by_suffix * overall) / (F.col("n") + by_suffix)).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", ((F.col("bad") + by_domain * F.col("suffix_rate")) / (F.col("n") + by_domain)).alias("domain_rate"))
    rate = (F.col("bad") + by_host * F.col("domain_rate")) / (F.col("n") + by_host)
    out = hosts.join(domains, ["domain", "suffix"]).withColumn("bad_rate", rate)
    deviation = F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.col("n") + by_host + 1))
    out = out.select("host", F.col("n").alias("host_labelled"), F.round("bad_rate", 6).alias("bad_rate"), F.round(F.col("bad_rate") - Z * deviation, 6).alias("bad_bound"))
    return out.withColumn("worse", F.col("bad_bound") > round(overall, 6))


def judge_urls(pages: DataFrame, outcomes: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, host_labelled, bad_rate, bad_bound.

    outcomes has (key, bad): labelled pages; a page labelled more than once is bad if any label says so, and null keys or
    outcomes teach nothing. The longest fitting rule gives the verdict; without one, `block` if the host's bad_bound lies above
    the rate of all labelled pages, else `allow`. A null or malformed url has host and path '' and is judged as that host;
    repeated pages are each judged and each counted; urls may be of any length; other columns are ignored, whatever their
    names; empty tables give no rows, and no outcomes an even prior.

    Outcomes are summed up by host and written before anything else is joined; a hot host is one row there, and its pages are
    sent the hosts' rates while those are few, else dealt by size when Spark splits the skewed side of the last join.
    """
    host, path = host_and_path(F.col(url).cast("string"))
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    known = outcomes.select(F.col(key).alias("page_id"), F.col("bad").cast("int").alias("bad")).dropna().groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = rows.select("page_id", "host").join(known, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    rates = small(materialise(host_reputation(materialise(hosts, "hosts")), "host-rates"))
    match = matching_rule(F.col("host"), F.col("path"), rules)
    judged = rows.join(rates, "host").withColumn("match", match)
    verdict = F.coalesce("match.verdict", F.when(F.col("worse"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("match.rule").alias("rule"), verdict.alias("verdict"), "host_labelled", "bad_rate", "bad_bound")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the labels under the page's number: bad if of low quality or toxic."""
    labels = table(spark, sf_dir, "labels").filter("quality is not null or toxic is not null")
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    return judge_urls(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


_STRENGTH = """(SELECT CASE WHEN k < 2 OR total - squares / total - (k - 1) <= 0 OR y <= 0 OR y >= total THEN 10.0
  WHEN spread - y / total * y - (k - 1) * (y / total) * (1 - y / total) <= 0 THEN 1000.0
  ELSE round(least(greatest(1 / ((spread - y / total * y - (k - 1) * (y / total) * (1 - y / total))
    / ((y / total) * (1 - y / total) * (total - squares / total - (k - 1)))) - 1, 1.0), 1000.0), 6) END
  FROM (SELECT count(*) AS k, sum(n)::DOUBLE AS total, sum(bad)::DOUBLE AS y, sum(bad::DOUBLE * bad / n) AS spread, sum(n::DOUBLE * n) AS squares FROM {} WHERE n > 0))"""

ORACLE = rf"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
hosted AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut),
rows AS (
  SELECT page_id, coalesce(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM hosted),
known AS (
  SELECT doc_id AS page_id, max((coalesce(quality = 0, false) OR coalesce(toxic = 1, false))::INT) AS bad
  FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY 1),
labelled AS (SELECT host, count(*) AS n, sum(bad) AS bad FROM rows JOIN known USING (page_id) GROUP BY 1),
hosts AS (
  SELECT h.host, coalesce(n, 0)::BIGINT AS n, coalesce(bad, 0)::BIGINT AS bad, string_split(h.host, '.') AS parts,
         regexp_matches(h.host, '^\d{{1,3}}(\.\d{{1,3}}){{3}}$') AS address,
         CASE WHEN array_to_string(string_split(h.host, '.')[-2:], '.') IN {LONG_SUFFIXES} THEN 2 ELSE 1 END AS w
  FROM (SELECT DISTINCT host FROM rows) h LEFT JOIN labelled USING (host)),
named AS (
  SELECT host, n, bad, CASE WHEN address THEN host ELSE array_to_string(parts[-(w + 1):], '.') END AS domain,
         CASE WHEN address THEN '' ELSE array_to_string(parts[-w:], '.') END AS suffix FROM hosts),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY 1),
priors AS (
  SELECT (SELECT (sum(bad) + 1)::DOUBLE / (sum(n) + 2)::DOUBLE FROM suffixes) AS overall, {_STRENGTH.format("suffixes")}::DOUBLE AS ks,
         {_STRENGTH.format("domains")}::DOUBLE AS kd, {_STRENGTH.format("named")}::DOUBLE AS kh),
suffix_rates AS (SELECT suffix, (bad + ks * overall) / (n + ks) AS suffix_rate FROM suffixes, priors),
domain_rates AS (SELECT domain, suffix, (bad + kd * suffix_rate) / (n + kd) AS domain_rate FROM domains JOIN suffix_rates USING (suffix), priors),
host_rates AS (SELECT host, n, n + kh + 1 AS free, overall, (bad + kh * domain_rate) / (n + kh) AS rate FROM named JOIN domain_rates USING (domain, suffix), priors),
ruled AS (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM rows)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN round(rate - {Z} * sqrt(rate * (1 - rate) / free), 6) > round(overall, 6) THEN 'block' ELSE 'allow' END AS verdict,
       n AS host_labelled, round(rate, 6) AS bad_rate, round(rate - {Z} * sqrt(rate * (1 - rate) / free), 6) AS bad_bound
FROM ruled JOIN host_rates USING (host)
"""
