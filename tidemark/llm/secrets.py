"""Secret scanning with an incremental blob ledger (DataFrame operations only)."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir, table, until_exit


class Rule(NamedTuple):
    """A kind of secret: matches of `pattern` (which never matches nothing) whose `group` has `least` characters or more.

    hint, if given, is a cheaper pattern that a text must contain for the rule to have a match there.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hint: str | None = None


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"[:=]"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA"),
    # A run of the class is one match of the plain pattern; runs that are too short needn't be matched to be dropped.
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
)
#: Known token formats and keys; they add spans to those of BASE.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, r"PRIVATE KEY"),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, 1, r"gh[pousr]_"),
    Rule("slack", r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}", 0, 1, r"xox[abeoprs]-"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", 0, 1, r"eyJ"),
    Rule("url", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/:@]+@", 0, 1, r"://[^\s/:@]+:"),
)
RULES = BASE + MORE
#: Parts in which the paths of a common blob are joined to its findings.
SALTS = 64


def rules_version(rules: Sequence[Rule]) -> str:
    return hashlib.sha256(repr(tuple(rules)).encode()).hexdigest()[:16]


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """array of struct(start, order, end, kind), in code points, of a rule's leftmost non-overlapping matches.

    Spark gives the matches and, by splitting, the pieces between them; their lengths add up to the positions.
    """
    whole, part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    pieces = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole))
    found = F.zip_with(F.zip_with(pieces, whole, lambda p, w: F.struct(F.length(p).alias("gap"), F.length(w).alias("size"))), part, lambda m, g: F.struct(m["gap"].alias("gap"), m["size"].alias("size"), F.length(g).alias("group")))
    span = "struct<start:int,order:int,end:int,kind:string>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def step(s: Column, m: Column) -> Column:
        begin, end = s["at"] + m["gap"], s["at"] + m["gap"] + m["size"]
        one = F.array(F.struct(begin.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(m["group"] >= rule.least, F.concat(s["spans"], one)).otherwise(s["spans"]).alias("spans"))

    spans = F.aggregate(found, start, step, lambda s: s["spans"])
    return spans if rule.hint is None else F.when(text.rlike(rule.hint), spans).otherwise(F.array().cast(f"array<{span}>"))


def all_spans(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The spans of all rules by start, then in the order of the rules."""
    return F.array_sort(F.concat(*[rule_spans(text, rule, n) for n, rule in enumerate(rules)]))


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def render(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_versions(versions: DataFrame, path: str, text: str, rules: Sequence[Rule] = RULES, ledger: str | None = None) -> DataFrame:
    """One row per row of versions: path, blob, spans (array of struct(start, order, end, kind)).

    A blob is a text's SHA-256. The ledger, a Parquet folder by version of the rules, holds the spans of every blob scanned
    so far, of those without any too. Only blobs that it lacks for this version are scanned, once each however many paths
    hold them, and added; then findings are joined back to all paths. Without a ledger, a new one is begun in the shared
    folder. A null text is the empty blob; null paths and repeated rows are kept.

    A ledger in which several writers scanned the same blob gives its findings once; a rerun finds nothing unseen.

    What moves: addresses, and the texts once, dealt by blob and path so that a blob with many copies is no hot key. Blobs that
    more than one in a thousand paths hold, of which there can't be more than a thousand, meet their findings in SALTS parts.
    """
    spark = versions.sparkSession
    version, ledger = rules_version(rules), ledger or until_exit(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    content = versions.select(F.col(path).alias("path"), body.alias("body"), F.sha2(body, 256).alias("blob"))
    addresses = materialise(content.select("path", "blob"), "addresses")
    one = addresses.groupBy("blob").agg(F.min("path").alias("path"))
    where = f"{ledger}/rules={version}"
    try:
        one = one.join(spark.read.parquet(where).select("blob"), "blob", "left_anti")
    except AnalysisException:  # nothing is scanned yet by these rules
        pass
    same = (content["blob"] == one["blob"]) & content["path"].eqNullSafe(one["path"])
    unseen = content.join(one.hint("shuffle_hash"), same, "left_semi")
    found = unseen.select("blob", all_spans(F.col("body"), rules).alias("spans"))
    found.groupBy("blob").agg(F.max("spans").alias("spans")).write.mode("append").parquet(where)
    findings = spark.read.parquet(where)
    hits = findings.filter(F.size("spans") > 0).groupBy("blob").agg(F.max("spans").alias("spans"))
    common = addresses.groupBy("blob").count().filter(F.col("count") * 1000 > max(addresses.count(), 1000)).select("blob", F.lit(True).alias("common"))
    common = F.broadcast(common)
    part = F.when(F.col("common"), F.pmod(F.xxhash64("path"), F.lit(SALTS))).otherwise(0).cast("int")
    parts = F.when(F.col("common"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = addresses.join(common, "blob", "left").select("path", "blob", part.alias("part"))
    right = hits.join(common, "blob", "left").select("blob", "spans", F.explode(parts).alias("part"))
    nothing = F.array().cast(findings.schema["spans"].dataType)
    return left.join(right, ["blob", "part"], "left").select("path", "blob", F.coalesce("spans", nothing).alias("spans"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_versions(table(spark, sf_dir, "documents"), "doc_id", "text")
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    counts = [F.size(F.filter("spans", of_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return scanned.select(F.col("path").alias("doc_id"), *counts, F.sha2(render(base), 256).alias("base_sha256"), render(F.col("spans")).alias("spans"))


def _sql_matches() -> str:
    """A SELECT for each rule: matches, their groups and the pieces between. SQL's patterns have no look-behind, so a run of hex
    digits is matched whole and dropped if it is short."""
    one = "SELECT row, {n} AS rule, '{kind}' AS kind, {least} AS least, regexp_extract_all(text, '{p}') AS whole, regexp_extract_all(text, '{p}', {group}) AS part, regexp_split_to_array(text, '{p}') AS pieces FROM texts"
    plain = [(r, r"[0-9a-f]+" if r.kind == "hex" else r.pattern) for r in RULES]
    return "\n  UNION ALL ".join(one.format(n=n, kind=r.kind, least=r.least, group=r.group, p=p.replace("'", "''")) for n, (r, p) in enumerate(plain))


ORACLE = rf"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
matched AS (
  {_sql_matches()}),
placed AS (
  SELECT row, rule, kind, least, unnest(range(1, len(whole) + 1)) AS i, whole, part, pieces FROM matched),
spans AS (
  SELECT row, rule, kind, list_sum(list_transform(pieces[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda m: length(m))), 0) AS start,
         length(whole[i]) AS size FROM placed WHERE length(part[i]) >= least),
listed AS (
  SELECT row, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, rule) FILTER (WHERE rule < {len(BASE)}) AS base,
         string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, rule) AS spans
  FROM spans GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN listed USING (row)
"""
