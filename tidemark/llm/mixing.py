"""Mixing sources to target weights by Pareto order sampling (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, small, stable_bits, table

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BUCKETS = 1024
#: Words are runs of anything but blanks and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Add `target` to rows (source_key, source_size): the shares of the whole by weight, none above max_copies times its size.

    Sorted by cap per weight, the sources that stop at their cap come first. The level (words per unit of weight) that the
    others share is the largest of the levels found by capping each prefix. The table has a row per source.
    """
    by_key, everything = Window.orderBy("source_key"), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = Window.orderBy(F.col("cap") / F.col("weight"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_key) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_copies).select("*", F.sum("source_size").over(everything).alias("all_size"), F.sum("weight").over(everything).alias("all_weight"))
    level = (F.col("all_size") - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
    levels = ranked.withColumn("level", level.cast("double")).withColumn("level", F.max("level").over(everything))
    return levels.select("source_key", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def class_plan(classes: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """Add whole, p, rest and level_odds to rows (source_key, wish, words, source_size, target): documents of a source that wish
    alike, and their words.

    A document expects copies in proportion to its wish, max_copies at most, and a source's expected words are its target. As
    with sources, the classes that stop at max_copies are those that wish most, and the factor is the largest of those found by
    capping each prefix. floor(copies) are whole, the rest is the inclusion probability p; `rest` are the words that a source's
    target leaves after whole copies, and level_odds the odds at which its documents would be included were they all alike. The
    table has a row per source and wish, of which there are as many as a size has bits.
    """
    wishing = Window.partitionBy("source_key").orderBy(F.desc("wish"))
    before, after, all_ = wishing.rowsBetween(Window.unboundedPreceding, -1), wishing.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy("source_key")
    capped, wished = F.coalesce(F.sum("words").over(before), F.lit(0)), F.sum(F.col("wish") * F.col("words")).over(after)
    factor = F.when(wished > 0, (F.col("target") - (capped * max_copies).cast("double")) / wished.cast("double"))
    out = classes.withColumn("factor", factor).withColumn("factor", F.coalesce(F.max("factor").over(all_), F.lit(0.0)))
    copies = F.when(F.col("factor") * F.col("wish") >= max_copies - 1e-9, float(max_copies)).otherwise(F.greatest(F.col("factor") * F.col("wish"), F.lit(0.0)))
    out = out.withColumn("copies", copies).withColumn("whole", F.floor("copies")).withColumn("p", F.col("copies") - F.col("whole"))
    rest = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(all_)
    part = rest / F.sum(F.when(F.col("p") > 0, F.col("words"))).over(all_)
    odds = F.when((part > 0) & (part < 1), part / (1 - part)).otherwise(1.0)
    return out.select("source_key", "wish", "source_size", "target", "whole", "p", rest.alias("rest"), odds.alias("level_odds"))


def mix_plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = "mix", odds: str | None = None) -> DataFrame:
    """How often each document goes into the mix. One row per unit, a set of n rows alike in key, source, size and text hash:
    key, source, source_key, size, text_hash, n, source_size, target, whole, extra. Each of the n rows is taken `whole`
    times, and `extra` of them once more.

    A document wishes for copies by its length: as much as its size plus one has binary digits, so that long texts come in
    more often than scraps (see class_plan). The whole copies are certain, and the rest is its inclusion probability p.
    Documents are ranked by u/(1-u) divided by p/(1-p) (times the column `odds`, if one is named, for preferring documents
    within a source; null counts as 1), u being a hash of the seed and the key. The first ones whose words fit the rest of the
    target are taken, then the one document left whose size fills the gap best.

    Ranks are summed up within 1,024 ranges of the rank and then over ranges, so that a hot source is no single task, and
    equal rows are one until the end. A null text has size 0; a null source is a source of its own, ordered last; documents
    without words are taken like others but add nothing; null keys share one random number; texts may be of any length.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    wanted = F.lit(1.0) if odds is None else F.coalesce(F.col(odds).cast("double"), F.lit(1.0))
    rows = docs.select(
        F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(body).alias("text_hash"), wanted.alias("odds")
    )
    units = rows.groupBy("key", "source", "size", "text_hash", "odds").agg(F.count("*").alias("n"))
    units = units.withColumn("source_key", F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source")))
    u = (stable_bits(F.col("key"), 13, seed) + F.lit(0.5)) / F.lit(float(16**13))
    units = materialise(units.withColumns({"u": u, "wish": F.length(F.bin(F.col("size") + 1)).cast("long")}), "mix-units")
    words = F.col("size") * F.col("n")
    classes = materialise(units.groupBy("source_key", "wish").agg(F.sum(words).alias("words")), "mix-classes")
    targets = source_targets(classes.groupBy("source_key").agg(F.sum("words").alias("source_size")), weights, max_copies)
    plan = small(materialise(class_plan(classes.join(targets, "source_key"), max_copies), "mix-plan"))

    chance = units.join(plan, ["source_key", "wish"]).withColumn("pareto", F.when(F.col("p") > 0, F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p"))) / F.col("odds")))
    # Times the odds of the source as a whole, which leaves its order as it is, ranks fall evenly on the ranges.
    level = F.col("pareto") * F.col("level_odds")
    ranged = chance.withColumn("range", F.floor(F.coalesce(level / (1 + level), F.col("u")) * BUCKETS).cast("int"))
    before = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counted = F.when(F.col("p") > 0, words).otherwise(0)
    sums = ranged.groupBy("source_key", "range").agg(F.sum(counted).alias("words"))
    starts = sums.select("source_key", "range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source_key", "range").orderBy("pareto", "key", "size", "text_hash", "odds").rowsBetween(Window.unboundedPreceding, -1)
    ordered = ranged.withColumn("first", F.coalesce(F.sum(counted).over(inside), F.lit(0))).join(starts, ["source_key", "range"])
    room = F.col("rest") - F.col("start") - F.col("first")
    fits = F.when(F.col("size") == 0, F.when(room > 0, F.col("n")).otherwise(0)).otherwise(F.greatest(F.lit(0), F.least(F.col("n"), F.floor(room / F.col("size")))))
    extra = F.when((F.col("rest") > 0) & (F.col("p") > 0), fits).otherwise(0)
    taken = materialise(ordered.withColumn("extra", extra).drop("range", "start", "first", "u", "wish", "level_odds"), "mix-taken")

    gaps = small(materialise(taken.groupBy("source_key").agg((F.max("rest") - F.sum(F.col("size") * F.col("extra"))).alias("gap")), "mix-gaps"))
    left = taken.filter("extra < n and size > 0 and rest > 0 and p > 0").join(gaps, "source_key").filter("size < 2 * gap")
    best = F.struct(F.abs(F.col("size") - F.col("gap")).alias("d"), "pareto", "key", "size", "text_hash", "odds")
    closing = small(materialise(left.groupBy("source_key").agg(F.min(best).alias("closing")), "mix-closing"))
    same = F.col("key").eqNullSafe(F.col("closing.key")) & F.col("pareto").eqNullSafe(F.col("closing.pareto"))
    for c in ("size", "text_hash", "odds"):
        same = same & (F.col(c) == F.col(f"closing.{c}"))
    out = taken.join(closing, "source_key", "left").withColumn("extra", F.col("extra") + F.when(F.coalesce(same, F.lit(False)), 1).otherwise(0))
    return out.select("key", "source", "source_key", "size", "text_hash", "n", "source_size", "target", "whole", "extra")


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, copies, taken (copies times size). See mix_plan."""
    rows = mix_plan(docs, **options).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copies = (F.col("whole") + F.when(F.col("nth") <= F.col("extra"), 1).otherwise(0)).cast("long")
    return rows.select(F.col("key").alias("doc_id"), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of docs with their own columns, each as often as it is taken. See mix_plan.

    Where only some of the rows of a unit are taken once more, which happens to two units of a source at most, they are the
    first by a hash of all their columns. Rows that are alike in everything are counted there before they are shuffled, and
    numbers are given within 1,024 ranges of the hash, so that a document that is a third of all rows is no single task.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    unit = {"_mix_key": F.col(key), "_mix_source": F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string"))), "_mix_text": F.xxhash64(body)}
    marked = docs.withColumns(unit)
    plan = mix_plan(docs, key, text, source, **options).groupBy("key", "source_key", "text_hash")
    plan = materialise(plan.agg(F.max("whole").alias("_mix_whole"), F.sum("extra").alias("_mix_extra"), F.sum("n").alias("_mix_n")), "mix-units")

    def met(units: DataFrame) -> DataFrame:
        return marked.join(units, marked["_mix_key"].eqNullSafe(units["key"]) & (marked["_mix_source"] == units["source_key"]) & (marked["_mix_text"] == units["text_hash"]))

    every = F.when(F.col("_mix_extra") == F.col("_mix_n"), 1).otherwise(0)
    chosen = met(plan).withColumn("_mix_copies", (F.col("_mix_whole") + every).cast("int")).filter("_mix_copies > 0")
    out = chosen.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*[marked[c] for c in docs.columns])
    some = materialise(plan.filter("_mix_extra > 0 and _mix_extra < _mix_n"), "mix-some")
    if some.isEmpty():
        return out
    rows = met(small(some)).select(F.xxhash64("key", "source_key", "text_hash").alias("unit"), "_mix_extra", F.struct(*[marked[c] for c in docs.columns]).alias("row"))
    rows = rows.withColumn("hash", F.xxhash64(F.to_json("row"))).groupBy("unit", "hash").agg(F.count("*").alias("n"), F.max("_mix_extra").alias("extra"), F.any_value("row").alias("row"))
    rows = rows.withColumn("range", F.shiftrightunsigned("hash", 54))
    before = Window.partitionBy("unit").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("unit", "range").agg(F.sum("n").alias("n")).select("unit", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("unit", "range").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, ["unit", "range"])
    more = F.least(F.col("n"), F.col("extra") - F.col("start") - F.col("first"))
    again = placed.withColumn("more", more).filter("more > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("more"))))
    return out.unionByName(again.select("row.*"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents")).drop("copies")


ORACLE = r"""
WITH rows AS (
  SELECT *, length(bin(size + 1))::BIGINT AS wish, row_number() OVER () AS row FROM (
    SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS source_key,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           (('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
    FROM documents)),
sized AS (SELECT source_key, sum(size)::BIGINT AS source_size FROM rows GROUP BY 1),
ranked AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source_key) - 1) % 3 + 1)::INT] AS weight, source_size * 3 AS cap,
         sum(source_size) OVER () AS all_size FROM sized),
leveled AS (
  SELECT *, (all_size - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
          / (sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM ranked WINDOW w AS (ORDER BY cap::DOUBLE / weight::DOUBLE, source_key)),
targets AS (
  SELECT source_key, source_size, least(cap::DOUBLE, (max(level) OVER ()) * weight) AS target FROM leveled),
classes AS (SELECT source_key, wish, sum(size)::BIGINT AS words FROM rows GROUP BY 1, 2),
factors AS (
  SELECT *, CASE WHEN wished > 0 THEN (target - (3 * capped)::DOUBLE) / wished::DOUBLE END AS factor FROM (
    SELECT c.*, source_size, target, coalesce(sum(words) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
           sum(wish * words) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wished
    FROM classes c JOIN targets USING (source_key) WINDOW w AS (PARTITION BY source_key ORDER BY wish DESC))),
expected AS (
  SELECT *, CASE WHEN f * wish >= 3 - 1e-9 THEN 3.0::DOUBLE ELSE greatest(f * wish, 0.0::DOUBLE) END AS copies
  FROM (SELECT *, coalesce(max(factor) OVER (PARTITION BY source_key), 0.0::DOUBLE) AS f FROM factors)),
plan AS (
  SELECT source_key, wish, source_size, target, floor(copies)::BIGINT AS whole, copies - floor(copies) AS p,
         target - (sum(floor(copies)::BIGINT * words) OVER (PARTITION BY source_key))::DOUBLE AS rest FROM expected),
odds AS (
  SELECT r.*, source_size, target, whole, p, rest, CASE WHEN p > 0 THEN u / (1 - u) / (p / (1 - p)) END AS pareto
  FROM rows r JOIN plan USING (source_key, wish)),
placed AS (
  SELECT *, CASE WHEN p > 0 THEN coalesce(sum(size) OVER (PARTITION BY source_key, p > 0 ORDER BY pareto, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS first FROM odds),
chosen AS (
  SELECT *, CASE WHEN rest <= 0 OR p <= 0 THEN 0 WHEN size = 0 THEN (rest - first > 0)::INT ELSE (first + size <= rest)::INT END AS extra FROM placed),
gaps AS (SELECT source_key, max(rest) - sum(size * extra) AS gap FROM chosen GROUP BY 1),
closing AS (
  SELECT row FROM chosen JOIN gaps USING (source_key)
  WHERE extra = 0 AND size > 0 AND rest > 0 AND p > 0 AND size < 2 * gap
  QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY abs(size - gap), pareto, doc_id) = 1)
SELECT c.doc_id, c.size::BIGINT AS size, c.source_size, c.target,
       ((c.whole + c.extra + (x.row IS NOT NULL)::INT) * c.size)::BIGINT AS taken
FROM chosen c LEFT JOIN closing x ON x.row = c.row
"""
