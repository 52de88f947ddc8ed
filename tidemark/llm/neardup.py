"""Near-duplicate documents: DartMinHash signatures of weighted shingles, banded joining, exact verification, classes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, small, table
from .graph import components, merged
from .shingles import batch_shingles, mix, weighted_elements

SIMILARITY = 0.8
#: Bands of ROWS coordinates. Texts of similarity 0.8 share none of the bands with probability (1 - 0.8^4)^20 = 3e-5.
BANDS, ROWS = 20, 4
#: Bytes of the sketch that second comparisons are chosen by, and the part that must agree: of similarity 0.8 one in 5,000 pairs
#: has fewer. Most pairs are told apart by the first bytes alone; there, one in 10,000 pairs has fewer.
SKETCH, AGREE, FIRST, FIRST_AGREE = 1024, 0.756, 256, 0.705
#: Members of a bucket that are compared with each other at a time, and choices of a text in the rounds before the last.
BLOCK, CHOICES, ROUNDS_OF_CHOICES = 1024, 2, 1
_STEP, _REGION = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
#: A bucket of more than one text in so many is joined by broadcast, so that no task gets it whole. There can't be more of them than
#: HOT times BANDS.
HOT = 1000


def dart_minhash(elements: np.ndarray, k: int = BANDS * ROWS, weights: np.ndarray | None = None) -> np.ndarray:
    """k coordinates for a weighted set (distinct 64-bit elements; weights above 0, or 1 each), equal with the weighted Jaccard
    similarity each.

    Above every element lies a plane of weight by rank, cut along the weight into [0, 1), [1, 2), [2, 4), [4, 8) and so on.
    Darts hit each of these regions as a Poisson process along the rank axis, placed by hashes of the element, the region and
    the dart's number, so that an element gets the same darts in all sets; those below its weight in the set count. A dart
    belongs to one of the k coordinates at random, and the earliest dart of each is the signature. Only darts below a rank
    are thrown: k (ln k + 3) of them count in expectation however heavy the set, and an element of weight w has log w regions;
    the rank is doubled in the 5% of cases where a coordinate stays empty.
    """
    weights = np.ones(len(elements)) if weights is None else np.asarray(weights, np.float64)
    limit = k * (math.log(k) + 3) / weights.sum()
    regions = [(elements, weights, 0.0, 1.0)]
    for n in range(1, math.ceil(math.log2(max(weights.max(), 1.0))) + 1):
        heavy = weights > 2.0 ** (n - 1)
        regions.append((mix(elements[heavy] + np.uint64(n * int(_REGION) % 2**64)), weights[heavy], 2.0 ** (n - 1), 2.0 ** (n - 1)))
    while True:
        thrown = [_throw(*region, limit) for region in regions]
        darts, ranks = (np.concatenate(x) for x in zip(*thrown, strict=True))
        coordinate = mix(darts ^ np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(k)
        order = np.argsort(-ranks)  # of darts written to one place the last stays, which is the earliest
        signature, filled = np.zeros(k, np.uint64), np.zeros(k, bool)
        signature[coordinate[order]], filled[coordinate] = darts[order], True
        if filled.all():
            return signature
        limit *= 2


def _throw(strips: np.ndarray, weights: np.ndarray, low: float, width: float, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """The darts, and their ranks, that hit a region [low, low + width) of each strip's weight before the limit and below its weight."""
    near = np.flatnonzero(_gap(mix(strips + _STEP)) < limit * width)
    expected = limit * width
    n = int(expected + 3 * math.sqrt(expected)) + 3
    while True:
        darts = mix(strips[near][:, None] + np.arange(1, n + 1, dtype=np.uint64) * _STEP)
        ranks = np.cumsum(_gap(darts), axis=1) / width
        if not len(near) or ranks[:, -1].min() >= limit:
            break
        n *= 2
    hit = ranks < limit
    if (weights[near] < low + width).any():
        at = low + width * ((mix(darts ^ _REGION) >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        hit &= at < weights[near][:, None]
    return darts[hit], ranks[hit]


def _gap(h: np.ndarray) -> np.ndarray:
    """Exponential gaps from hashes."""
    return -np.log(((h >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53)


def band_keys(signature: np.ndarray) -> np.ndarray:
    bands = signature.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP
    for r in range(ROWS):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + bands[:, r])
    return key.view(np.int64)


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys = []
        for shingles in batch_shingles(batch["text"]):
            elements, counts = np.unique(shingles, return_counts=True)
            keys.append(band_keys(dart_minhash(elements, weights=counts)) if len(elements) else None)
        yield batch[["doc_id", "node", "check"]].assign(keys=keys)


def _elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        shingled = list(batch_shingles(batch["text"]))
        sets, counted = [weighted_elements(s) for s in shingled], [np.unique(s, return_counts=True) for s in shingled]
        sketches = [dart_minhash(e, SKETCH, n).astype(np.uint8).tobytes() for e, n in counted]
        yield pd.DataFrame({"node": batch["node"], "elements": [e.view(np.int64) for e in sets], "sketch": sketches})


class _Choose:
    """For mapInPandas over members sorted by block: pairs of texts of different components whose sketches agree.

    A pair is looked at in the first band that it shares. best: only the best choices of each text, else all.
    """

    def __init__(self, best: bool):
        self.best = best

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for batch in batches:
            batch = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
            if not len(batch):
                continue
            place = batch[["bucket", "low", "high"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(axis=1)])
            for first, end in zip(starts[:-1], starts[1:], strict=True):
                yield from self.block(batch.iloc[first:end])
            waiting = batch.iloc[starts[-1] :]
        if waiting is not None and len(waiting):
            yield from self.block(waiting)

    def block(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        node, label, part = (rows[c].to_numpy() for c in ("node", "label", "part"))
        sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), -1)
        first = np.ascontiguousarray(sketch[:, :FIRST])
        codes = np.stack(rows["codes"])
        band = int(np.argmax(codes[0] == rows["bucket"].iloc[0] >> 32))
        one = rows["low"].iloc[0] == rows["high"].iloc[0]
        a, b = [], []
        for i in range(len(rows)):
            other = np.flatnonzero((label != label[i]) & (node > node[i] if not self.best else node != node[i]) & (one | (part != part[i])))
            if len(other):
                other = other[np.argmax(codes[other] == codes[i], axis=1) == band]
            if len(other):
                other = other[(first[other] == first[i]).mean(axis=1) >= FIRST_AGREE]
                agree = (sketch[other] == sketch[i]).mean(axis=1)
                if self.best:
                    keep = np.argsort(-agree, kind="stable")[:CHOICES]
                    other, agree = other[keep], agree[keep]
                other = other[agree >= AGREE]
                a.append(np.full(len(other), node[i])), b.append(node[other])
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            yield pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)})  # as links to leaders are written


def _mixed(members: DataFrame, labels: DataFrame, n_texts: int) -> DataFrame:
    """The members (bucket, n, node and more) of buckets in which several components remain, with their label."""
    placed = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.max("n").alias("n")).filter("l <> h").select("bucket", "n")
    mixed = materialise(mixed, "mixed")
    hot = F.col("n") * HOT > n_texts
    few = placed.filter(hot).join(F.broadcast(mixed.filter(hot).select("bucket")), "bucket")
    return few.unionByName(placed.filter(~hot).join(mixed.filter(~hot).select("bucket"), "bucket"))


def _chosen(members: DataFrame, labels: DataFrame, best: bool, n_texts: int) -> DataFrame:
    """Pairs (a, b) of members (bucket, n, node, codes, sketch) of a bucket to compare, given the components so far."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    part = F.pmod(F.xxhash64("node"), blocks).cast("int")
    spread = _mixed(members, labels, n_texts).withColumn("part", part).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = spread.select("bucket", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "part", "node", "label", "codes", "sketch")
    sorted_ = dealt.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    return sorted_.mapInPandas(_Choose(best), "a long, b long").distinct()


def _verified(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """pairs (a, b) of nodes with their exact distance, 1 less the weighted Jaccard similarity."""
    left, right = elements.toDF("a", "of_a"), elements.toDF("b", "of_b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    met = pairs.join(left, "a").join(right, "b").withColumn("common", common)
    return met.select("a", "b", (1 - F.col("common") / (F.size("of_a") + F.size("of_b") - F.col("common"))).alias("distance"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are in different components so far."""
    ends = labels.toDF("end", "of")
    at = pairs.join(ends, pairs["a"] == ends["end"], "left").select("a", "b", F.coalesce("of", "a").alias("of_a"))
    return at.join(ends, at["b"] == ends["end"], "left").filter(F.col("of_a") != F.coalesce("of", "b")).select("a", "b")


def text_hash(body: Column) -> Column:
    return F.xxhash64(body)


def text_check(body: Column) -> Column:
    """A second hash: texts are equal if both are."""
    return F.xxhash64(F.lit("check"), body)


def _apart_by_check(rows: DataFrame, twins: DataFrame) -> DataFrame:
    """rows (node, check and more) with nodes of their own for different texts that share a hash: twins has (node, low), the
    smallest check of each such hash, whose text keeps it."""
    other = F.col("low").isNotNull() & (F.col("check") != F.col("low"))
    return rows.join(small(twins), "node", "left").withColumn("node", F.when(other, F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("low")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, hash and check (64 bits each, of the text), class_id (the smallest doc_id of the class), keep.

    Texts are linked whose counted five-word shingles have a weighted Jaccard similarity of 0.8 or more, or that are equal;
    classes are the connected components. Texts of fewer than five words are only linked to equal ones; a null text is as an
    empty one; rows with null doc_id belong to classes but name none unless all are null. Repeated rows are rows of a class.
    One row of each class has keep: the first by doc_id (null ids last), then text, of repeated rows any one. Texts may be of
    any length; other columns are ignored.

    Equal texts, by both hashes, are one node from the start. Each text is compared with the smallest text of all its buckets
    first, then with the smallest of each bucket, its leader, unless both are in one component by then: few rows whatever a
    bucket's size, and the rest of a group is linked through its leaders. Where a bucket still holds several components, texts
    of different ones are compared, chosen by sketches of 1,024 bytes: in rounds first, each text with its best choices only,
    which joins most components; at last all that are left. So a large group costs pairs only between the components that it
    truly has. Large buckets are compared block by block, and joined to what is known of them without being dealt by bucket.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), body.alias("text"), text_hash(body).alias("node"), text_check(body).alias("check"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    signed = rows.mapInPandas(_sign, f"doc_id {id_type}, node long, check long, keys array<long>").withColumn("hash", F.col("node"))
    signed = materialise(signed.withColumn("row", F.monotonically_increasing_id()), "signed")  # written, so that numbers stay
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row"))

    def distinct(rows: DataFrame) -> DataFrame:
        found = rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("keys").alias("keys"), first.alias("first"), F.min("check").alias("low"), F.max("check").alias("high"))
        return materialise(found, "texts")

    texts = distinct(signed)
    twins = texts.filter("low <> high").select("node", "low")
    if not twins.isEmpty():
        rows, signed = _apart_by_check(rows, twins), _apart_by_check(signed, twins)
        texts = distinct(signed)
    n_texts = texts.count()
    buckets = texts.select("node", F.explode("keys").alias("bucket"))
    leaders = materialise(buckets.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1"), "leaders")
    hot = F.col("n") * HOT > n_texts
    met = buckets.join(F.broadcast(leaders.filter(hot)), "bucket", "left")
    rest = met.filter("leader is null").select("bucket", "node").join(leaders.filter(~hot).hint("shuffle_hash"), "bucket")
    members = materialise(met.filter("leader is not null").unionByName(rest), "members")
    links = members.filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    links = materialise(links, "links")

    wanted = links.select("a").union(links.select("b")).distinct().join(texts.select("node", "first_id"), F.col("a") == F.col("node")).select("node", "first_id")
    same = (rows["node"] == wanted["node"]) & rows["doc_id"].eqNullSafe(wanted["first_id"])
    # Dealt by text and document, so that a text with many copies is no hot key; rows that repeat a document are dropped after.
    elements = rows.join(wanted.hint("shuffle_hash"), same, "left_semi").select("node", "text").mapInPandas(_elements, "node long, elements array<long>, sketch binary")
    elements = materialise(elements, "elements")
    if elements.count() > elements.select("node").distinct().count():
        elements = elements.dropDuplicates(["node"])
    sets = elements.select("node", "elements")
    near = F.col("distance") <= 1 - SIMILARITY + 1e-9
    distances = materialise(_verified(links.groupBy("a").agg(F.min("b").alias("b")), sets), "distances")
    labels = components(distances.filter(near).select("a", "b"))
    others = links.join(distances.select("a", "b"), ["a", "b"], "left_anti")
    found = materialise(_verified(_apart(others, labels), sets), "found")
    distances = distances.unionByName(found)
    fresh = found.filter(near).select("a", "b")
    if not fresh.isEmpty():
        labels = merged(labels, fresh)

    # In buckets of two the only pair is known or needless; texts near their leader are in its component.
    several = _mixed(members.filter("n > 2").select("bucket", "n", "node"), labels, n_texts).drop("label")
    codes = texts.select("node", F.transform("keys", lambda k: F.shiftright(k, 32).cast("int")).alias("codes"))
    open_ = materialise(several.join(codes, "node").join(elements.select("node", "sketch"), "node"), "open")
    for best in [True] * ROUNDS_OF_CHOICES + [False] if not open_.isEmpty() else ():
        chosen = _chosen(open_, labels, best, n_texts).join(distances.select("a", "b"), ["a", "b"], "left_anti")
        found = materialise(_verified(chosen, sets), "found")
        distances = distances.unionByName(found)
        fresh = found.filter(near).select("a", "b")
        if not fresh.isEmpty():
            labels = merged(labels, fresh)

    classed = texts.select("node", "first_id", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    one = F.min(F.struct("first.nameless", "first.doc_id", "node", "first.row"))
    smallest = classed.groupBy("label").agg(F.min("first_id").alias("class_id"), one.alias("one"))
    classes = classed.join(smallest, "label").select("node", "class_id", F.col("one.row").alias("kept"))
    return signed.select("doc_id", "node", "hash", "check", "row").join(classes, "node").select("doc_id", "hash", "check", "class_id", (F.col("row") == F.col("kept")).alias("keep"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs of each class, with its own columns: the row by (doc_id, text) that has keep; see near_duplicates."""
    classed = materialise(near_duplicates(docs, key, text), "classes")
    texts = classed.groupBy("doc_id", "hash", "check").agg(F.max("keep").alias("keep"), F.count("*").alias("n"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    left = docs.withColumns({"_hash": text_hash(body), "_check": text_check(body)})

    def marked(rows: DataFrame, those: DataFrame, how: str) -> DataFrame:
        those = those.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_of"), F.col("check").alias("_by"))
        return rows.join(those, (rows["_hash"] == those["_of"]) & (rows["_check"] == those["_by"]) & rows[key].eqNullSafe(those["_id"]), how)

    left = marked(left, texts.filter(~F.col("keep")), "left_anti")
    # Of rows that repeat a document one stays; texts of different classes may share a doc_id.
    twice = materialise(texts.filter(F.col("keep") & (F.col("n") > 1)).select("doc_id", "hash", "check"), "twice")
    if twice.isEmpty():
        return left.drop("_hash", "_check")
    unique = marked(left, twice, "left_semi").dropDuplicates([key, "_hash", "_check"])
    return marked(left, twice, "left_anti").unionByName(unique).drop("_hash", "_check")


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "keep")


#: Similarities of all pairs that share a shingle, and the closure of their links.
ORACLE = r"""
WITH RECURSIVE texts AS (SELECT coalesce(text, '') AS text, row_number() OVER (ORDER BY coalesce(text, '')) AS node FROM documents GROUP BY 1),
words AS (SELECT node, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
shingles AS (
  SELECT node, shingle, count(*) AS n
  FROM (SELECT node, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle FROM words) GROUP BY 1, 2),
sizes AS (SELECT node, sum(n) AS size FROM shingles GROUP BY 1),
met AS (
  SELECT a.node AS a, b.node AS b, sum(least(a.n, b.n)) AS shared
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.node < b.node GROUP BY 1, 2),
links AS (
  SELECT a, b FROM met JOIN sizes s ON a = s.node JOIN sizes t ON b = t.node WHERE shared / (s.size + t.size - shared)::DOUBLE >= 0.8 - 1e-9),
reached AS (
  SELECT node AS origin, node FROM texts
  UNION SELECT origin, CASE WHEN a = node THEN b ELSE a END FROM reached JOIN links ON node IN (a, b)),
classes AS (SELECT node, min(origin) AS class FROM reached GROUP BY 1),
rows AS (SELECT doc_id, class, coalesce(d.text, '') AS text FROM documents d JOIN texts t ON coalesce(d.text, '') = t.text JOIN classes USING (node))
SELECT doc_id, min(doc_id) OVER (PARTITION BY class) AS class_id,
       row_number() OVER (PARTITION BY class ORDER BY doc_id NULLS LAST, text) = 1 AS keep FROM rows
"""
