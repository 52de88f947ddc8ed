"""Unequal inclusion, repeated rows, and the same choice in every run."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing


def test_expected_copies_fill_the_target(spark):
    rows = [("0a", w, 10 * w, 1000, t) for w in (1, 2, 5, 9) for t in (0.0,)]
    cases = []
    for n, target in enumerate((0.0, 40.0, 170.0, 300.0, 450.0, 510.0)):
        cases += [(f"s{n}", w, words, 170, target) for _, w, words, *_ in rows]
    got = mixing.class_plan(spark.createDataFrame(cases, "source_key string, wish long, words long, source_size long, target double")).collect()
    by = collections.defaultdict(dict)
    for r in got:
        by[r["source_key"], r["target"]][r["wish"]] = r["whole"] + r["p"]
    for (_, target), copies in by.items():
        assert sum(c * 10 * w for w, c in copies.items()) == pytest.approx(target, abs=1e-6) and all(0 <= c <= 3 for c in copies.values())
        free = [c / w for w, c in copies.items() if c < 3 - 1e-9]
        assert all(f == pytest.approx(free[0]) for f in free) and all(3 / w <= free[0] + 1e-9 for w, c in copies.items() if c >= 3 - 1e-9 and free)


def test_long_texts_come_more_often(spark):
    docs = spark.createDataFrame([(i, "w " * (2 if i % 2 else 200), "a" if i < 1000 else "b") for i in range(2000)], "doc_id long, text string, source string")
    copies = {r["odd"]: r["mean"] for r in mixing.mix_counts(docs).filter("doc_id >= 1000").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.avg("copies").alias("mean")).collect()}
    assert copies[0] > 2.5 * copies[1] > 0  # 8 binary digits against 2


def test_repeated_rows(spark):
    """Of a document that is half of all rows, with extra columns that differ, every run takes the same rows."""
    rng = random.Random(6)
    rows = [(7, "one two three", "a", rng.choice([None, "x", "y", str(i)])) for i in range(400)] + [(100 + i, "four five " * (i % 5), f"{'ab'[i % 2]}", None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, more string").withColumn("pairs", F.create_map(F.lit("k"), "more"))
    counts = collections.Counter()
    for r in mixing.mix_counts(docs).collect():
        counts[r["doc_id"]] += r["copies"]
    take = lambda df: collections.Counter((r["doc_id"], r["text"], r["source"], r["more"]) for r in mixing.mix_documents(df).collect())
    first = take(docs)
    assert first == take(docs.repartition(5)) == take(docs.orderBy(F.desc("more")).coalesce(2))
    got = collections.Counter()
    for (doc_id, *_), n in first.items():
        got[doc_id] += n
    assert got == +counts
    given = collections.Counter((r[0], r[1], r[2], r[3]) for r in rows)
    assert all(n <= 3 * given[k] for k, n in first.items())
