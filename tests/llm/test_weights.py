"""Signatures of real weights, texts that share a hash, and large buckets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import sentence
from tests.llm.test_free import classes_by_force
from tidemark.llm import neardup


@pytest.mark.parametrize("n, scale", [(40, 1.0), (300, 6.5), (5, 100.0), (2000, 0.05), (1, 3.7)])
def test_real_weights(n, scale):
    rng = np.random.default_rng(n)
    ids = np.unique(rng.integers(0, 2**63, 2 * n).astype(np.uint64))[:n]
    a, b = rng.exponential(scale, n) + 1e-6, rng.exponential(scale, n) + 1e-6
    b = np.where(rng.random(n) < 0.6, a, b)
    k = 4000
    same = (neardup.dart_minhash(ids, k, a) == neardup.dart_minhash(ids[::-1], k, b[::-1])).mean()
    assert abs(same - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_unit_weights_are_the_default():
    ids = np.arange(1, 500, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert (neardup.dart_minhash(ids, 80) == neardup.dart_minhash(ids, 80, np.ones(len(ids)))).all()


def classes(found):
    got = {}
    for r in found:
        got.setdefault(r["class_id"], set()).add(r["doc_id"])
    return {frozenset(v) for v in got.values()}


@pytest.mark.parametrize("buckets_are", ["hot", "cold"])
def test_different_texts_of_one_hash(spark, monkeypatch, buckets_are):
    monkeypatch.setattr(neardup, "text_hash", lambda body: F.pmod(F.xxhash64(body), F.lit(9)))
    monkeypatch.setattr(neardup, "HOT", 10**9 if buckets_are == "hot" else 0)
    rng = random.Random(12)
    rows = [(i, " ".join(sentence(rng, 40))) for i in range(12)]
    base = sentence(rng, 90)
    for i in range(20, 50):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(90)] = sentence(rng, 1)[0]
        rows.append((i, " ".join(words)))
    rows += [(60, rows[0][1]), (61, rows[1][1]), (62, "the same words " * 30), (63, "the same words " * 33), (64, ""), (65, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = classes_by_force(rows)
    assert classes(neardup.near_duplicates(df).collect()) == want
    kept = [r["doc_id"] for r in neardup.keep_one(df).collect()]
    assert len(kept) == len(want) and all(len(c & set(kept)) == 1 for c in want)
