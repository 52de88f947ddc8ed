"""Recall of the vector search against brute force, over several blocks and cells, with a rerank far below the number of vectors."""

import duckdb
import numpy as np
import pytest

from tidemark.llm import vectors


def recall(spark, ids, x, every, **options):
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {}
    for r in vectors.nearest(df, every=every, **options).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in np.flatnonzero(ids % every == 0):
        scores = x @ x[q]
        scores[q] = -np.inf
        want = ids[np.lexsort((ids, -scores))[:20]]
        found = sorted(got[ids[q]])
        assert [r for r, *_ in found] == list(range(1, 21)) and all(a[2] >= b[2] for a, b in zip(found, found[1:], strict=False))
        hits += len(set(want) & {v for _, v, _ in found})
    return hits / (20 * len(got))


def test_on_the_table(spark):
    found = duckdb.sql("SELECT vec_id, embedding FROM '/root/testdata/sf0.1/embeddings.parquet' ORDER BY vec_id").df()
    assert recall(spark, found.vec_id.to_numpy(), np.stack(found.embedding).astype(float), 20) >= 0.97


@pytest.mark.parametrize("clusters", [0, 40])
def test_on_fifty_thousand(spark, monkeypatch, clusters):
    rng = np.random.default_rng(clusters)
    x = rng.normal(size=(50_000, 32)) + (rng.normal(size=(clusters, 32)) * 3)[rng.integers(0, clusters, 50_000)] if clusters else rng.normal(size=(50_000, 32))
    x *= rng.uniform(0.8, 1.2, (50_000, 1))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 64)
    probed = []
    real = vectors.calibrated
    monkeypatch.setattr(vectors, "calibrated", lambda *a: probed.append((real(*a), len(a[1]))) or real(*a))
    assert recall(spark, np.arange(50_000), x, 400, cell=4096) >= 0.95
    (probes, cells), = probed
    assert cells == 13 and (probes <= 6 if clusters else probes > 9)  # clusters spare most of the scan; without any, nothing can


def test_everything_is_exact(spark):
    x = np.random.default_rng(3).normal(size=(3000, 9))
    assert recall(spark, np.arange(3000), x, 300, rerank=None, probes=vectors.MOST_CELLS, cell=500) == 1.0
