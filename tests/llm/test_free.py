"""Toxicity, decontamination, near duplicates, vector search and the pipeline against brute force."""

import collections
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import ODD, SCHEMA, sentence
from tidemark.llm import decontamination, graph, neardup, shingles, toxicity, vectors

DATA = "/root/testdata/sf0.01"


def test_word_hashes(monkeypatch):
    text = "Hello wörld, foo-bar 42 hello"
    h = shingles.word_hashes(text)
    assert len(h) == 6 and h[0] == h[5] and len(set(h)) == 5
    assert (shingles.word_hashes("x " + text)[1:] == h).all() and len(shingles.word_hashes("")) == 0
    many = " ".join(sentence(random.Random(1), 5000))
    whole = shingles.word_hashes(many)
    monkeypatch.setattr(shingles, "BLOCK", 1000)
    assert (shingles.word_hashes(many) == whole).all()
    assert (shingles.word_hashes("a" * 5000 + " b")[1:] == shingles.word_hashes("b")).all()
    texts = ["a b c d e f", None, "", "one two", many, "a b c d e g"]
    for got, t in zip(shingles.batch_shingles(texts), texts, strict=True):
        assert (got == shingles.shingle_hashes(t or "")).all()


def test_weighted_elements():
    e = lambda t: set(shingles.weighted_elements(shingles.shingle_hashes(t)).tolist())
    a, b = e("x y z u v " * 4), e("x y z u v " * 3)
    assert b < a and len(a) == 16 and len(b) == 11 and e("few words") == set()


@pytest.mark.parametrize("n, same", [(1000, 800), (40, 30), (5, 4), (20000, 15000)])
def test_dart_minhash_estimates(n, same):
    rng = np.random.default_rng(n)
    a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    b = np.concatenate([a[:same], rng.integers(0, 2**63, len(a) - same).astype(np.uint64)])
    k = 3000
    assert abs((neardup.dart_minhash(a, k) == neardup.dart_minhash(b, k)).mean() - same / (2 * len(a) - same)) < 0.05
    assert (neardup.dart_minhash(a, 96) == neardup.dart_minhash(a[::-1], 96)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (7, 7)]
    labels = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["label"] for r in labels.collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    more = graph.merged(labels, spark.createDataFrame([(40, 102), (500, 501)], "a long, b long"))
    got = {r["node"]: r["label"] for r in more.collect()}
    assert got[101] == 0 and got[501] == 500 and len(got) == 46


def classes_by_force(rows):
    sets = []
    for _, t in rows:
        c = collections.Counter()
        words = shingles.WORD.findall((t or "").lower())
        for i in range(len(words) - 4):
            c[tuple(words[i : i + 5])] += 1
        sets.append(c)
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = sum((sets[i] & sets[j]).values())
            union = sum(sets[i].values()) + sum(sets[j].values()) - common
            if (rows[i][1] or "") == (rows[j][1] or "") or union and common / union >= 0.8:
                at[root(i)] = root(j)
    found = collections.defaultdict(set)
    for i, (d, _) in enumerate(rows):
        found[root(i)].add(d)
    return {frozenset(v) for v in found.values()}


def test_near_duplicates(spark, odd, empty):
    rng = random.Random(5)
    rows = [(i, " ".join(sentence(rng, 60))) for i in range(30)]
    base = sentence(rng, 150)
    for i in range(30, 90):  # a group whose texts lie at many distances from each other
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(150)] = sentence(rng, 1)[0]
        rows.append((i, " ".join(words)))
    rows += [(200 + i, rows[3][1]) for i in range(5)] + [(300, ""), (301, None), (302, "a b"), (303, "a b"), (304, "For " * 40), (305, "For " * 42), (306, "For " * 80)]
    got = collections.defaultdict(set)
    for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["class_id"]].add(r["doc_id"])
    assert {frozenset(v) for v in got.values()} == classes_by_force(rows) and all(k == min(v) for k, v in got.items())
    assert neardup.near_duplicates(odd).count() == len(ODD) and neardup.near_duplicates(empty).count() == 0
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == [1, 2, 4, 5, 6, 7]
    assert neardup.keep_one(empty).count() == 0


@pytest.mark.parametrize("most_sent", [10**6, 0])
def test_containment(spark, empty, most_sent):
    rng = random.Random(9)
    items = [(i, " ".join(sentence(rng, rng.randint(5, 80)))) for i in range(60)] + [(100, "too short"), (101, None)]
    docs = []
    for i in range(60):
        words = items[i][1].split()
        if i % 3 == 1:
            words[0] = "changed"
        if i % 3 == 2:
            words = words[: len(words) // 2]
        around = sentence(rng, rng.choice([0, 3, 500, 9000]))
        docs.append((i, " ".join(around[: len(around) // 3]) + " " + " ".join(words).upper() + ". " + " ".join(around[len(around) // 3 :])))
    docs += [(0, docs[0][1]), (500, None), (501, ""), (None, items[0][1]), (502, "too short")]

    def of(text):
        w = shingles.WORD.findall((text or "").lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    own = {i: of(t) for i, t in items if of(t)}
    want = {(d, i) for d, t in docs if d is not None for i, s in own.items() if len(s & of(t)) >= 0.8 * len(s)}
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_contaminated(df, bench, most_sent).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) and len(want) > 30
    assert decontamination.find_contaminated(empty, bench, most_sent).count() == 0 and decontamination.find_contaminated(df, bench.limit(0), most_sent).count() == 0
    left = decontamination.drop_contaminated(df, bench)
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_folding_and_exceptions():
    terms = toxicity.automaton({"idiot": 2.0, "stupid": 3.0, "trash": 1.0, "shut up": 4.0, "vermin*": 5.0})
    w = lambda t: toxicity.weigh(t, terms)[0]
    assert w("You 1D10T!") == 2 and w("ѕtυріd") == 3 and w("$tup!d, ÍDIÓT") == 5 and w("ｉｄｉｏｔ") == 2 and w("verminous") == 5
    assert w("idiotic") == 0 and w("xidiot") == 0 and w("the trash can, some trash") == 1 and w("Shut up.") == 4 and w("") == 0


def test_toxicity_on_held_out_rows(spark, odd, empty):
    rows = toxicity.op1_toxicity(spark, DATA).toPandas()
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{DATA}/labels.parquet'").df()
    both = rows[rows.held_out].merge(labels, on="doc_id")
    assert len(rows) == 1000 and (both.predicted == both.toxic).mean() > 0.93
    none = spark.createDataFrame([], "doc_id long, toxic int")
    bare = toxicity.score_toxicity(odd, none)
    assert bare.count() == len(ODD) and bare.filter("predicted = 1 or score is null or held_out is null").count() == 0 and toxicity.score_toxicity(empty, none).count() == 0
    rude = spark.createDataFrame([(1, "you stupid worthless idiot"), (2, "a fine day in the park")], "doc_id long, text string")
    assert [r["predicted"] for r in toxicity.score_toxicity(rude, none).orderBy("doc_id").collect()] == [1, 0]
    kept = toxicity.drop_toxic(odd, none)
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_nearest_recall(spark):
    x = duckdb.sql(f"SELECT vec_id, embedding FROM '{DATA}/embeddings.parquet' ORDER BY vec_id").df()
    m, ids = np.stack(x.embedding).astype(float), x.vec_id.to_numpy()
    got = collections.defaultdict(list)
    for r in vectors.op6_nearest(spark, DATA).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = m @ m[q]
        s[q] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        hits += len(set(want) & {v for v, _ in got[ids[q]]})
        assert all(abs(score - m[q] @ m[np.flatnonzero(ids == v)[0]]) < 1e-12 for v, score in got[ids[q]])
    assert hits >= 0.95 * 20 * len(got) and len(got) == (ids % 20 == 0).sum()


def test_nearest_odd_vectors(spark):
    rows = [(20, [1.0, 0.0, 2.0]), (40, [0.0, 0.0, 0.0]), (60, None), (80, [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (1, [3.0, 0.0, 0.0]), (2, [3.0, 0.0, 0.0]), (3, [None, 1.0, 2.0]), (4, [float("inf"), 0.0, 1.0]), (5, [1.0]), (6, [-1.0, 0.0, 0.0]), (6, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vector", F.lit("clash"))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vectors.nearest(df).orderBy("rank").collect()]
    assert got == [(20, 1, 1, 3.0), (20, 2, 2, 3.0), (20, 3, 6, -1.0)]
    assert vectors.nearest(df.limit(0)).count() == 0 and vectors.nearest(df.filter("vec_id = 1")).count() == 0


def test_pipeline(spark, tmp_path):
    rng = random.Random(3)
    docs = [(i, " ".join(sentence(rng, 40)), "en", f"s{i % 4}", 1) for i in range(60)]
    docs += [(100, docs[0][1], "en", "s1", 1), (101, docs[1][1] + " more", "en", "s0", 1), (102, "you stupid worthless idiot moron", "en", "s2", 1)]
    item = " ".join(sentence(rng, 30))
    docs += [(103, f"{docs[2][1][:50]} {item} {docs[4][1][:90]}", "en", "s3", 1), *ODD]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df.write.parquet(f"{tmp_path}/{len(seen)}") if seen else None
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        out.write.parquet(f"{tmp_path}/out{len(seen)}")
        df = spark.read.parquet(f"{tmp_path}/out{len(seen)}")
        seen.append({r["doc_id"] for r in df.select("doc_id").collect()})
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "neardup", "decontamination", "mixing", "sharding"]
    assert 102 not in seen[0] and len(seen[0]) == 64 and {100, 101} & seen[1] == set() and seen[1] - seen[2] == {103}
    shards = corpus_pipeline.run(spark, str(tmp_path))
    assert shards.count() == df.count() and {r["doc_id"] for r in shards.collect()} == seen[3] <= seen[2]
