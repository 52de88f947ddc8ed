"""Rows that share a doc_id, or have none."""

import random
from collections import Counter

import corpus_pipeline
from tidemark.llm import decontamination, neardup

from .conftest import sentence

SCHEMA = "doc_id long, text string"


def test_clean_rows_of_a_shared_id_stay(spark, tmp_path):
    rng = random.Random(21)
    passage = " ".join(sentence(rng, 30))
    clean = [" ".join(sentence(rng, 40)) for _ in range(4)]
    leak = clean[3] + " " + passage
    docs = [(1, leak), (1, clean[0]), (1, clean[1]), (2, clean[2]), (2, clean[2]), (None, leak), (None, clean[0]), (None, None), (3, None)]
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(9, passage)], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter(d for d in docs if d[1] != leak)
    assert Counter(map(tuple, corpus_pipeline.decontaminate(spark, df, str(tmp_path)).collect())) == want
    assert Counter(map(tuple, decontamination.drop_contaminated(df, bench).collect())) == want + Counter([(None, leak)])
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in decontamination.op5_decontamination(spark, str(tmp_path)).collect()) == [("1", 9), ("None", 9)]


def test_one_row_of_each_class(spark, tmp_path):
    rng = random.Random(22)

    def near():
        words = sentence(rng, 120)
        return [" ".join([*words[:n], "other", *words[n + 1 :]]) for n in (0, 60, 119)]

    nameless, shared, mixed = near(), near(), near()
    docs = [(None, x) for x in nameless] + [(None, nameless[0])] * 2 + [(7, x) for x in shared] + [(7, shared[1])] + [(8, mixed[0]), (None, mixed[1]), (8, mixed[2]), (9, mixed[0])]
    df = spark.createDataFrame(docs, SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    kept = [tuple(r) for r in neardup.keep_one(df).collect()]
    assert len(kept) == 3 and Counter(k for k, _ in kept) == {None: 1, 7: 1, 8: 1}
    assert all(sum(t in of for _, t in kept) == 1 for of in (nameless, shared, mixed))
    marked = neardup.op8_neardup(spark, str(tmp_path)).collect()
    assert len(marked) == len(docs) and sorted(str(r["doc_id"]) for r in marked if r["keep"]) == ["7", "8", "None"]
    assert all(r["doc_id"] == r["class_id"] for r in marked if r["keep"])
