"""The automaton against matching word by word, and every stage of the pipeline against plain Python and SQL."""

import collections
import math
import random

import duckdb

import corpus_pipeline
from tests.llm.conftest import ODD, SCHEMA, sentence
from tests.llm.test_free import classes_by_force
from tests.llm.test_native import bits, jump
from tidemark.llm import mixing, shingles, toxicity


def weighed(text, weights):
    """The weight of terms that start where a word does and end where one does, or anywhere if marked, outside of exceptions."""
    text = toxicity.seen(text)
    folded = toxicity.fold(text)
    starts = [i for i in range(len(text)) if i == 0 or not text[i - 1].isalnum()]
    ends = {i for i in range(len(text) + 1) if i == len(text) or not text[i].isalnum()}
    excused = [(i, i + len(p)) for i in starts for p in toxicity.EXCEPTIONS if folded.startswith(toxicity.fold(p), i) and i + len(p) in ends]
    found = collections.defaultdict(float)
    for term, weight in weights.items():
        bare = toxicity.fold(toxicity.seen(term.rstrip("*")))
        for i in starts:
            end = i + len(bare)
            if folded.startswith(bare, i) and (end in ends or term.endswith("*")) and not any(a <= i and end <= b for a, b in excused):
                found[i, end] = max(found[i, end], weight)
    return sum(found.values())


def test_automaton():
    rng = random.Random(11)
    weights = {t: float(n % 5 + 1) for n, t in enumerate(toxicity.SEED_TERMS)} | {"idi*": 2.5, "1d1ot": 8.0, "scu*": 1.5, "pig": 0.5}
    terms = toxicity.automaton(weights)
    stock = [*toxicity.SEED_TERMS, *toxicity.EXCEPTIONS, "idiocy", "pigs", "scuba", "day", "can", "fish", "the", "", "ünd", "漢字"]
    disguise = {"i": "1!|іl", "o": "0οо", "s": "$5ѕ", "a": "@4а", "e": "3еé", "t": "7т"}
    told = 0
    for _ in range(400):
        words = []
        for _ in range(rng.randint(0, 25)):
            word = rng.choice(stock)
            word = "".join(rng.choice(disguise.get(c, c)) if rng.random() < 0.2 else c + "​" * (rng.random() < 0.03) for c in word)
            words.append(word.upper() if rng.random() < 0.1 else word)
        text = rng.choice([" ", "\n", ", "]).join(words)
        weight, n = toxicity.weigh(text, terms)
        assert weight == weighed(text, weights) and n == max(len(toxicity.seen(text).split()), 1)
        told += weight > 0
    assert told > 200


def held(text, item):
    five = lambda t: {tuple(w[i : i + 5]) for w in [shingles.WORD.findall((t or "").lower())] for i in range(len(w) - 4)}
    return bool(five(item)) and len(five(item) & five(text)) >= 0.8 * len(five(item))


def test_pipeline_by_force(spark, tmp_path):
    rng = random.Random(4)
    docs = [(i, " ".join(sentence(rng, rng.randint(6, 90))), "en", f"s{i % 4}", 1) for i in range(60)]
    docs += [(100 + i, f"{docs[i][1]} more", "en", "s1", 1) for i in range(0, 60, 6)] + [(150 + i, docs[7][1], "en", None, 1) for i in range(12)]
    docs += [(200, "you stupid worthless idiot moron", "en", "s2", 1), (201, "the guinea pig sat near the trash can", "en", "s2", 1), (None, "you 1d!ot, you $tupid scum", "en", "s2", 1)]
    items = [" ".join(sentence(rng, n)) for n in (5, 9, 30, 200)]
    docs += [(300 + i, f"{docs[i][1]} {item} {docs[i + 8][1]}", "en", "s3", 1) for i, item in enumerate(items)] + [(None, f"{items[1]} and on", "en", "s3", 1), (5, items[2], "en", "s0", 1), *ODD]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    seeds = dict.fromkeys(toxicity.SEED_TERMS, toxicity.SEED_WEIGHT)

    def toxic(text):
        weight, (bias, first, second) = weighed(text or "", seeds), toxicity.DEFAULT_CURVE
        return bias + first * math.log1p(weight) + second * math.log1p(100 * weight / max(len((text or "").split()), 1)) >= 0

    stages, at = dict(corpus_pipeline.STAGES), f"{tmp_path}/documents.parquet"

    def run(name):
        nonlocal at
        before = [tuple(r) for r in spark.read.parquet(at).collect()]
        stages[name](spark, spark.read.parquet(at), str(tmp_path)).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        at = f"{tmp_path}/{name}"
        return before, [tuple(r) for r in spark.read.parquet(at).collect()]

    before, after = run("toxicity")
    assert collections.Counter(after) == collections.Counter(r for r in before if not toxic(r[1]))
    assert {"you stupid worthless idiot moron", "you 1d!ot, you $tupid scum"} <= {r[1] for r in before} - {r[1] for r in after} and 201 in {r[0] for r in after}

    before, after = run("neardup")
    left = collections.Counter(after)
    for found in classes_by_force([(n, r[1]) for n, r in enumerate(before)]):
        own = [before[n] for n in found]
        ids = [r[0] for r in own if r[0] is not None]
        kept = [r for r in set(own) if left[r]]
        assert len(kept) == 1 and left[kept[0]] == 1 and kept[0][0] == min(ids, default=None)
        del left[kept[0]]
    assert not left and len(after) < len(before) - 20

    before, after = run("decontamination")
    assert collections.Counter(after) == collections.Counter(r for r in before if not any(held(r[1], i) for i in items)) and len(before) - len(after) > 4

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/*.parquet'")
    plan = con.execute(f"SELECT doc_id, sum(taken) FROM ({mixing.ORACLE}) GROUP BY 1 HAVING sum(taken) > 0").fetchall()
    before, after = run("mixing")
    taken = collections.Counter()
    for r in after:
        taken[r[0]] += len((r[1] or "").split())
    assert set(after) <= set(before) and {d: n for d, n in taken.items() if n} == {d: int(n) for d, n in plan}
    assert max(collections.Counter(after).values()) <= 3

    before, after = run("sharding")
    columns = spark.read.parquet(at).columns
    shard, doc, slot = (columns.index(c) for c in ("shard", "doc_id", "slot"))
    assert collections.Counter((r[doc], r[shard]) for r in after) == collections.Counter((r[0], jump(bits(r[0]), 40)) for r in before)
    assert all(sorted(r[slot] for r in after if r[shard] == s) == list(range(sum(r[shard] == s for r in after))) for s in range(40))
    assert collections.Counter(r[doc] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == collections.Counter(r[doc] for r in after)
