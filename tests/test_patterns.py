"""Ranks and averages over whole tables against plain Python."""

import random
import re
from bisect import bisect_right

from pyspark.sql import functions as F

from tidemark.operators import patterns
from tidemark.plans import catalogue


def test_every_part_has_a_place(spark, tmp_path):
    parts = [(i, i * 7 % 50 + 1) for i in range(1500)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["p_partkey"]: r["place"] for r in catalogue.version_compare_sort(spark, str(tmp_path)).collect()}
    assert got == {k: n for n, (_, _, k) in enumerate(sorted((s, k % 7, k) for k, s in parts), 1)}
    assert patterns.numbered(spark.range(0), F.col("id"), "place").count() == 0


def test_ranks_stay_apart(spark):
    plan = patterns.numbered(spark.range(1000), F.col("id"), "place")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_percentile_of_whole_groups(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([None, 1.5, rng.random(), float(rng.randint(0, 9))])) for g in ("a", "b", None) for _ in range(1000)] + [("few", 2.0), ("none", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for p in (0.0, 0.2, 0.5, 0.99, 1.0):
        want = {}
        for g in {g for g, _ in rows}:
            of = sorted((v for k, v in rows if k == g), key=lambda v: (v is not None, v or 0))
            want[g] = of[min(int(p * len(of)), len(of) - 1)]
        got = patterns.percentile_nearest(df, "g", "v", p).collect()
        assert {r["g"]: r["percentile"] for r in got} == want and len(got) == len(want)


def test_percentile_ranks_only_a_range(spark):
    rows = spark.range(0, 20_000, 1, 4).select(F.lit("one").alias("g"), F.col("id").cast("double").alias("v"))
    got = patterns.percentile_nearest(rows, "g", "v", 0.99)
    assert got.collect()[0]["percentile"] == 19_800.0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan


def test_average_of_a_long_group(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        rng = random.Random(4)
        big = 2**60 + 1
        rows = [(rng.choice([big, big, None, 1, 2]), i, float(rng.randint(-50, 50))) for i in range(3000)] + [(7, 1, 5.0), (7, 2, None), (7, 3, 8.0)]
        want = {}
        for g, _, v in rows:
            want[g] = None if v is None or want.get(g, 0) is None else (want.get(g, 0) * 9 + int(v)) // 10
        df = patterns.moving_average(spark.createDataFrame(rows, "g long, i long, v double").repartition(3), "g", "i", "v")
        got = df.collect()
        assert {r["g"]: r["average"] for r in got} == want and len(got) == len(want)
        assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_absorbing_follows_the_order(spark):
    rng = random.Random(9)
    rows = [(a, i, rng.uniform(0, 30), rng.uniform(0, 30), rng.uniform(1, 200)) for a in range(4) for i in range(25)] + [(9, 1, 0.0, 0.0, 5.0)]
    want = {}
    for arena in {r[0] for r in rows}:
        own = [[i, x, y, m, True] for a, i, x, y, m in rows if a == arena]
        for one in own:
            for other in own:
                if one is not other and one[4] and other[4] and one[3] > 1.15 * other[3]:
                    if ((one[1] - other[1]) ** 2 + (one[2] - other[2]) ** 2) ** 0.5 < one[3] ** 0.5 - 0.35 * other[3] ** 0.5:
                        one[3], other[3], other[4] = one[3] + other[3], 0.0, False
        want |= {(arena, i): (round(m, 6), alive) for i, _, _, m, alive in own}
    got = patterns.absorbed(spark.createDataFrame(rows, "arena int, id int, x double, y double, mass double")).collect()
    assert {(r["arena"], r["id"]): (round(r["mass"], 6), r["alive"]) for r in got} == want and len(got) == len(rows)
    assert 0 < sum(not r["alive"] for r in got) < len(rows)


def near(a, b, r2):
    return (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= r2


def tasks_of(df):
    """Tasks of the last stage, as it ran."""
    return df.rdd.getNumPartitions()


def test_crowded_cells_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(patterns, "BLOCK", 16, raising=False)
    monkeypatch.setattr(patterns, "PAIRS_PER_TASK", 2_000, raising=False)
    rng = random.Random(5)
    rows = [(i, rng.randint(-9, 9), rng.randint(0, 3)) for i in range(300)] + [(i, 1, 1) for i in range(300, 400)]
    df = patterns.neighbour_pairs(spark.createDataFrame(rows, "id long, x long, y long"), cell=4, radius2=9)
    want = sorted((a[0], b[0], (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) for a in rows for b in rows if a[0] < b[0] and near(a, b, 9))
    assert sorted(map(tuple, df.collect())) == want
    assert tasks_of(df) >= 20


def test_pairs_are_of_two_ids(spark):
    rows = [(1, 0, 0), (1, 1, 0), (1, 4, 0), (2, 4, 0), (None, 1, 1), (None, 4, 1), (3, None, 0)]
    got = patterns.neighbour_pairs(spark.createDataFrame(rows, "id long, x long, y long"), cell=4, radius2=16)
    assert sorted(map(tuple, got.collect())) == [(1, 2, 0), (1, 2, 9), (1, 2, 16)]


def test_radius_of_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(patterns, "BLOCK", 16, raising=False)
    monkeypatch.setattr(patterns, "PAIRS_PER_TASK", 2_000, raising=False)
    rng = random.Random(6)
    left = [(i, rng.randint(-9, 9), rng.randint(0, 3)) for i in range(150)] + [(None, 0, 0), (7, None, 0)]
    right = [(i, rng.randint(-9, 9), rng.randint(0, 3)) for i in range(200)] + [(5, 2, 2), (6, 50, 50)]
    df = patterns.radius_join(spark.createDataFrame(left, "id long, x long, y long"), spark.createDataFrame(right, "id long, x long, y long"), 3, 4)
    want = sorted((a[0] or -1, b[0], (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) for a in left for b in right if a[1] is not None and near(a, b, 9))
    assert sorted((p or -1, q, d) for p, q, d in df.collect()) == want
    assert tasks_of(df) >= 8


def test_first_in_reach_meets_places_once(spark, monkeypatch):
    met = []
    monkeypatch.setattr(patterns, "_meetings", lambda left, right, *more, real=patterns._meetings: (met.append((left.count(), right.count())), real(left, right, *more))[1])
    rng = random.Random(8)
    left = [(i, rng.randint(0, 5), rng.randint(0, 5)) for i in range(400)] + [(None, 0, 0), (None, 30, 30)]
    right = [(i % 350, rng.randint(0, 9), rng.randint(0, 9)) for i in range(400)] + [(900, 30, 31), (901, 60, 60), (None, 1, 1), (902, None, 1)]
    args = spark.createDataFrame(left, "id long, x long, y long"), spark.createDataFrame(right, "id long, x long, y long"), 3, 4
    want = {}
    for a in left:
        for b in right:
            if b[1] is not None and near(a, b, 9):
                want[b[0]] = min((i for i in (a[0], want.get(b[0])) if i is not None), default=None)
    got = patterns.first_in_reach(*args).collect()
    assert {r["right_id"]: r["left_id"] for r in got} == want and len(got) == len(want)
    assert max(met[0]) <= 104
    slow = patterns.first_taker(patterns.radius_join(*args))
    assert sorted(map(str, slow.collect())) == sorted(map(str, got))


def test_first_taker_wins_lists_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(patterns, "radius_join", None)
    assert catalogue.first_taker_wins(spark, "/root/testdata/sf0.001").count() > 0


def test_order_is_worked_out_once_a_row(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).cast("string").alias("v"))
    plans, grouped = [], type(df).groupBy
    told = lambda of: plans.append(of._jdf.queryExecution().optimizedPlan().toString())
    monkeypatch.setattr(type(df), "groupBy", lambda self, *by: (told(grouped(self, *by).count()), grouped(self, *by))[1])
    ranked = patterns.numbered(df, F.upper("v"), "place")
    assert {r["v"]: r["place"] for r in ranked.collect()} == {v: n for n, v in enumerate(sorted(map(str, range(1000))), 1)}
    told(ranked)
    plan = "\n".join(plans)
    assert len(plans) == 2 and "lambdafunction" in plan
    for start in re.finditer("lambdafunction", plan):
        depth, end = 0, start.end()
        while True:
            depth += {"(": 1, ")": -1}.get(plan[end], 0)
            end += 1
            if not depth:
                break
        assert "upper" not in plan[start.start() : end]


def test_buckets_are_found_by_halving(spark):
    known = sorted(random.Random(2).sample(range(100), 37)) + [98, 98, 98]
    for bounds in (known, known[:1], known[:2], known[:8]):
        got = spark.range(-2, 105).select("id", patterns._bucket(bounds, F.col("id"))).collect()
        assert [n for _, n in got] == [bisect_right(bounds, i) for i, _ in got]
    assert spark.range(1).select(patterns._bucket(known, F.lit(None).cast("long"))).first()[0] == 0
