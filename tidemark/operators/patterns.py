"""Joins and aggregates that reducers compute over entities: spatial joins by grid cells, upserts, expiry, ranks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Points of a block of a cell, pairs that a task compares, and points that it reads, about.
BLOCK, PAIRS_PER_TASK, POINTS_PER_TASK = 512, 16_000_000, 500_000
#: A cell and those around it; the half of them by which each pair of cells meets once.
AROUND = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
HALF = [(0, 0), (1, 0), (1, 1), (0, 1), (-1, 1)]


def _meetings(left: DataFrame, right: DataFrame, cell: float, steps: Sequence[tuple[int, int]]) -> DataFrame:
    """(p, px, py, own, q, qx, qy): points (id, x, y) of left beside those of right whose cells are one of the steps away.

    The points of a right cell are dealt to blocks, and a left point goes to every block of the cells that it meets, so a crowded
    cell is many small joins. The number of tasks goes by the pairs to compare, which are counted by cell first: the bytes
    that are shuffled, by which Spark would merge tasks, say nothing of them.
    """
    cx, cy = F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")
    met = F.array(*[F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy"), F.lit((dx, dy) == (0, 0)).alias("own")) for dx, dy in steps])
    near = left.select(F.col("id").alias("p"), F.col("x").alias("px"), F.col("y").alias("py"), cx, cy)
    at = right.select(F.col("id").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy"), cx, cy)
    held = at.groupBy("cx", "cy").agg(F.count("*").alias("_held"))
    here = near.groupBy("cx", "cy").agg(F.count("*").alias("_n")).select("_n", F.explode(met).alias("c")).select("_n", "c.*").join(held, ["cx", "cy"])
    blocks = F.ceil(F.col("_held") / BLOCK).cast("int")
    pairs, points = here.agg(F.sum(F.col("_n").cast("double") * F.col("_held")), F.sum(F.col("_n") * blocks + F.col("_held") / len(steps))).first()
    tasks = max(math.ceil((pairs or 0) / PAIRS_PER_TASK) + math.ceil((points or 0) / POINTS_PER_TASK), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = at.join(held, ["cx", "cy"]).withColumn("block", F.pmod(F.xxhash64("q", "qx", "qy"), blocks).cast("int")).drop("_held")
    near = near.select("p", "px", "py", F.explode(met).alias("c")).select("p", "px", "py", "c.*").join(held, ["cx", "cy"])
    near = near.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("_held")
    keys = ["cx", "cy", "block"]
    return near.repartition(tasks, *keys).join(at.repartition(tasks, *keys).hint("shuffle_hash"), keys).drop(*keys)


def _squared() -> Column:
    dx, dy = F.col("px") - F.col("qx"), F.col("py") - F.col("qy")
    return dx * dx + dy * dy


def neighbour_pairs(points: DataFrame, id: str = "id", cell: int = 4, radius2: int = 4) -> DataFrame:
    """(a, b, d2): pairs a < b of points (id, x, y) whose squared distance is at most radius2, at most cell squared.

    Points meet by grid cell: half of the cells around a point, and its own, so that each pair of cells meets once.
    """
    if radius2 > cell * cell:
        raise ValueError("cells must be as long as the radius")
    at = points.select(F.col(id).alias("id"), "x", "y")
    met = _meetings(at, at, cell, HALF).filter((_squared() <= radius2) & (F.col("p") != F.col("q")) & (~F.col("own") | (F.col("p") < F.col("q"))))
    return met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), _squared().alias("d2"))


def radius_join(left: DataFrame, right: DataFrame, radius: int, cell: int) -> DataFrame:
    """(left_id, right_id, d2) for points (id, x, y) within the radius of each other, by grid cells as long as the radius or longer."""
    met = _meetings(left, right, cell, AROUND).filter(_squared() <= radius * radius)
    return met.select(F.col("p").alias("left_id"), F.col("q").alias("right_id"), _squared().alias("d2"))


def first_taker(pairs: DataFrame, taker: str = "left_id", taken: str = "right_id") -> DataFrame:
    """Each taken thing once, by the first taker."""
    return pairs.groupBy(taken).agg(F.min(taker).alias(taker))


def first_in_reach(left: DataFrame, right: DataFrame, radius: int, cell: int) -> DataFrame:
    """`first_taker` of `radius_join` without its pairs: each right id that a left point reaches, with the smallest left id that does.

    Only the smallest id of a place can be first, and all that share a place have the same first, so each place meets once.
    """
    takers = left.groupBy("x", "y").agg(F.min("id").alias("id"))
    places = right.select(F.lit(0).alias("id"), "x", "y").distinct()
    near = _meetings(takers, places, cell, AROUND).filter(_squared() <= radius * radius)
    first = near.groupBy(F.col("qx").alias("x"), F.col("qy").alias("y")).agg(F.min("p").alias("left_id"))
    return first_taker(right.select(F.col("id").alias("right_id"), "x", "y").join(first, ["x", "y"]))


def absorbed(entities: DataFrame, ratio: float = 1.15, inset: float = 0.35, group: str = "arena") -> DataFrame:
    """(arena, id, mass, alive) after each entity, in the order of ids, has absorbed those that it can.

    entities: arena, id, x, y, mass. One absorbs another that is alive if its mass is more than ratio times the other's and the
    other's centre lies within its radius (the root of its mass) less inset times the other's; its mass grows by the other's at once, so what it
    can absorb next depends on what came before. That is one sequence in an arena, whose entities are few; arenas are
    dealt to tasks by Spark.
    """

    def play(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        x, y, mass, alive = rows["x"].to_numpy(float), rows["y"].to_numpy(float), rows["mass"].to_numpy(float).copy(), np.ones(len(rows), bool)
        for i in range(len(rows)):
            j = 0
            while alive[i] and j < len(rows):
                # The next prey at or after j for the mass it has now.
                far = np.hypot(x[i] - x[j:], y[i] - y[j:]) - np.sqrt(mass[i]) + inset * np.sqrt(mass[j:])
                prey = alive[j:] & (mass[i] > ratio * mass[j:]) & (far < 0)
                if not prey.any():
                    break
                j += int(prey.argmax())
                mass[i], mass[j], alive[j] = mass[i] + mass[j], 0.0, False
                j += 1
        return pd.DataFrame({group: rows[group], "id": rows["id"], "mass": mass, "alive": alive})

    kinds = {c: entities.schema[c].dataType.simpleString() for c in (group, "id")}
    return entities.select(group, "id", "x", "y", "mass").groupBy(group).applyInPandas(play, f"{group} {kinds[group]}, id {kinds['id']}, mass double, alive boolean")


def stepped(bodies: DataFrame, seconds: Column, friction: float = 0.5, bound: float = 100.0) -> DataFrame:
    """Bodies (x, y, vx, vy) a step later: moved, slowed, kept within the bound and turned back there."""
    out = bodies
    for at, v in (("x", "vx"), ("y", "vy")):
        moved = F.col(at) + F.col(v) * seconds
        slowed = F.col(v) * (1.0 - F.lit(friction) * seconds)
        beyond = (moved < -bound) | (moved > bound)
        out = out.withColumns({at: F.greatest(F.least(moved, F.lit(bound)), F.lit(-bound)), v: F.when(beyond, -slowed).otherwise(slowed)})
    return out


def increments(current: DataFrame, deltas: DataFrame, key: str, value: str) -> DataFrame:
    """Current values plus the sums of deltas (key, value); keys on either side alone are kept."""
    return current.select(key, value).unionByName(deltas.select(key, value)).groupBy(key).agg(F.sum(value).alias(value))


def running_max(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("best", F.max(value).over(upto))


def expired(df: DataFrame, state: str, ts: str, ttl: dict[str, str], now: Column) -> DataFrame:
    """Rows past the time to live of their state, to be deleted; states without one stay."""
    late = F.lit(False)
    for name, interval in ttl.items():
        late = late | ((F.col(state) == name) & (F.col(ts) < now - F.expr(f"INTERVAL {interval}")))
    return df.filter(late)


#: Rows of a sample per bucket of `numbered`.
SAMPLE_PER_BUCKET = 50


def _bucket(bounds: Sequence[object], order: Column) -> Column:
    """How many of the sorted bounds are at most a value, by binary search; the value is worked out once, not at each step."""
    step, steps = 1, []
    while step <= len(bounds):
        steps, step = [step, *steps], 2 * step
    known = F.array(*[F.lit(b) for b in bounds])

    def narrowed(of: Column) -> Column:
        return F.aggregate(F.array(*[F.lit(n) for n in steps]), F.lit(0), lambda low, n: low + F.when(F.get(known, low + n - 1) <= of, n).otherwise(0))

    return F.transform(F.array(order), narrowed)[0]


def numbered(df: DataFrame, order: Column, name: str) -> DataFrame:
    """Every row with its place from 1 in the order of a column over the whole table, in two steps and never in one task.

    The bounds of the buckets come from a sample, and a row's bucket from its own value, so bounds weigh on the balance only.
    Places are ranks within a bucket plus the counts of the buckets before.
    """
    keyed = df.withColumn("_order", order)
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, SAMPLE_PER_BUCKET * buckets / max(df.count(), 1))
    sample = df.sample(share, 1).select(order.alias("_order")).dropna().orderBy("_order").collect()
    bounds = [sample[len(sample) * n // buckets][0] for n in range(1, buckets)] if sample else []
    placed = keyed.withColumn("_bucket", _bucket(bounds, F.col("_order")) if bounds else F.lit(0))
    counts, before = {r["_bucket"]: r["count"] for r in placed.groupBy("_bucket").count().collect()}, [0]
    for n in range(len(bounds)):
        before.append(before[-1] + counts.get(n, 0))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_order"))
    return placed.withColumn(name, (F.get(F.array(*[F.lit(n).cast("long") for n in before]), F.col("_bucket")) + rank).cast("long")).drop("_order", "_bucket")


#: How far from the wanted part the bounds of the range lie that `percentile_nearest` ranks, and the accuracy of those bounds.
NEAR, ACCURACY = 0.001, 10_000


def percentile_nearest(df: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """The value at place floor(p n), from 0, of n sorted ones (nulls first), by group; a group's values are never in one task.

    Values are counted, the counts of three ranges of each group summed, and only the range that holds the place is ranked. Its
    bounds are approximate percentiles; wherever they lie, the place is exact.
    """
    rows = df.select(F.col(group).alias("_group"), F.col(value).alias("_value"))
    counted = rows.groupBy("_group", "_value").agg(F.count("*").alias("_n"))
    bounds = rows.groupBy("_group").agg(F.percentile_approx("_value", [max(p - NEAR, 0.0), min(p + NEAR, 1.0)], ACCURACY).alias("_bounds")).withColumnRenamed("_group", "_of")
    within = F.coalesce(F.size(F.filter("_bounds", lambda b: b <= F.col("_value"))), F.lit(0))
    ranged = counted.join(bounds, counted["_group"].eqNullSafe(bounds["_of"])).select("_group", "_value", "_n", within.alias("_range"))
    one = Window.partitionBy("_group")
    sums = ranged.groupBy("_group", "_range").agg(F.sum("_n").alias("_n"))
    sums = sums.withColumns({"_before": F.sum("_n").over(one.orderBy("_range")) - F.col("_n"), "_all": F.sum("_n").over(one)})
    place = F.least(F.floor(F.lit(p) * F.col("_all")), F.col("_all") - 1)
    holds = sums.filter((F.col("_before") <= place) & (place < F.col("_before") + F.col("_n")))
    holds = holds.select(F.col("_group").alias("_of"), F.col("_range").alias("_held"), (place - F.col("_before")).alias("_at"))
    left = ranged.join(holds, ranged["_group"].eqNullSafe(holds["_of"]) & (ranged["_range"] == holds["_held"]))
    ranked = left.withColumn("_upto", F.sum("_n").over(one.orderBy("_value")))
    return ranked.filter((F.col("_upto") - F.col("_n") <= F.col("_at")) & (F.col("_at") < F.col("_upto"))).select(F.col("_group").alias(group), F.col("_value").alias("percentile"))


def _averages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For sorted rows (group, value): a group's average once its last row has passed. One number is carried across batches."""
    group, average, begun, schema = None, 0, False, None

    def told(groups: list, averages: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(groups, schema.field(0).type), pa.array(averages, pa.int64())], schema=schema)

    for batch in batches:
        schema = pa.schema([pa.field("_group", batch.schema.field(0).type), pa.field("_average", pa.int64())])
        done: tuple[list, list] = ([], [])
        for g, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if begun and g != group:
                done[0].append(group), done[1].append(average)
            if not begun or g != group:
                group, average, begun = g, 0, True
            average = None if average is None or x is None else (average * 9 + x) // 10
        yield told(*done)
    if begun:
        yield told([group], [average])


def moving_average(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """The exponential average (9 a + x) / 10 over a group's values in order, from 0, in whole numbers; null once a value is.

    Rows pass one by one, sorted by Spark, which spills; a group of any size costs one number of memory.
    """
    rows = df.select(F.col(group).alias("_group"), F.col(value).cast("long").alias("_value"), F.col(order).alias("_order"), F.col(value).alias("_tie"))
    sorted_ = rows.repartition("_group").sortWithinPartitions("_group", "_order", "_tie").select("_group", "_value")
    schema = T.StructType([T.StructField("_group", df.schema[group].dataType), T.StructField("_average", T.LongType())])
    return sorted_.mapInArrow(_averages, schema).toDF(group, "average")


def rekey(df: DataFrame, old: Sequence[Column], new: Sequence[Column]) -> DataFrame:
    """Two changes for each row whose key changes: the old key goes, the new one comes."""
    before, after = F.concat_ws(":", *old), F.concat_ws(":", *new)
    moved = df.withColumns({"_old": before, "_new": after}).filter("_old <> _new")
    gone = moved.select(F.col("_old").alias("key"), F.lit("DELETE").alias("op"))
    return gone.unionByName(moved.select(F.col("_new").alias("key"), F.lit("INSERT").alias("op")))
