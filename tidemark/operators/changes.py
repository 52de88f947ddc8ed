"""What a change log says: effective operations, before images, current state, versions, offsets and retention.

A log is a DataFrame with key, seq (unique, ascending), op (INSERT, UPDATE, DELETE) and value columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def effective(log: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Changes as they were applied, with old_value: deletes of absent keys drop out, an UPDATE of an absent key inserts it,
    and an INSERT on a present one replaces the row, keeping its name and carrying the old value."""
    order = Window.partitionBy(*keys).orderBy("seq")
    before = F.lag("op").over(order)
    marked = log.withColumns({"_before": before, "old_value": F.when(before != "DELETE", F.lag("value").over(order))})
    present = F.coalesce(F.col("_before") != "DELETE", F.lit(False))
    kept = marked.withColumn("_present", present).filter((F.col("op") != "DELETE") | F.col("_present"))
    op = F.when((F.col("op") == "UPDATE") & ~F.col("_present"), "INSERT").otherwise(F.col("op"))
    return kept.withColumns({"op": op, "new_value": F.when(F.col("op") != "DELETE", F.col("value"))}).drop("_before", "_present")


def current_state(log: DataFrame, keys: Sequence[str] = ("key",), at: int | None = None) -> DataFrame:
    """The last row of each key up to seq `at`, without deleted ones. An aggregate, so that each task sends one row a key."""
    upto = log if at is None else log.filter(F.col("seq") <= at)
    rest = [c for c in log.columns if c not in (*keys, "seq", "op")]
    last = upto.groupBy(*keys).agg(F.max(F.struct("seq", "op", *rest)).alias("last"))
    return last.filter("last.op <> 'DELETE'").select(*keys, *[F.col(f"last.{c}").alias(c) for c in ("seq", *rest)])


def row_versions(log: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Effective changes with version: updates since the key was last inserted into absence; 0 at that insert."""
    order = Window.partitionBy(*keys).orderBy("seq")
    lived = effective(log, keys)
    lives = lived.withColumn("_starts", (F.lag("op").over(order).isNull() | (F.lag("op").over(order) == "DELETE")).cast("int"))
    lives = lives.withColumn("_life", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    life = Window.partitionBy(*keys, "_life").orderBy("seq")
    return lives.withColumn("version", (F.row_number().over(life) - 1).cast("long")).drop("_starts", "_life")


def overlay(committed: DataFrame, staged: DataFrame, key: str = "key", deleted: str = "deleted") -> DataFrame:
    """Committed rows as a transaction sees them: staged rows replace or remove those of their key."""
    rest = committed.join(staged.select(key), key, "left_anti")
    return rest.unionByName(staged.filter(~F.col(deleted)).drop(deleted))


def resolve(changes: DataFrame, current: DataFrame, schema: T.StructType, key: str, missing: str = "error") -> DataFrame:
    """What changes (op and columns of schema) do to the current rows: key, op, old_value, new_value, as a log holds them.

    op UPSERT becomes UPDATE or INSERT, INSERT on a present key stays INSERT and carries the old row. The last of several
    changes of a key isn't known, so a key may change once; that raises ValueError. Deleting or updating an absent key raises
    KeyError, unless missing='ignore'. Nothing is written here.
    """
    cells = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in changes.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    new = changes.select(F.col(key).cast(schema[key].dataType).alias("key"), F.upper("op").alias("op"), F.struct(*cells).alias("new_value"))
    before = current.select(F.col(key).alias("key"), F.struct(*schema.names).alias("old_value"))
    both = new.join(before, "key", "left")
    absent = F.col("op").isin("DELETE", "UPDATE") & F.col("old_value").isNull()
    told = both.groupBy("key").agg(F.count("*").alias("n"), F.bool_or(absent).alias("absent")).filter("n > 1 or absent").agg(F.count_if(F.col("n") > 1).alias("twice"), F.count_if("absent").alias("absent")).first()
    if told["twice"]:
        raise ValueError("a key changes more than once in this commit")
    if told["absent"] and missing == "error":
        raise KeyError("a key to delete or update is absent")
    op = F.when(F.col("op") == "UPSERT", F.when(F.col("old_value").isNull(), "INSERT").otherwise("UPDATE")).otherwise(F.col("op"))
    return both.filter(~absent).select("key", op.alias("op"), "old_value", F.when(F.col("op") != "DELETE", F.col("new_value")).alias("new_value"))


def resume(snapshot: DataFrame, tail: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """State from a snapshot (keys, seq, values) and the log after it: the last writer wins."""
    return current_state(snapshot.withColumn("op", F.lit("INSERT")).unionByName(tail), keys)


def page(log: DataFrame, start: int, limit: int = 100) -> DataFrame:
    return log.filter(F.col("seq") >= start).orderBy("seq").limit(limit)


def kept_count(published: int, most: int) -> int:
    """Events that are left of `published` ones when more than `most` are trimmed to three quarters at once; most = 0: all."""
    if most <= 0 or published <= most:
        return published
    to = 3 * most // 4
    return to + (published - most - 1) % (most + 1 - to)


def retain_count(log: DataFrame, most: int) -> DataFrame:
    """The events still held: the last ones by seq. seq is gapless here, so a filter does, pushed to the files."""
    low, high = log.agg(F.min("seq"), F.max("seq")).first()
    if high is None:
        return log
    return log.filter(F.col("seq") > high - kept_count(high - low + 1, most))


def retain_time(log: DataFrame, column: str, interval: str) -> DataFrame:
    """Events not older than the interval before the latest one."""
    latest = log.agg(F.max(column).alias("latest")).first()["latest"]
    return log.filter(F.col(column) >= F.lit(latest) - F.expr(f"INTERVAL {interval}")) if latest is not None else log


def offsets(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.min("seq"), F.lit(0)).alias("oldest"), F.coalesce(F.max("seq"), F.lit(0)).alias("latest"))


def acknowledged(acks: DataFrame, group: str, offset: str) -> DataFrame:
    """Where each subscription stands: acknowledgements only move forward."""
    return acks.groupBy(group).agg(F.max(offset).alias("acked"))


def sizes(df: DataFrame, key: str) -> DataFrame:
    """Row count and bytes: 16 and the key a row, and for each column its name and value as text."""
    cells: Column = F.octet_length(F.col(key).cast("string")) + 16
    for c in df.columns:
        cells = cells + len(c.encode()) + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    return df.agg(F.count("*").alias("row_count"), F.coalesce(F.sum(cells.cast("long")), F.lit(0)).alias("size_bytes"))
