"""Helpers shared by the operators of this package."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where none is set, a temporary one in local mode, as in tests; a
    cluster has no such folder, so there it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and lost executors lose nothing.

    The table goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = until_exit(spark, f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def until_exit(spark: SparkSession, path: str) -> str:
    """The path, marked to be deleted when the driver's JVM ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table given in the program, as one literal that the JVM reads."""
    names = [f.split()[0] for f in schema.split(",")]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':').replace(',:', ', ')}>>")))


def stable_bits(value: Column, digits: int = 15, salt: str = "") -> Column:
    """A non-negative long of 4 * digits bits that depends on nothing but the value (null: as empty) and the salt."""
    text = F.concat(F.lit(salt), F.coalesce(value.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


#: Rows up to which a materialised table of a few narrow columns is sent to all executors.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A materialised table, marked for broadcasting if it is known to be small; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= rows else df
