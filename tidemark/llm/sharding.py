"""Jump consistent hashing: stable keys to shards without a ring table (DataFrame operations only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, stable_bits, table

N_SHARDS = 40
#: Slots are numbered within (shard, bucket) and offset by the buckets before, so no task sees a whole shard.
BUCKETS = 1024
#: The multiplier of the published algorithm's 64-bit congruential generator.
MULTIPLIER = 2862933555777941757


def _next_key(key: list[Column]) -> list[Column]:
    """key * MULTIPLIER + 1 modulo 2^64 on 16-bit limbs, lowest first: no product or sum leaves a signed long."""
    m = [(MULTIPLIER >> (16 * i)) & 0xFFFF for i in range(4)]
    out, carry = [], F.lit(1).cast("long")
    for n in range(4):
        total = carry
        for i in range(n + 1):
            total = total + key[i] * F.lit(m[n - i]).cast("long")
        out.append(total.bitwiseAND(F.lit(0xFFFF).cast("long")))
        carry = F.shiftright(total, 16)
    return out


def jump_hash(key: Column, n_shards: int) -> Column:
    """struct(shard, next): the shard of a non-negative long among n_shards, and where one more shard could take it.

    A key jumps through growing shard counts; `shard` is the last jump below n_shards and `next` the first one not
    below it. With n_shards + 1 shards the key is therefore in n_shards if next = n_shards, else where it was.
    A key makes about ln(n_shards) jumps; the bound on steps is n_shards itself or a number that no key reaches.
    """
    steps = min(n_shards, 64 + math.ceil(12 * math.log(max(n_shards, 2))))
    limbs = [F.shiftrightunsigned(key, 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long")) for i in range(4)]
    start = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(limbs)], F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(s: Column, _: Column) -> Column:
        k = _next_key([s[f"k{i}"] for i in range(4)])
        top31 = F.shiftleft(k[3], 15) + F.shiftright(k[2], 1)
        j = F.floor((s["j"] + 1) * (F.lit(float(1 << 31)) / (top31 + 1).cast("double")))
        return F.when(s["j"] < n_shards, F.struct(*[x.alias(f"k{i}") for i, x in enumerate(k)], s["j"].alias("b"), j.alias("j"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), start, step, lambda s: F.struct(s["b"].cast("int").alias("shard"), s["j"].alias("next")))


def assign_shards(docs: DataFrame, n_shards: int = N_SHARDS, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    law is always `key`: the key and the shard count decide, and one more shard takes rows only into itself.
    size is the text's UTF-8 bytes plus 16, text_crc32 the unsigned CRC-32 of those bytes, slot numbers a shard's rows
    from 0 without gaps. A null text counts as no bytes (size 16, CRC 0); null keys share one shard; repeated rows keep
    a slot each; an empty table gives no rows; other columns are ignored.

    Rows alike in all output columns are counted before the shuffle, so a text held by a third of the rows is one row
    until the slots are known, and different texts under one key fall into different buckets. What is shuffled has no text in
    it, so texts may be of any length.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), stable_bits(F.col(key)).alias("bits")
    )
    alike = rows.groupBy("doc_id", "size", "text_crc32", "bits").agg(F.count("*").alias("n"))
    placed = alike.withColumn("at", jump_hash(F.col("bits"), n_shards)).select(
        "doc_id", "size", "text_crc32", "n", F.col("at.shard").alias("shard"),
        F.when(F.col("at.next") == n_shards, F.lit(n_shards)).otherwise(F.col("at.shard")).alias("grown_shard"), F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)).cast("int").alias("bucket"),
    )
    placed = materialise(placed, "shards")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, ["shard", "bucket"])
    return numbered.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("first") + F.col("copy")).alias("slot"), "grown_shard"
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))
