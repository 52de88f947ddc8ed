"""The training-data pipeline over `documents`; see STAGES.

Every stage reads all rows and whole texts of its predecessor's table and keeps extra columns. A null text is handled as an
empty one, null ids and repeated rows pass through as said at each stage, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import materialise, table
from tidemark.llm.decontamination import drop_contaminated
from tidemark.llm.mixing import mix_documents
from tidemark.llm.neardup import keep_one
from tidemark.llm.sharding import assign_shards
from tidemark.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that score below 0.5; the score is learnt from `labels` and the texts of docs. Null and empty texts stay,
    with or without a doc_id; repeated rows share their fate."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: the first by doc_id, null ids last. Of repeated rows, and of empty and null texts
    together, one stays."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs without an item of `benchmark`, whether they have a doc_id or not; clean rows that share the id of a
    contaminated one stay, as do texts of fewer than five words."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), nameless=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, three times at most. A null source is one of its own; rows without words
    count nothing."""
    return mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard and a slot for every row of docs; repeated rows get a slot each, null ids share a shard."""
    return assign_shards(docs)


STAGES = [("toxicity", toxicity), ("neardup", neardup), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: SQL can't express the fitted toxicity score and the sketches.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs
