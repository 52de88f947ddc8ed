"""Delivering changes: a consistent snapshot, then the log after it as a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.predicate import compile_typed
from ..functions.subscription import Subscription, matches, project, route, subscribe, subscribe_all
from ..sources.tables import ChangeTable


def stream(table: ChangeTable, start: int = 1, files_per_trigger: int | None = None) -> DataFrame:
    """The table's committed changes from commit `start` on; each commit is a folder that appears at once."""
    reader = table.spark.readStream.schema(table._log_schema).option("basePath", f"{table.path}/log")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{table.path}/log/seq=*/{table.name}").filter(F.col("seq") >= start)


def bootstrap(table: ChangeTable, subscription: Subscription, start: int | None = None, initial: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(rows as of the last commit that the subscription sees, changes after it as a stream, that commit): nothing twice or missed.

    With a start, the stream begins with that commit instead, whatever the rows hold. initial, if given, makes the first rows
    from the table's in place of the subscription's own filter.
    """
    at = table.latest()
    rows = table.read(at)
    if initial is not None:
        rows = initial(rows)
    elif subscription.where is not None:
        rows = rows.filter(compile_typed(subscription.where, table.schema))
    if subscription.columns is not None:
        rows = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in subscription.columns])
    changes = stream(table, at + 1 if start is None else start).filter(F.coalesce(matches(subscription, table.schema), F.lit(False)))
    return rows, project(subscription, changes, table.schema), at


def deliver(changes: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, every: str | None = None) -> StreamingQuery:
    """Hand each micro-batch to the sink with its number. Offsets are checkpointed, so a batch comes at least once."""
    writer = changes.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    return writer.start()


def exactly_once(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its number, replacing what a failed attempt left."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def routed(subscriptions: Sequence[Subscription], table: ChangeTable, name: str, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A sink for many subscriptions: one pass over the batch, a row for each match."""

    def write(batch: DataFrame, number: int) -> None:
        sink(route(batch.withColumn("table", F.lit(name)), subscriptions, table.schema), number)

    return write


class Subscriptions:
    """The subscriptions of a catalogue, kept as a change table of their own beside it: what they say, where they start and stand."""

    def __init__(self, spark, path: str):
        self._table = ChangeTable(spark, f"{path.rstrip('/')}-subscriptions", T.StructType.fromDDL("id string, sql string, table string, start long, acked long"), "id")

    def create(self, id: str, sql: str | None = None, start: int = 1) -> Subscription:
        """From a SELECT, or for all tables; raises ValueError for one that doesn't parse or is there already."""
        made = subscribe(id, sql) if sql else subscribe_all(id)
        if not self._table.get(id).isEmpty():
            raise ValueError(f"subscription {id!r} exists")
        spark = self._table.spark
        self._table.insert(spark.createDataFrame([(id, sql, made.table, start, start - 1)], self._table.schema))
        return made

    def get(self, id: str) -> Subscription:
        row = self._table.get(id).first()
        if row is None:
            raise KeyError(id)
        return subscribe(id, row["sql"]) if row["sql"] else subscribe_all(id)

    def list(self) -> DataFrame:
        return self._table.read()

    def delete(self, id: str) -> None:
        self._table.delete(F.col("id") == id)

    def acknowledge(self, acks: DataFrame) -> None:
        """acks (id, acked): each subscription moves forward only; unknown ones are passed over."""
        most = acks.groupBy("id").agg(F.max("acked").alias("to"))
        moved = self.list().join(most, "id").filter(F.col("to") > F.col("acked")).withColumn("acked", F.col("to")).drop("to")
        self._table.commit(moved.withColumn("op", F.lit("UPDATE")))

    def lag(self, latest: int) -> DataFrame:
        """(id, lag): commits that each has still to acknowledge."""
        return self.list().select("id", (F.lit(latest) - F.col("acked")).alias("lag"))

    def replay(self, id: str, table: ChangeTable) -> DataFrame:
        """The changes of a table from where the subscription starts, as it sees them."""
        row, s = self._table.get(id).first(), self.get(id)
        seen = table.log(row["start"]).withColumn("table", F.lit(table.name)).filter(F.coalesce(matches(s, table.schema, table="table"), F.lit(False)))
        return project(s, seen, table.schema)


def envelope(columns: Sequence[str] = ("table", "op", "seq", "key", "new_value", "old_value")) -> Column:
    """A change as JSON for filter and transform functions."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def filter_transform(events: DataFrame, keep: Callable | None = None, transform: Callable | None = None, tables: Sequence[str] = (), event: str = "event") -> DataFrame:
    """Events that a filter function keeps, transformed: functions are Columns of Column or Pandas UDFs over the JSON event.

    A filter that gives null drops the event; a transform that gives null leaves it as it was.
    """
    out = events.filter(F.col("table").isin(*tables)) if tables else events
    if keep:
        out = out.filter(F.coalesce(keep(F.col(event)), F.lit(False)))
    return out.withColumn(event, F.coalesce(transform(F.col(event)), F.col(event))) if transform else out
