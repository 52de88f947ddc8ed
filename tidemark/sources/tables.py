"""Tables as one append-only Parquet change log with snapshots, in any store that Spark reads.

    <folder>/log/seq=<n>/<table>/           the changes of commit n to a table: key, op, old_value, new_value
    <folder>/log/seq=<n>/emitted.events/    what reducers emitted with it: topic, key, payload
    <folder>/snapshots/<table>/upto=<n>/    a table's state after commit n
    <folder>/tables/<table>.json            its schema and key

What a commit does to its tables is a DataFrame (see changes.resolve); it is written beside the log by Spark and moved into it
by one rename, so that readers see the changes of all its tables or none. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.render import render_changefeed, valid_name
from ..operators.changes import resolve

DEFAULT_SCAN = 1000
EVENTS = "emitted.events"
_EVENT = T.StructType([T.StructField(c, T.StringType()) for c in ("topic", "key", "payload")])


class _Folder:
    """Files of a store through Hadoop's own interface: listing, renaming and small texts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def at(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def names(self, folder: str) -> list[str]:
        fs, p = self.at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def numbers(self, folder: str) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self.names(folder) if "=" in n)

    def found(self, pattern: str) -> list[str]:
        fs, p = self.at(pattern)
        return [s.getPath().toString() for s in fs.globStatus(p) or ()]

    def move(self, source: str, target: str) -> None:
        fs, p = self.at(target)
        fs.mkdirs(p.getParent())
        if fs.exists(p) or not fs.rename(self.at(source)[1], p):
            self.remove(source)
            raise RuntimeError(f"{p} is there already: another writer committed")

    def remove(self, name: str) -> None:
        fs, p = self.at(name)
        fs.delete(p, True)

    def put(self, name: str, text: str) -> None:
        fs, p = self.at(name)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def text(self, name: str) -> str:
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0]


def publish(folder: _Folder, tables: dict[str, DataFrame]) -> int:
    """Write the changes of all tables, and make them one commit; its number."""
    staged = f"_staged-{uuid.uuid4().hex}"
    try:
        for name, rows in tables.items():
            rows.write.parquet(f"{folder.path}/{staged}/{name}")
        number = max([0, *folder.numbers("log"), *(n for t in folder.names("snapshots") for n in folder.numbers(f"snapshots/{t}"))]) + 1
        folder.move(staged, f"log/seq={number}")
        return number
    except Exception:
        folder.remove(staged)
        raise


class ChangeTable:
    """Rows of `schema`, whose column `key` names them. Writes are Spark jobs over whole change sets, not row by row."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, name: str = "rows"):
        self.spark, self.path, self.schema, self.key, self.name = spark, path.rstrip("/"), schema, key, name
        if key not in schema.names:
            raise ValueError(f"no column {key!r}")
        self._folder = _Folder(spark, path)
        self._log_schema = T.StructType([T.StructField("key", schema[key].dataType), T.StructField("op", T.StringType()), T.StructField("old_value", schema), T.StructField("new_value", schema), T.StructField("seq", T.LongType())])

    def latest(self) -> int:
        return max([0, *self._folder.numbers("log"), *self._folder.numbers(f"snapshots/{self.name}")])

    def log(self, start: int = 1) -> DataFrame:
        """Changes from commit `start` on; commits before are pruned by folder."""
        if not self._folder.found(f"log/seq=*/{self.name}"):
            return self.spark.createDataFrame([], self._log_schema)
        reader = self.spark.read.schema(self._log_schema).option("basePath", f"{self.path}/log")
        return reader.parquet(f"{self.path}/log/seq=*/{self.name}").filter(F.col("seq") >= start)

    def read(self, at: int | None = None) -> DataFrame:
        """The state after commit `at` (default: the last): the nearest snapshot before it, and the log since."""
        upto = [n for n in self._folder.numbers(f"snapshots/{self.name}") if at is None or n <= at]
        base = max(upto, default=0)
        tail = self.log(base + 1) if at is None else self.log(base + 1).filter(F.col("seq") <= at)
        last = tail.groupBy("key").agg(F.max_by(F.struct("op", "new_value"), "seq").alias("last"))
        fresh = last.filter("last.op <> 'DELETE'").select("last.new_value.*")
        if not base:
            return fresh.select(*self.schema.names)
        old = self.spark.read.schema(self.schema).parquet(f"{self.path}/snapshots/{self.name}/upto={base}")
        return old.join(last, old[self.key] == last["key"], "left_anti").unionByName(fresh)

    def resolved(self, changes: DataFrame, missing: str = "error") -> DataFrame:
        """What the changes do to the table as it is, checked; see changes.resolve."""
        return resolve(changes, self.read(), self.schema, self.key, missing)

    def commit(self, changes: DataFrame, missing: str = "error") -> int:
        """Append the changes (op and the columns of schema; for DELETE only the key matters) as one commit; its number."""
        return publish(self._folder, {self.name: self.resolved(changes, missing)})

    def insert(self, rows: DataFrame) -> int:
        return self.commit(rows.withColumn("op", F.lit("INSERT")))

    def update(self, where: Column, assign: dict[str, Column]) -> int:
        """The rows that match, with the assigned columns changed."""
        return self.commit(self.read().filter(where).withColumns(assign).withColumn("op", F.lit("UPDATE")))

    def delete(self, where: Column) -> int:
        return self.commit(self.read().filter(where).withColumn("op", F.lit("DELETE")))

    def changed(self, number: int) -> int:
        """How many rows commit `number` changed."""
        return self.log(number).filter(F.col("seq") == number).count()

    def resume(self, rows: DataFrame, fresh: Sequence[str]) -> int:
        """Insert the rows whose key is absent; of present ones the columns `fresh` alone take the new values."""
        now = self.read()
        old = now.select(F.col(self.key).alias("_key"), F.struct(*now.columns).alias("_old"))
        met = rows.join(old, rows[self.key] == old["_key"], "left")
        cells = [rows[c] if c == self.key or c in fresh else F.when(F.col("_old").isNull(), rows[c]).otherwise(F.col("_old")[c]).alias(c) for c in self.schema.names]
        return self.commit(met.select(F.lit("UPSERT").alias("op"), *cells))

    def snapshot(self) -> int:
        """Write the state as of now; later reads start there. Logs stay until trim()."""
        number = self.latest()
        if number and number not in self._folder.numbers(f"snapshots/{self.name}"):
            staged = f"_staged-{uuid.uuid4().hex}"
            self.read(number).write.parquet(f"{self.path}/{staged}")
            self._folder.move(staged, f"snapshots/{self.name}/upto={number}")
        return number

    def trim(self) -> None:
        """Drop commits that the last snapshot holds."""
        held = max(self._folder.numbers(f"snapshots/{self.name}"), default=0)
        for n in self._folder.numbers("log"):
            if n <= held:
                self._folder.remove(f"log/seq={n}/{self.name}")

    def drop(self) -> None:
        for n in self._folder.numbers("log"):
            self._folder.remove(f"log/seq={n}/{self.name}")
        self._folder.remove(f"snapshots/{self.name}")

    # Scans: filters and limits that Spark pushes to the files.
    def get(self, key) -> DataFrame:
        return scan_point(self.read(), self.key, key)

    def scan(self, start=None, end=None) -> DataFrame:
        return scan_range(self.read(), self.key, start, end)

    def prefix(self, prefix: str, limit: int = 0) -> DataFrame:
        return scan_prefix(self.read(), self.key, prefix, limit)


def scan_range(df: DataFrame, key: str, start=None, end=None) -> DataFrame:
    """Keys from start to end, both included; None is unbounded."""
    out = df if start is None else df.filter(F.col(key) >= start)
    return out if end is None else out.filter(F.col(key) <= end)


def scan_prefix(df: DataFrame, key: str, prefix: str, limit: int = 0) -> DataFrame:
    """The first rows by key whose key begins so; limit <= 0 stands for DEFAULT_SCAN."""
    return df.filter(F.col(key).startswith(prefix)).orderBy(key).limit(limit if limit > 0 else DEFAULT_SCAN)


def scan_point(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == value)


def as_json(rows: DataFrame, name: str, key: str) -> DataFrame:
    """(table, key, value): a table's rows as they look in a snapshot of all tables."""
    return rows.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("key"), render_changefeed(rows.schema).alias("value"))


def all_rows(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table, key, value) of all tables, given as (rows, key column) by name."""
    out = None
    for name, (rows, key) in tables.items():
        one = as_json(rows, name, key)
        out = one if out is None else out.unionByName(one)
    return out


class Catalog:
    """Tables by name in one folder, with one log for all of them: a commit may change several, and its number is theirs."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._folder = _Folder(spark, path)

    def create(self, name: str, schema: T.StructType, key: str) -> ChangeTable:
        if not valid_name(name):
            raise ValueError(f"no name for a table: {name!r}")
        if name in self.tables():
            raise ValueError(f"table {name!r} exists")
        table = ChangeTable(self.spark, self.path, schema, key, name)
        self._folder.put(f"tables/{name}.json", json.dumps({"key": key, "schema": schema.jsonValue()}))
        return table

    def table(self, name: str) -> ChangeTable:
        if name not in self.tables():
            raise KeyError(name)
        known = json.loads(self._folder.text(f"tables/{name}.json"))
        return ChangeTable(self.spark, self.path, T.StructType.fromJson(known["schema"]), known["key"], name)

    def tables(self) -> list[str]:
        return [n.removesuffix(".json") for n in self._folder.names("tables") if n.endswith(".json")]

    def drop(self, name: str) -> None:
        table = self.table(name)
        self._folder.remove(f"tables/{name}.json")
        table.drop()

    def commit(self, changes: dict[str, DataFrame], events: Sequence[tuple[str, str, str]] = (), missing: str = "error") -> int:
        """Changes of several tables, and events (topic, key, payload), as one commit: all are checked before any is written."""
        parts = {name: self.table(name).resolved(rows, missing) for name, rows in changes.items()}
        if events:
            parts[EVENTS] = self.spark.createDataFrame(list(events), _EVENT)
        return publish(self._folder, parts) if parts else self.latest()

    def latest(self) -> int:
        return max([0, *self._folder.numbers("log")])

    def emitted(self, start: int = 1) -> DataFrame:
        """Emitted events as changes: op EVENT, the topic in the table's place, the payload as the new value."""
        schema = T.StructType([*_EVENT, T.StructField("seq", T.LongType())])
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/log")
        there = self._folder.found(f"log/seq=*/{EVENTS}")
        rows = reader.parquet(f"{self.path}/log/seq=*/{EVENTS}") if there else self.spark.createDataFrame([], schema)
        nothing = F.lit(None).cast("string")
        return rows.filter(F.col("seq") >= start).select("seq", F.col("topic").alias("table"), F.lit("EVENT").alias("op"), "key", nothing.alias("old_value"), F.col("payload").alias("new_value"))

    def feed(self, start: int = 1) -> DataFrame:
        """The changes of all tables and the emitted events from commit `start` on: seq, table, op, key, old_value and new_value as JSON."""
        out = self.emitted(start)
        for name in self.tables():
            t = self.table(name)
            side = lambda c, t=t: F.when(F.col(c).isNotNull(), render_changefeed(t.schema, lambda n: F.col(c)[n])).alias(c)  # noqa: B023, E731
            out = out.unionByName(t.log(start).select("seq", F.lit(name).alias("table"), "op", F.col("key").cast("string").alias("key"), side("old_value"), side("new_value")))
        return out

    def subscribe_all(self) -> tuple[DataFrame | None, int]:
        """(rows of all tables as of the last commit, None without tables; its number): the feed from the next number on follows them."""
        at = self.latest()
        return all_rows({name: (self.table(name).read(at), self.table(name).key) for name in self.tables()}), at

    def versions(self) -> dict[str, str]:
        """Versions of the modules that are deployed, by name."""
        return json.loads(self._folder.text("modules.json")) if self._folder.found("modules.json") else {}

    def keep_version(self, name: str, version: str | None) -> None:
        self._folder.put("modules.json", json.dumps({k: v for k, v in (self.versions() | {name: version}).items() if v}))

    def sql(self, query: str) -> DataFrame:
        """Any SELECT of Spark over the tables' current rows; names in it are the tables'."""
        for name in self.tables():
            self.table(name).read().createOrReplaceTempView(name)
        return self.spark.sql(query)
