"""Subscriptions: which changes a client sees, and which columns of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .predicate import Junction, Test, compile_typed, parse, tokens

#: Predicates of one projection; more would outgrow what Spark compiles to one method.
CHUNK = 100


class Subscription(NamedTuple):
    id: str
    table: str | None  # None: all tables
    columns: tuple[str, ...] | None  # None: all columns
    where: Test | Junction | None


def subscribe(id: str, sql: str) -> Subscription:
    """From `SELECT columns FROM table [WHERE predicate]`; anything else raises ValueError."""
    read = tokens(sql)
    at = 0

    def take(kind: str, word: str | None = None) -> str:
        nonlocal at
        found, value, position = read[at]
        if found != kind or word and value.upper() != word:
            raise ValueError(f"expected {word or kind} at position {position} of {sql!r}")
        at += 1
        return value

    take("name", "SELECT")
    columns: list[str] | None = None
    if read[at][0] == "*":
        take("*")
    else:
        columns = [take("name")]
        while read[at][0] == ",":
            take(",")
            columns.append(take("name"))
    take("name", "FROM")
    table = take("name")
    where = None
    if read[at][0] != "end":
        take("name", "WHERE")
        where = parse(read[at:])
    return Subscription(id, table, None if columns is None else tuple(columns), where)


@dataclass(frozen=True)
class Builder:
    """A subscription put together step by step; start is the commit that its delivery begins with."""

    id: str
    table: str | None = None
    columns: tuple[str, ...] | None = None
    clause: str | None = None
    start: int | None = None

    def from_table(self, table: str) -> Builder:
        return replace(self, table=table)

    def select(self, *columns: str) -> Builder:
        return replace(self, columns=columns or None)

    def where(self, clause: str) -> Builder:
        """A further condition: all of them must hold."""
        return replace(self, clause=clause if self.clause is None else f"({self.clause}) AND ({clause})")

    def starting_at(self, commit: int) -> Builder:
        return replace(self, start=commit)

    def build(self) -> Subscription:
        if self.table is None and (self.columns or self.clause):
            raise ValueError("columns and conditions need a table")
        return Subscription(self.id, self.table, self.columns, None if self.clause is None else parse(self.clause))


def subscribe_all(id: str) -> Subscription:
    return Subscription(id, None, None, None)


def matches(subscription: Subscription, rows: T.StructType, op: str = "op", new: str = "new_value", old: str = "old_value", table: str | None = None) -> Column:
    """Whether an event matches: a DELETE by the row it removed, an UPDATE by the row before or after, others by the new row.

    new and old are struct columns with the fields of `rows`; table, if given, is the column that names the event's table.
    """
    here = F.lit(True) if table is None or subscription.table is None else F.col(table) == subscription.table
    if subscription.where is None:
        return here

    def holds(side: str) -> Column:
        return F.col(side).isNotNull() & F.coalesce(compile_typed(subscription.where, rows, lambda name: F.col(side)[name]), F.lit(False))

    return here & F.when(F.col(op) == "DELETE", holds(old)).when(F.col(op) == "UPDATE", holds(new) | holds(old)).otherwise(holds(new))


def project(subscription: Subscription, events: DataFrame, rows: T.StructType, sides: Sequence[str] = ("new_value", "old_value")) -> DataFrame:
    """The events with the subscribed columns of their rows; columns that the rows lack are null."""
    if subscription.columns is None:
        return events
    names = {f.name for f in rows}
    out = {s: F.when(F.col(s).isNotNull(), F.struct(*[(F.col(s)[c] if c in names else F.lit(None)).alias(c) for c in subscription.columns])) for s in sides}
    return events.withColumns(out)


_ORDERED = {">": True, ">=": True, "<": False, "<=": False}


def _simple(s: Subscription, rows: T.StructType) -> tuple[str, str, str] | None:
    """(column, operator, type) of a subscription whose predicate is one comparison of like types, else None."""
    if not isinstance(s.where, Test) or s.where.name not in rows.names or isinstance(s.where.value, bool) or s.where.op not in (*_ORDERED, "="):
        return None
    kind = rows[s.where.name].dataType
    if isinstance(kind, T.NumericType) and isinstance(s.where.value, int | float):
        return s.where.name, s.where.op, "double"
    return (s.where.name, s.where.op, "string") if isinstance(kind, T.StringType) and isinstance(s.where.value, str) else None


def _passed(own: Sequence[Subscription], op: str, type: str, value: Column) -> Column:
    """The ids of the subscriptions whose literal a value passes: sorted by literal, they are the first ones of a list."""
    sort = sorted(own, key=lambda s: s.where.value, reverse=not _ORDERED[op])
    limits = F.array(*[F.lit(s.where.value).cast(type) for s in sort])
    tests = {">": lambda t: value > t, ">=": lambda t: value >= t, "<": lambda t: value < t, "<=": lambda t: value <= t}
    n = F.when(value.isNull(), 0).otherwise(F.size(F.filter(limits, tests[op])))
    return F.slice(F.array(*[F.lit(s.id) for s in sort]), F.lit(1), n)


def route(events: DataFrame, subscriptions: Sequence[Subscription], rows: T.StructType, table: str = "table") -> DataFrame:
    """The events, once for each subscription that they match, with its id in `subscription`.

    All subscriptions are evaluated in one scan. Those without a predicate are looked up by table; comparisons of one column
    are a list sorted by literal, of which an event passes the first ones, or a map by value; other predicates are tested one
    by one, CHUNK at a time. An event that matches none makes no row; one that matches twice for a client makes two.
    """
    plain: dict[str | None, list[Subscription]] = {}
    simple: dict[tuple[str | None, str, str, str], list[Subscription]] = {}
    rest: dict[str | None, list[Subscription]] = {}
    for s in subscriptions:
        form = None if s.where is None else _simple(s, rows)
        group, at = (plain, s.table) if s.where is None else (simple, (s.table, *form)) if form else (rest, s.table)
        group.setdefault(at, []).append(s)
    ids = lambda own: F.array(*[F.lit(s.id) for s in own])
    nothing = F.array().cast("array<string>")
    of_table = lambda name, found: found if name is None else F.when(F.col(table) == name, found).otherwise(nothing)
    hits = [ids(plain.pop(None))] if None in plain else []
    if plain:
        by_name = F.create_map(*[x for name, own in plain.items() for x in (F.lit(name), ids(own))])
        hits.append(F.coalesce(F.try_element_at(by_name, F.col(table)), nothing))
    sides = {}
    for name, column, op, type in simple:
        for side in ("new_value", "old_value"):
            value = F.col(side)[column].cast(type)
            sides[f"_{side}_{column}"] = F.when(~F.isnan(value), value) if type == "double" else value
    for (name, column, op, type), own in simple.items():
        new, old = F.col(f"_new_value_{column}"), F.col(f"_old_value_{column}")
        if op == "=":
            by_value: dict[object, list[Subscription]] = {}
            for s in own:
                by_value.setdefault(float(s.where.value) if type == "double" else s.where.value, []).append(s)
            found = F.create_map(*[x for v, those in by_value.items() for x in (F.lit(v).cast(type), ids(those))])
            at = lambda v, found=found: F.coalesce(F.try_element_at(found, v), nothing)
            told = F.when(F.col("op") == "DELETE", at(old)).when(F.col("op") == "UPDATE", F.array_union(at(new), at(old))).otherwise(at(new))
        else:
            further = F.greatest if _ORDERED[op] else F.least  # nulls give way
            told = _passed(own, op, type, F.when(F.col("op") == "DELETE", old).when(F.col("op") == "UPDATE", further(new, old)).otherwise(new))
        hits.append(of_table(name, told))
    for name, own in rest.items():
        for at in range(0, len(own), CHUNK):
            found = F.array_compact(F.array(*[F.when(F.coalesce(matches(s, rows), F.lit(False)), F.lit(s.id)) for s in own[at : at + CHUNK]]))
            hits.append(of_table(name, found))
    found = F.concat(*hits) if hits else nothing
    # The outer form is planned without a test of the list's length first, which would evaluate every predicate twice.
    return events.withColumns(sides).withColumn("subscription", F.explode_outer(found)).filter(F.col("subscription").isNotNull()).drop(*sides)


def route_thresholds(events: DataFrame, thresholds: DataFrame, value: str = "value") -> DataFrame:
    """Events (with `value`) for each row (subscription, table, threshold) whose table is theirs and whose threshold they pass.

    For any number of subscriptions of this form: thresholds are a table too, and equal ones of a table are one row, so the
    join compares an event with distinct thresholds only.
    """
    distinct = thresholds.groupBy("table", "threshold").agg(F.collect_list("subscription").alias("subscriptions"))
    met = events.join(distinct, (events["table"] == distinct["table"]) & (events[value] > distinct["threshold"])).drop(distinct["table"])
    return met.withColumn("subscription", F.explode("subscriptions")).drop("subscriptions", "threshold")


def per_table(subscriptions: DataFrame) -> DataFrame:
    """(table_name, subscriptions) of rows with `table`; those of all tables (null) are counted under '*'."""
    return subscriptions.groupBy(F.coalesce("table", F.lit("*")).alias("table_name")).agg(F.count("*").cast("int").alias("subscriptions"))
