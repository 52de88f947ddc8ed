"""Commits of several tables, what survives a restart, the feed of all tables, and subscriptions kept beside it."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.subscription import Builder, matches, route, subscribe, subscribe_all
from tidemark.operators.reducers import INTERNAL, INVALID, OK, Module, Registry, newer
from tidemark.sources.tables import Catalog
from tidemark.streaming.delivery import Subscriptions, bootstrap, deliver

ONE = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
TWO = T.StructType([T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("seen", T.TimestampType())])


@pytest.fixture
def catalog(spark, tmp_path):
    made = Catalog(spark, f"file://{tmp_path}/db")
    made.create("a", ONE, "id")
    made.create("b", TWO, "name")
    return made


def rows(table):
    return sorted(tuple(r)[:2] for r in table.read().collect())


def test_all_tables_or_none(catalog):
    def both(ctx, fail):
        ctx.write("a", {"id": "x", "n": 1})
        if fail == "absent":
            ctx.delete("b", "nobody")
        elif fail == "kind":
            ctx.write("b", {"name": "y", "score": "no number"})
        else:
            ctx.write("b", {"name": "y", "score": 2.0})
        ctx.emit("made", "x", '{"by":"both"}')

    reg = Registry(catalog)
    reg.deploy(Module("m", "1", {"both": both}))
    assert reg.call("m", "both", "absent")[0] == INTERNAL and reg.call("m", "both", "kind")[0] == INTERNAL
    assert rows(catalog.table("a")) == rows(catalog.table("b")) == [] and catalog.latest() == 0 and catalog.feed().count() == 0
    assert reg.call("m", "both", "")[0] == OK
    assert rows(catalog.table("a")) == [("x", 1)] and rows(catalog.table("b")) == [("y", 2.0)] and catalog.latest() == 1
    assert sorted((r["table"], r["op"], r["key"], r["new_value"]) for r in catalog.feed().collect()) == [
        ("a", "INSERT", "x", '{"id":"x","n":1}'), ("b", "INSERT", "y", '{"name":"y","score":2.0,"seen":null}'), ("made", "EVENT", "x", '{"by":"both"}')]


def test_events_alone_are_published(catalog):
    reg = Registry(catalog)
    reg.deploy(Module("m", "1", {"say": lambda ctx: ctx.emit("t", "k", "p"), "odd": lambda ctx: ctx.write("nowhere", {"id": 1})}))
    assert reg.call("m", "say")[0] == OK and [tuple(r) for r in catalog.emitted().select("table", "op", "key", "new_value").collect()] == [("t", "EVENT", "k", "p")]
    assert reg.call("m", "odd")[0] == INVALID and catalog.latest() == 1


def test_a_set_and_rows_of_one_call(catalog, spark):
    def mixed(ctx):
        ctx.apply("a", spark.createDataFrame([("UPSERT", "p", 1), ("UPSERT", "q", 2)], "op string, id string, n long"))
        ctx.write("a", {"id": "q", "n": 5})
        ctx.result = sorted((r["id"], r["n"]) for r in ctx.rows("a").collect())

    reg = Registry(catalog)
    reg.deploy(Module("m", "1", {"mixed": mixed}))
    assert reg.call("m", "mixed")[:2] == (OK, [("p", 1), ("q", 5)]) and rows(catalog.table("a")) == [("p", 1), ("q", 5)]


def test_a_restart(catalog, spark):
    catalog.table("a").insert(spark.createDataFrame([("x", 1)], ONE))
    reg = Registry(catalog)
    reg.deploy(Module("m", "1.9", {"__init": lambda ctx: ctx.write("a", {"id": "init", "n": 0})}))
    again = Catalog(spark, catalog.path)
    assert again.tables() == ["a", "b"] and again.table("b").schema == TWO and rows(again.table("a")) == [("init", 0), ("x", 1)]
    later = Registry(again)
    later.deploy(Module("m", "1.9", {"__init": lambda ctx: ctx.write("a", {"id": "twice", "n": 0})}))  # given again: no hook
    assert rows(again.table("a")) == [("init", 0), ("x", 1)]
    with pytest.raises(ValueError):
        Registry(again).deploy(Module("m", "1.8", {}))
    seen = []
    Registry(again).deploy(Module("m", "1.10", {}, migrate=lambda ctx, old, new: seen.append((old, new))))
    assert seen == [("1.9", "1.10")] and newer("1.10", "1.9.9") and not newer("1.0", "1.0")
    for bad in ("", "a b", "x" * 65, "emitted.events"):
        with pytest.raises(ValueError):
            again.create(bad, ONE, "id")
    again.drop("a")
    again.create("a", ONE, "id")
    assert rows(again.table("a")) == [] and Catalog(spark, catalog.path).tables() == ["a", "b"]


def test_all_tables_then_their_feed(catalog, spark):
    catalog.table("a").insert(spark.createDataFrame([("x", 1)], ONE))
    first, at = catalog.subscribe_all()
    catalog.commit({"a": spark.createDataFrame([("DELETE", "x")], "op string, id string"), "b": spark.createDataFrame([("INSERT", "y", 1.0)], "op string, name string, score double")})
    assert [tuple(r) for r in first.collect()] == [("a", "x", '{"id":"x","n":1}')] and at == 1
    assert sorted((r["seq"], r["table"], r["op"]) for r in catalog.feed(at + 1).collect()) == [(2, "a", "DELETE"), (2, "b", "INSERT")]


def test_clients_come_and_go(catalog):
    hooks = {"__client_connected": lambda ctx: ctx.write("a", {"id": ctx.sender, "n": 1}), "__client_disconnected": lambda ctx: ctx.delete("a", ctx.sender)}
    reg = Registry(catalog)
    reg.deploy(Module("m", "1", hooks))
    reg.deploy(Module("none", "1", {}))
    assert reg.connect("me") == {"m": OK} and rows(catalog.table("a")) == [("me", 1)]
    assert reg.connect("me", gone=True) == {"m": OK} and rows(catalog.table("a")) == []


def test_deleted_rows_are_counted_and_rows_resume(catalog, spark):
    table = catalog.table("a")
    table.insert(spark.createDataFrame([(f"p{i}", i) for i in range(5)] + [("q", 9)], ONE))
    assert table.changed(table.delete(F.col("id").startswith("p"))) == 5
    b = catalog.table("b")
    b.insert(spark.createDataFrame([("old", 7.0, None)], TWO))
    now = spark.sql("SELECT * FROM VALUES ('old', 0D, TIMESTAMP '2024-01-01'), ('new', 1D, TIMESTAMP '2024-01-01') AS t(name, score, seen)")
    b.resume(now, ["seen"])
    assert sorted((r["name"], r["score"], r["seen"] is None) for r in b.read().collect()) == [("new", 1.0, False), ("old", 7.0, False)]


def test_subscriptions_are_kept(catalog, spark):
    table = catalog.table("a")
    for n in range(4):
        table.insert(spark.createDataFrame([(f"k{n}", n)], ONE))
    kept = Subscriptions(spark, catalog.path)
    kept.create("late", "SELECT id FROM a WHERE n >= 1", start=3)
    kept.create("every")
    with pytest.raises(ValueError):
        kept.create("late")
    with pytest.raises(ValueError):
        kept.create("bad", "SELECT * FROM a WHERE")
    again = Subscriptions(spark, catalog.path)
    assert again.get("late") == subscribe("late", "SELECT id FROM a WHERE n >= 1") and again.get("every") == subscribe_all("every")
    assert sorted((r["seq"], r["new_value"]["id"]) for r in again.replay("late", table).collect()) == [(3, "k2"), (4, "k3")] and again.replay("every", table).count() == 4
    again.acknowledge(spark.createDataFrame([("late", 4), ("late", 3), ("every", -5), ("nobody", 9)], "id string, acked long"))
    assert {r["id"]: r["lag"] for r in again.lag(4).collect()} == {"late": 0, "every": 4}
    again.delete("late")
    assert [r["id"] for r in kept.list().collect()] == ["every"]
    with pytest.raises(KeyError):
        kept.get("late")


def test_builder():
    made = Builder("s").from_table("t").where("x > 1").where("y = 2 OR y = 3").select("x", "y").starting_at(4)
    assert made.build() == subscribe("s", "SELECT x, y FROM t WHERE (x > 1) AND (y = 2 OR y = 3)") and made.start == 4 and Builder("all").build() == subscribe_all("all")
    with pytest.raises(ValueError):
        Builder("s").where("x > 1").build()


def test_start_and_first_rows(catalog, spark, tmp_path):
    table = catalog.table("a")
    for n in range(3):
        table.insert(spark.createDataFrame([(f"k{n}", n)], ONE))
    first, changes, at = bootstrap(table, subscribe("s", "SELECT * FROM a WHERE n > 0"), start=2, initial=lambda df: df.filter("n = 0"))
    got = []
    deliver(changes, lambda b, n: got.extend(r["key"] for r in b.collect()), f"file://{tmp_path}/check", once=True).awaitTermination()
    assert [r["id"] for r in first.collect()] == ["k0"] and at == 3 and sorted(got) == ["k1", "k2"]


def test_routing_is_matching(spark):
    schema = T.StructType.fromDDL("x int, v double, s string, b boolean")
    row = "struct<x:int,v:double,s:string,b:boolean>"
    values = [(1, 1.5, "a", True), (2, float("nan"), "b", None), (None, -3.0, None, False), (5, None, "", True), (9007199, 2.0, "zz", False)]
    events = [(n, op, table, new, old) for n, (op, table, new, old) in enumerate((op, table, new, old) for op in ("INSERT", "UPDATE", "DELETE", "EVENT") for table in ("t", "u") for new in [*values, None] for old in [None, values[0], values[2], values[4]])]
    df = spark.createDataFrame(events, f"seq int, op string, table string, new_value {row}, old_value {row}")
    clauses = [f"{c} {op} {v}" for c, v in (("x", "2"), ("x", "1.5"), ("v", "2"), ("v", "-3"), ("s", "'b'"), ("s", "''"), ("x", "'a'"), ("none", "1"), ("b", "true")) for op in ("=", "!=", "<", "<=", ">", ">=")] + ["NOT x > 1", "x > 1 AND v > 1", "s IS NULL", "s LIKE 'z%'"]
    subs = [subscribe(f"{n}{t}", f"SELECT * FROM {t} WHERE {c}") for n, c in enumerate(clauses) for t in "tu"] + [subscribe("plain", "SELECT * FROM u"), subscribe_all("all"), subscribe("none", "SELECT * FROM w")]
    got = {}
    routed = route(df, subs, schema)
    assert routed.columns == [*df.columns, "subscription"]
    for r in routed.collect():
        got.setdefault(r["subscription"], []).append(r["seq"])
    one = df.select("seq", *[F.coalesce(matches(s, schema, table="table"), F.lit(False)).alias(s.id) for s in subs]).collect()
    for s in subs:
        assert sorted(got.get(s.id, [])) == [r["seq"] for r in one if r[s.id]], s
