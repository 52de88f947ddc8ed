import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.render import render_changefeed, render_initial_state, render_module
from tidemark.functions.subscription import matches, project, route, subscribe, subscribe_all
from tidemark.operators.changes import kept_count
from tidemark.operators.reducers import DENIED, INTERNAL, NO_HANDLER, OK, Module, Refused, Registry
from tidemark.sources.tables import Catalog, ChangeTable
from tidemark.streaming.delivery import bootstrap, deliver, exactly_once, filter_transform, routed, stream

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("balance", T.DoubleType())])


@pytest.fixture
def accounts(spark, tmp_path):
    table = ChangeTable(spark, f"file://{tmp_path}/accounts", SCHEMA, "id")
    table.insert(spark.createDataFrame([("a", 1.0), ("b", 2.0), ("ca", 3.0)], SCHEMA))
    return table


def state(table, at=None):
    return {r["id"]: r["balance"] for r in table.read(at).collect()}


def test_commits_states_and_snapshots(spark, accounts):
    assert accounts.update(F.col("id") == "a", {"balance": F.col("balance") + 10}) == 2
    assert accounts.delete(F.col("id") == "b") == 3
    assert accounts.insert(spark.createDataFrame([("a", 5.0)], SCHEMA)) == 4
    assert state(accounts) == {"a": 5.0, "ca": 3.0} and state(accounts, 2) == {"a": 11.0, "b": 2.0, "ca": 3.0}
    last = accounts.log(4).first()
    assert last["op"] == "INSERT" and last["old_value"]["balance"] == 11.0
    assert accounts.snapshot() == 4
    accounts.trim()
    assert state(accounts) == {"a": 5.0, "ca": 3.0}
    accounts.commit(spark.createDataFrame([("UPSERT", "z", 1.0), ("UPSERT", "a", 6.0)], "op string, id string, balance double"))
    assert state(accounts) == {"a": 6.0, "ca": 3.0, "z": 1.0} and {r["op"] for r in accounts.log(5).collect()} == {"INSERT", "UPDATE"}


def test_failed_commits_write_nothing(spark, accounts):
    gone = spark.createDataFrame([("DELETE", "a", None), ("DELETE", "nobody", None)], "op string, id string, balance double")
    with pytest.raises(KeyError):
        accounts.commit(gone)
    with pytest.raises(ValueError):
        accounts.insert(spark.createDataFrame([("x", 1.0), ("x", 2.0)], SCHEMA))
    assert accounts.latest() == 1 and len(state(accounts)) == 3
    accounts.commit(gone, missing="ignore")
    assert set(state(accounts)) == {"b", "ca"}


def test_scans(accounts):
    ids = lambda df: [r["id"] for r in df.collect()]
    assert sorted(ids(accounts.scan("a", "b"))) == ["a", "b"] and ids(accounts.prefix("c")) == ["ca"] and ids(accounts.prefix("", 2)) == ["a", "b"] and ids(accounts.get("b")) == ["b"]


def test_subscription_rules(spark):
    row = "struct<x:int>"
    events = spark.createDataFrame([(1, "INSERT", (5,), None), (2, "UPDATE", (1,), (5,)), (3, "UPDATE", (1,), (2,)), (4, "DELETE", None, (5,)), (5, "DELETE", None, None), (6, "EVENT", (9,), None)], f"seq int, op string, new_value {row}, old_value {row}").withColumn("table", F.lit("t"))
    schema = T.StructType([T.StructField("x", T.IntegerType())])
    seen = lambda s: [r["seq"] for r in events.filter(matches(s, schema, table="table")).orderBy("seq").collect()]
    assert seen(subscribe("s", "SELECT * FROM t WHERE x > 4")) == [1, 2, 4, 6] and seen(subscribe("s", "SELECT * FROM other")) == [] and seen(subscribe_all("s")) == [1, 2, 3, 4, 5, 6]
    assert seen(subscribe("s", "select x from t where NOT (y = 1)")) == [1, 2, 3, 4, 6]
    shown = project(subscribe("s", "SELECT x, none FROM t"), events, schema).orderBy("seq").first()
    assert shown["new_value"].asDict() == {"x": 5, "none": None} and shown["old_value"] is None
    both = route(events, [subscribe("p", "SELECT * FROM t WHERE x = 5"), subscribe("q", "SELECT * FROM t"), subscribe("r", "SELECT * FROM u")], schema)
    assert sorted((r["seq"], r["subscription"]) for r in both.collect()) == [(1, "p"), (1, "q"), (2, "p"), (2, "q"), (3, "q"), (4, "p"), (4, "q"), (5, "q"), (6, "q")]
    for bad in ("SELECT * FROM t;", "SELECT * FROM t ORDER BY x", "SELECT * FROM t JOIN u", "UPDATE t"):
        with pytest.raises(ValueError):
            subscribe("s", bad)


def test_stream_starts_after_the_snapshot(spark, accounts, tmp_path):
    rows, changes, at = bootstrap(accounts, subscribe("s", "SELECT id, balance FROM t WHERE balance >= 2"))
    assert at == 1 and {r["id"] for r in rows.collect()} == {"b", "ca"}
    accounts.update(F.col("id") == "a", {"balance": F.lit(9.0)})
    accounts.update(F.col("id") == "ca", {"balance": F.lit(0.0)})
    accounts.insert(spark.createDataFrame([("d", 1.0)], SCHEMA))
    deliver(changes, exactly_once(f"file://{tmp_path}/out"), f"file://{tmp_path}/check", once=True).awaitTermination()
    assert sorted((r["seq"], r["key"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [(2, "a"), (3, "ca")]
    got = []
    sink = routed([subscribe("p", "SELECT * FROM t WHERE balance > 5"), subscribe("q", "SELECT * FROM t")], accounts, "t", lambda b, n: got.extend((r["subscription"], r["key"]) for r in b.collect()))
    deliver(stream(accounts, 2), sink, f"file://{tmp_path}/check2", once=True).awaitTermination()
    assert sorted(got) == [("p", "a"), ("q", "a"), ("q", "ca"), ("q", "d")]


def test_filter_and_transform(spark):
    events = spark.createDataFrame([("t", '{"k":1}'), ("t", '{"k":2}'), ("u", "{}")], "table string, event string")
    k = lambda e: F.get_json_object(e, "$.k").cast("int")
    out = filter_transform(events, keep=lambda e: k(e) >= 1, transform=lambda e: F.when(k(e) == 2, "two"))
    assert sorted(r["event"] for r in out.collect()) == ["two", '{"k":1}']
    assert filter_transform(events, tables=["u"]).count() == 1


def test_reducers(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/db")
    catalog.create("accounts", SCHEMA, "id")

    def move(ctx, a, b, amount):
        for name, by in ((a, -amount), (b, amount)):
            row = ctx.read("accounts", name) or {"id": name, "balance": 0.0}
            ctx.write("accounts", row | {"balance": row["balance"] + by})
        if ctx.read("accounts", a)["balance"] < 0:
            return -7
        ctx.emit("moved", a, str(amount))
        ctx.result = ctx.new_id() > ctx.now_ms
        return 0

    def seen(ctx):
        ctx.write("accounts", {"id": "tmp", "balance": 1.0})
        ctx.delete("accounts", "a")
        ctx.result = sorted(r["id"] for r in ctx.scan("accounts").collect())
        raise_after = ctx.result
        ctx.staged.clear()
        return raise_after and 0

    def fail(ctx):
        ctx.write("accounts", {"id": "x", "balance": 1.0})
        raise RuntimeError

    def refuse(ctx):
        raise Refused(-9, "no")

    def init(ctx):
        ctx.write("accounts", {"id": "a", "balance": 100.0})

    def bulk(ctx):
        ctx.apply("accounts", ctx.rows("accounts").withColumns({"balance": F.col("balance") * 2, "op": F.lit("UPSERT")}))

    reg = Registry(catalog)
    reg.deploy(Module("bank", "1.9", {"move": move, "seen": seen, "fail": fail, "refuse": refuse, "__init": init, "bulk": bulk}))
    table = catalog.table("accounts")
    assert state(table) == {"a": 100.0}
    status, result, events = reg.call("bank", "move", "a", "b", 30.0)
    assert (status, result, events) == (OK, True, [("moved", "a", "30.0")]) and state(table) == {"a": 70.0, "b": 30.0}
    assert reg.call("bank", "move", "a", "b", 300.0)[0] == -7 and reg.call("bank", "fail")[0] == INTERNAL and reg.call("bank", "refuse")[0] == -9
    assert state(table) == {"a": 70.0, "b": 30.0} and reg.call("bank", "seen")[1] == ["b", "tmp"]
    assert reg.call("bank", "nothing")[0] == NO_HANDLER and reg.call("bank", "__init")[0] == NO_HANDLER
    assert reg.call("bank", "bulk")[0] == OK and state(table) == {"a": 140.0, "b": 60.0}
    with pytest.raises(ValueError):
        reg.deploy(Module("bank", "1.9", {}))
    reg.deploy(Module("bank", "1.10", {"move": move}, read_only=True))
    assert reg.call("bank", "move", "a", "b", 1.0)[0] == DENIED and reg.modules() == {"bank": "1.10"}
    assert catalog.sql("SELECT sum(balance) AS s FROM accounts").first()["s"] == 200.0
    reg.undeploy("bank")
    catalog.drop("accounts")
    assert catalog.tables() == []


def test_retention_closed_form():
    for most in (1, 4, 7, 10):
        held = 0
        for n in range(1, 60):
            held += 1
            if held > most:
                held = 3 * most // 4
            assert kept_count(n, most) == held
    assert kept_count(99, 0) == 99


def test_renderings(spark):
    df = spark.sql("SELECT 1 AS i, X'00FF' AS b, TIMESTAMP '2024-01-01 00:00:01.5' AS t, double('NaN') AS x")
    row = df.select(render_changefeed(df.schema).alias("c"), render_module(df.schema).alias("m"), render_initial_state(df.schema).alias("s")).first()
    assert row["c"] == '{"i":1,"b":"AP8=","t":null,"x":null}' and row["m"] == '{"i":1,"b":{"$bytes":"AP8="},"t":1704067201500,"x":null}' and row["s"] == '{"i":1,"b":"00ff","t":1704067201,"x":null}'
