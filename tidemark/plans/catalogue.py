"""Queries over the shared tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicate import compile_typed, compile_variant
from ..functions.render import accrued, clamped, direction, distance, epoch_millis, fnv1a_unit, generated_id, grid_cell, is_name, json_number, moved_toward, random_walk, value_noise, version_parts, words_of
from ..functions.subscription import matches, per_table, project, route, route_thresholds, subscribe, subscribe_all
from ..operators import changes as C
from ..operators import patterns as P
from ..sources.tables import all_rows, scan_point, scan_prefix, scan_range
from ..streaming.delivery import envelope, filter_transform

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def change_log(spark: SparkSession, d: str) -> DataFrame:
    """`events` as a change log: a signup inserts the user's row, an error deletes it, anything else updates it."""
    op = F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    return t(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), op.alias("op"), "value")


CL = """cl AS (SELECT event_id AS seq, user_id AS key, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS op, value FROM events)"""
EFF = f"""{CL}, marked AS (SELECT *, lag(op) OVER w AS prev, lag(value) OVER w AS before FROM cl WINDOW w AS (PARTITION BY key ORDER BY seq)),
eff AS (SELECT seq, key, CASE WHEN op = 'UPDATE' AND (prev IS NULL OR prev = 'DELETE') THEN 'INSERT' ELSE op END AS op,
  CASE WHEN prev <> 'DELETE' THEN before END AS old_value, CASE WHEN op <> 'DELETE' THEN value END AS new_value
  FROM marked WHERE op <> 'DELETE' OR (prev IS NOT NULL AND prev <> 'DELETE'))"""

# Scans


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_full(spark, d):
    return scan_range(t(spark, d, "customer"), "c_name")


@query("SELECT * FROM customer WHERE c_name BETWEEN 'Customer#000000100' AND 'Customer#000000300'")
def scan_range_inclusive(spark, d):
    return scan_range(t(spark, d, "customer"), "c_name", "Customer#000000100", "Customer#000000300")


@query("SELECT * FROM customer WHERE starts_with(c_name, 'Customer#0000001') ORDER BY c_name LIMIT 1000")
def scan_prefix_default(spark, d):
    return scan_prefix(t(spark, d, "customer"), "c_name", "Customer#0000001")


@query("SELECT * FROM customer WHERE starts_with(c_name, 'Customer#') ORDER BY c_name LIMIT 25")
def scan_prefix_limit(spark, d):
    return scan_prefix(t(spark, d, "customer"), "c_name", "Customer#", 25)


@query("SELECT * FROM orders WHERE o_orderkey = 32")
def point_get(spark, d):
    return scan_point(t(spark, d, "orders"), "o_orderkey", 32)


# The predicate language


def _where(name: str, table: str, key: str, clause: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = t(spark, d, table)
        return df.filter(compile_typed(clause, df.schema)).select(*key.split(","))

    run.__name__ = name
    query(f"SELECT {key} FROM {table} WHERE {sql}")(run)


_where("where_urgent_large", "orders", "o_orderkey,o_custkey,o_totalprice,o_orderpriority", "o_orderpriority = '1-URGENT' AND o_totalprice > 100000", "o_orderpriority = '1-URGENT' AND o_totalprice > 100000")
for _name, _op in {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    _where(f"where_num_{_name}", "lineitem", "l_orderkey,l_linenumber,l_quantity", f"l_quantity {_op} 25", f"l_quantity {_op} 25")
_where("where_int_fraction", "part", "p_partkey,p_size", "p_size < 10.5", "p_size < 10.5")
_where("where_str_cmp", "orders", "o_orderkey,o_orderpriority", "o_orderpriority >= '3' AND o_orderpriority < '4'", "o_orderpriority >= '3' AND o_orderpriority < '4'")
_where("where_and_or_precedence", "orders", "o_orderkey", "o_orderstatus = 'F' OR o_orderstatus = 'O' AND o_totalprice > 200000", "o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_totalprice > 200000)")
_where("where_parens", "orders", "o_orderkey", "(o_orderstatus = 'F' OR o_orderstatus = 'O') AND o_totalprice > 200000", "(o_orderstatus = 'F' OR o_orderstatus = 'O') AND o_totalprice > 200000")
_where("where_missing_column", "nation", "n_nationkey", "nowhere = 1 OR nowhere IS NULL AND n_regionkey = 1", "n_regionkey = 1")
_where("where_not_missing", "nation", "n_nationkey", "NOT (nowhere = 1)", "TRUE")
_where("where_type_mismatch", "nation", "n_nationkey", "n_name = 5 OR n_regionkey != 'x' OR n_nationkey < 3", "n_nationkey < 3")
_where("where_null_literal", "nation", "n_nationkey", "n_name = NULL OR n_regionkey = 2", "n_regionkey = 2")
_where("where_like_prefix", "part", "p_partkey,p_name", "p_name LIKE 'part 1%'", "p_name LIKE 'part 1%'")
_where("where_like_contains", "part", "p_partkey,p_type", "p_type LIKE '%A%'", "p_type LIKE '%A%'")
_where("where_like_underscore", "part", "p_partkey,p_brand", "p_brand LIKE 'Brand#_3'", "p_brand LIKE 'Brand#_3'")
_where("where_like_literal_specials", "events", "event_id", r"props LIKE '%.%' OR props LIKE '%\%' OR event_type LIKE 'c_ick'", r"contains(props, '.') OR contains(props, '\') OR event_type LIKE 'c_ick'")


def _nullable(spark, d):
    """Orders of each customer with the price of the one before, null for the first."""
    from pyspark.sql import Window

    return t(spark, d, "orders").select("o_orderkey", F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("prior"))


_LAG = "WITH n AS (SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prior FROM orders) SELECT o_orderkey FROM n WHERE "


def _null_where(name: str, clause: str, sql: str) -> None:
    def run(spark, d):
        df = _nullable(spark, d)
        return df.filter(compile_typed(clause, df.schema)).select("o_orderkey")

    run.__name__ = name
    query(_LAG + sql)(run)


_null_where("where_not_null_collapse", "NOT (prior > 100000)", "NOT coalesce(prior > 100000, false)")
_null_where("where_is_null", "prior IS NULL", "prior IS NULL")
_null_where("where_is_not_null", "prior IS NOT NULL AND prior < 50000", "prior IS NOT NULL AND prior < 50000")


@query("SELECT event_id FROM events WHERE NOT coalesce((json_extract(props, '$.k'))::DOUBLE > 50, false) AND event_type <> 'view'")
def where_variant(spark, d):
    rows = t(spark, d, "events").withColumn("row", F.try_parse_json(F.concat(F.lit('{"p":'), F.get_json_object("props", "$.k"), F.lit(',"type":"'), "event_type", F.lit('"}'))))
    return rows.filter(compile_variant("NOT p > 50 AND type != 'view'", F.col("row"))).select("event_id")


@query("SELECT c_custkey, c_name FROM customer")
def project_columns(spark, d):
    return t(spark, d, "customer").select("c_custkey", "c_name")


@query("SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name HAVING count(*) > 1")
def sql_select(spark, d):
    """SELECT is Spark's own: joins, grouping and HAVING beyond the subscription language, over the views of tables."""
    for name in ("customer", "nation", "region"):
        t(spark, d, name).createOrReplaceTempView(name)
    return spark.sql("""
        WITH placed AS (SELECT c_acctbal, n_name, n_regionkey FROM nation INNER JOIN customer ON n_nationkey = c_nationkey)
        SELECT n_name, r_name, count(c_acctbal) AS customers, round(sum(c_acctbal), 2) AS balance FROM placed, region
        WHERE n_regionkey = r_regionkey GROUP BY ALL HAVING customers >= 2""")


@query("SELECT (SELECT count(*) FROM customer) AS row_count, sum(strlen(c_custkey::VARCHAR) + 16 + 9 + strlen(c_custkey::VARCHAR) + 6 + strlen(c_name) + 11 + strlen(c_nationkey::VARCHAR) + 12 + strlen(c_mktsegment))::BIGINT AS size_bytes FROM customer")
def table_stats(spark, d):
    return C.sizes(t(spark, d, "customer").drop("c_acctbal"), "c_custkey")


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in TABLES))
def row_counts_all_tables(spark, d):
    out = None
    for name in TABLES:
        one = t(spark, d, name).agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


# Changes


@query(f"WITH {EFF} SELECT seq, key, op, old_value, new_value FROM eff")
def changefeed_events(spark, d):
    return C.effective(change_log(spark, d)).select("seq", "key", "op", "old_value", "new_value")


_STATE = "WITH {cl}, last AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM cl WHERE seq <= {at}) SELECT key, seq, value FROM last WHERE rn = 1 AND op <> 'DELETE'"


@query(_STATE.format(cl=CL, at="9223372036854775807"))
def state_current(spark, d):
    return C.current_state(change_log(spark, d))


@query(_STATE.format(cl=CL, at=500))
def state_at_offset(spark, d):
    return C.current_state(change_log(spark, d), at=500)


@query(f"""WITH {EFF}, lives AS (SELECT *, sum(starts) OVER (PARTITION BY key ORDER BY seq) AS life FROM
  (SELECT *, CASE WHEN lag(op) OVER w IS NULL OR lag(op) OVER w = 'DELETE' THEN 1 ELSE 0 END AS starts FROM eff WINDOW w AS (PARTITION BY key ORDER BY seq)))
SELECT seq, key, op, row_number() OVER (PARTITION BY key, life ORDER BY seq) - 1 AS version FROM lives""")
def row_version(spark, d):
    return C.row_versions(change_log(spark, d)).select("seq", "key", "op", "version")


@query(_STATE.format(cl=CL, at="9223372036854775807"))
def snapshot_plus_tail(spark, d):
    log = change_log(spark, d)
    return C.resume(C.current_state(log, at=500), log.filter("seq > 500"))


_STAGED = "staged AS (SELECT c_custkey, c_acctbal + 1000 AS c_acctbal, c_custkey % 10 = 0 AS deleted FROM customer WHERE c_custkey % 2 = 0)"


@query(f"WITH {_STAGED} SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM staged) UNION ALL SELECT c_custkey, c_acctbal FROM staged WHERE NOT deleted")
def overlay_merge(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", "c_acctbal")
    staged = rows.filter("c_custkey % 2 = 0").select("c_custkey", (F.col("c_acctbal") + 1000).alias("c_acctbal"), (F.col("c_custkey") % 10 == 0).alias("deleted"))
    return C.overlay(rows, staged, "c_custkey")


@query(f"WITH {CL} SELECT seq, key, op, value FROM cl WHERE seq >= 200 ORDER BY seq LIMIT 100")
def get_events_page(spark, d):
    return C.page(change_log(spark, d), 200)


@query("""WITH s AS (SELECT min(event_id) AS low, max(event_id) AS high FROM events), k AS (SELECT high, high - low + 1 AS n FROM s),
h AS (SELECT high, CASE WHEN n <= 300 THEN n ELSE 225 + (n - 301) % 76 END AS kept FROM k) SELECT event_id AS seq FROM events, h WHERE event_id > high - kept""")
def retention_count(spark, d):
    return C.retain_count(change_log(spark, d), 300).select("seq")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def retention_time(spark, d):
    return C.retain_time(t(spark, d, "events"), "ts", "1 DAY").select("event_id")


@query("SELECT min(event_id) AS oldest, max(event_id) AS latest FROM events")
def oldest_latest_offset(spark, d):
    return C.offsets(change_log(spark, d))


@query("SELECT user_id % 10 AS subscription, max(event_id) AS acked FROM events WHERE event_type = 'view' GROUP BY 1")
def ack_progress(spark, d):
    acks = t(spark, d, "events").filter("event_type = 'view'").select((F.col("user_id") % 10).alias("subscription"), "event_id")
    return C.acknowledged(acks, "subscription", "event_id")


@query("WITH a AS (SELECT user_id % 10 AS s, max(event_id) AS acked FROM events WHERE event_type = 'view' GROUP BY 1) SELECT max((SELECT max(event_id) FROM events) - acked) AS max_lag FROM a")
def max_lag(spark, d):
    latest = C.offsets(change_log(spark, d)).first()["latest"]
    return ack_progress(spark, d).agg(F.max(F.lit(latest) - F.col("acked")).alias("max_lag"))


@query("SELECT count(*) AS published, count_if(event_type = 'error') AS deletes, count_if(value > 50) AS large FROM events")
def feed_metrics(spark, d):
    return t(spark, d, "events").agg(F.count("*").alias("published"), F.count_if(F.col("event_type") == "error").alias("deletes"), F.count_if(F.col("value") > 50).alias("large"))


# Subscriptions

ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("value", T.DoubleType())])


def feed(spark: SparkSession, d: str) -> DataFrame:
    rows = C.effective(change_log(spark, d))
    side = lambda c, there: F.when(there, F.struct(F.col("key").alias("id"), F.col(c).alias("value"))).alias(c)
    return rows.select("seq", "key", "op", F.lit("events").alias("table"), side("new_value", F.col("op") != "DELETE"), side("old_value", F.col("old_value").isNotNull()))


_HIT = "CASE op WHEN 'DELETE' THEN coalesce(old_value > 50, false) WHEN 'UPDATE' THEN coalesce(new_value > 50, false) OR coalesce(old_value > 50, false) ELSE coalesce(new_value > 50, false) END"


@query(f"WITH {EFF} SELECT seq, key, op FROM eff WHERE {_HIT}")
def sub_match(spark, d):
    return feed(spark, d).filter(matches(subscribe("s", "SELECT * FROM events WHERE value > 50"), ROW, table="table")).select("seq", "key", "op")


for _op in ("INSERT", "UPDATE", "DELETE"):

    def _one(spark, d, op=_op):
        return sub_match(spark, d).filter(F.col("op") == op)

    _one.__name__ = f"sub_match_{_op.lower()}"
    query(f"WITH {EFF} SELECT seq, key, op FROM eff WHERE op = '{_op}' AND {_HIT}")(_one)


@query(f"WITH {EFF} SELECT seq, op, new_value AS value FROM eff WHERE {_HIT}")
def sub_project(spark, d):
    s = subscribe("s", "select value from events where value > 50")
    return project(s, feed(spark, d).filter(matches(s, ROW)), ROW).select("seq", "op", "new_value.value")


@query(f"WITH {EFF} SELECT seq, op FROM eff")
def sub_all_tables(spark, d):
    return feed(spark, d).filter(matches(subscribe("s", "SELECT * FROM events"), ROW)).select("seq", "op")


@query(f"""WITH {EFF}, subs AS (SELECT range AS v FROM range(0, 100, 2))
SELECT 'sub-' || v AS subscription, count(*) AS events FROM eff JOIN subs ON CASE op WHEN 'DELETE' THEN coalesce(old_value > v, false) WHEN 'UPDATE' THEN coalesce(new_value > v, false) OR coalesce(old_value > v, false) ELSE coalesce(new_value > v, false) END GROUP BY 1""")
def sub_fanout_many(spark, d):
    subs = [subscribe(f"sub-{v}", f"SELECT * FROM events WHERE value > {v}") if v % 2 == 0 else subscribe(f"sub-{v}", f"SELECT * FROM other_{v}") for v in range(100)]
    return route(feed(spark, d), subs, ROW).groupBy("subscription").agg(F.count("*").alias("events"))


@query("SELECT v AS subscription, count(*) AS events FROM events JOIN (SELECT range AS v FROM range(0, 1000, 2)) ON value > v % 100 GROUP BY 1")
def sub_routing_by_table(spark, d):
    subs = spark.range(1000).select(F.col("id").alias("subscription"), F.when(F.col("id") % 2 == 0, "events").otherwise(F.concat(F.lit("other_"), "id")).alias("table"), (F.col("id") % 100).cast("double").alias("threshold"))
    return route_thresholds(t(spark, d, "events").select("event_id", "value", F.lit("events").alias("table")), subs).groupBy("subscription").agg(F.count("*").alias("events"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 60 BETWEEN 10 AND 20 AND l_suppkey % 60 BETWEEN 5 AND 15")
def sub_aoi_viewport(spark, d):
    cells = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 60).alias("cx"), (F.col("l_suppkey") % 60).alias("cy"))
    return cells.filter(compile_typed("cx >= 10 AND cx <= 20 AND cy >= 5 AND cy <= 15", cells.schema)).select("l_orderkey", "l_linenumber")


@query("SELECT 'events' AS table_name, 50 AS subscriptions UNION ALL SELECT 'other_' || range, 1 FROM range(1, 100, 2)")
def subscriptions_per_table(spark, d):
    subs = spark.range(100).select(F.when(F.col("id") % 2 == 0, "events").otherwise(F.concat(F.lit("other_"), "id")).alias("table"))
    return per_table(subs)


@query("SELECT event_id FROM events WHERE event_type <> 'error' AND (json_extract(props, '$.k'))::BIGINT % 2 = 0")
def filter_udf_not_done(spark, d):
    """A filter function over the event; one that is no error of Spark's own columns stays out of Python."""
    return t(spark, d, "events").filter((F.col("event_type") != "error") & F.coalesce(F.get_json_object("props", "$.k").cast("long") % 2 == 0, F.lit(False))).select("event_id")


def _with_event(spark, d):
    rows = t(spark, d, "events").select("event_id", F.lit("events").alias("table"), F.lit("INSERT").alias("op"), F.col("event_id").alias("seq"), F.col("user_id").alias("key"), F.struct("event_type", "value").alias("new_value"), F.lit(None).cast("string").alias("old_value"))
    return rows.withColumn("event", envelope())


def _costly(events: pd.Series) -> pd.Series:
    """Of events in JSON: whether the new value is above 50; null where there is none, which drops the event."""
    values = [json.loads(e)["new_value"].get("value") for e in events]
    return pd.Series([None if v is None else v > 50 for v in values], dtype=object)


def _shout(events: pd.Series) -> pd.Series:
    """The event's type in upper case, of views nothing, which leaves the event as it was."""
    types = [json.loads(e)["new_value"]["event_type"] for e in events]
    return pd.Series([None if x == "view" else x.upper() for x in types], dtype=object)


@query("SELECT event_id FROM events WHERE value > 50")
def filter_function(spark, d):
    """A filter function of Python over the event, batch by batch."""
    return filter_transform(_with_event(spark, d), keep=F.pandas_udf(_costly, "boolean"), tables=["events"]).select("event_id")


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN '{\"table\":\"events\",\"op\":\"INSERT\",\"seq\":' || event_id || ',\"key\":' || user_id || '}' ELSE upper(event_type) END AS event FROM events WHERE value > 50")
def transform_function(spark, d):
    out = filter_transform(_with_event(spark, d).withColumn("event", envelope(("table", "op", "seq", "key", "new_value"))), keep=F.pandas_udf(_costly, "boolean"), transform=F.pandas_udf(_shout, "string"))
    kept = F.to_json(F.from_json("event", "table string, op string, seq long, key long"))
    return out.select("event_id", F.when(F.col("event").startswith("{"), kept).otherwise(F.col("event")).alias("event"))


@query(f"""WITH {EFF} SELECT 'all' AS subscription, count(*) AS events FROM eff UNION ALL SELECT 'large', count(*) FROM eff WHERE {_HIT}
UNION ALL SELECT 'same', count(*) FROM eff WHERE {_HIT} UNION ALL SELECT 'table', count(*) FROM eff UNION ALL
SELECT 'mixed', count(*) FROM eff WHERE CASE op WHEN 'DELETE' THEN coalesce(old_value < 10 OR old_value > 90, false) WHEN 'UPDATE' THEN coalesce(new_value < 10 OR new_value > 90, false) OR coalesce(old_value < 10 OR old_value > 90, false) ELSE coalesce(new_value < 10 OR new_value > 90, false) END""")
def sub_table_and_all(spark, d):
    """Subscriptions of one table and of all tables at once: an event that matches several comes once for each."""
    subs = [subscribe_all("all"), subscribe("large", "SELECT * FROM events WHERE value > 50"), subscribe("same", "SELECT * FROM events WHERE value > 50"), subscribe("table", "SELECT * FROM events"), subscribe("mixed", "SELECT * FROM events WHERE value < 10 OR value > 90"), subscribe("other", "SELECT * FROM orders")]
    return route(feed(spark, d), subs, ROW).groupBy("subscription").agg(F.count("*").alias("events"))


@query("""SELECT 'region' AS "table", r_regionkey::VARCHAR AS key, '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS value FROM region
UNION ALL SELECT 'nation', n_nationkey::VARCHAR, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' FROM nation
UNION ALL SELECT 'customer', c_custkey::VARCHAR, '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}' FROM customer""")
def all_tables_rows(spark, d):
    """The first rows of a subscription of all tables."""
    columns = {"region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "customer": ("c_custkey", "c_mktsegment")}
    return all_rows({name: (t(spark, d, name).select(*own), own[0]) for name, own in columns.items()})


@query("SELECT event_id, CASE WHEN value > 50 THEN '***' ELSE event_type END AS masked FROM events")
def transform_mask(spark, d):
    return t(spark, d, "events").select("event_id", F.when(F.col("value") > 50, "***").otherwise(F.col("event_type")).alias("masked"))


# Dataflow of reducers


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def key_lookup_join(spark, d):
    nations = F.broadcast(t(spark, d, "nation"))  # 25 rows whatever the scale
    customers = t(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return t(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def semi_load_active(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders").filter("o_orderstatus = 'O'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def anti_clear_settled(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders").filter("o_orderstatus = 'O'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def _points(spark, d):
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 37 % 997).alias("x"), (F.col("p_partkey") * 101 % 991).alias("y"))


def _stations(spark, d):
    return t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 53 % 997).alias("x"), (F.col("s_suppkey") * 71 % 991).alias("y"))


_POINTS = "p AS (SELECT p_partkey AS id, p_partkey * 37 % 997 AS x, p_partkey * 101 % 991 AS y FROM part), s AS (SELECT s_suppkey AS id, s_suppkey * 53 % 997 AS x, s_suppkey * 71 % 991 AS y FROM supplier)"
_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"


@query(f"WITH {_POINTS} SELECT a.id AS left_id, b.id AS right_id, {_D2} AS d2 FROM s a JOIN p b ON {_D2} <= 900")
def radius_join_bucketed(spark, d):
    return P.radius_join(_stations(spark, d), _points(spark, d), 30, 30)


@query(f"WITH {_POINTS} SELECT b.id AS right_id, min(a.id) AS left_id FROM s a JOIN p b ON {_D2} <= 900 GROUP BY 1")
def first_taker_wins(spark, d):
    return P.first_in_reach(_stations(spark, d), _points(spark, d), 30, 30)


@query(f"WITH {_POINTS} SELECT a.id AS a, b.id AS b, {_D2} AS d2 FROM p a JOIN p b ON a.id < b.id AND {_D2} <= 400")
def neighbour_pairs(spark, d):
    return P.neighbour_pairs(_points(spark, d), cell=20, radius2=400)


@query("SELECT l_partkey % 60 AS cx, l_suppkey % 60 AS cy, count(*) AS live, bool_or(l_returnflag = 'R') AS pending FROM lineitem GROUP BY 1, 2")
def live_count_flag_by_cell(spark, d):
    return t(spark, d, "lineitem").groupBy((F.col("l_partkey") % 60).alias("cx"), (F.col("l_suppkey") % 60).alias("cy")).agg(F.count("*").alias("live"), F.bool_or(F.col("l_returnflag") == "R").alias("pending"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey % 60) // 15 = 2 AND (l_suppkey % 60) // 15 = 1")
def shard_filter(spark, d):
    cell = lambda c: F.floor(F.col(c) % 60 / 15)
    return t(spark, d, "lineitem").filter((cell("l_partkey") == 2) & (cell("l_suppkey") == 1)).select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey AS key, round(sum(v), 2) AS value FROM (SELECT c_custkey, c_acctbal AS v FROM customer UNION ALL SELECT o_custkey, o_totalprice FROM orders) GROUP BY 1")
def increments_upsert(spark, d):
    current = t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    deltas = t(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"))
    return P.increments(current, deltas, "key", "value").select("key", F.round("value", 2).alias("value"))


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best FROM events")
def running_max(spark, d):
    return P.running_max(t(spark, d, "events"), "user_id", "event_id", "value").select("event_id", "best")


@query("SELECT event_id FROM events WHERE (event_type = 'click' AND ts < (SELECT max(ts) FROM events) - INTERVAL 2 HOUR) OR (event_type = 'view' AND ts < (SELECT max(ts) FROM events) - INTERVAL 1 DAY)")
def ttl_expire(spark, d):
    events = t(spark, d, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    return P.expired(events, "event_type", "ts", {"click": "2 HOUR", "view": "1 DAY"}, now).select("event_id")


@query("SELECT count(*) AS n, count_if(event_type = 'click') AS clicks, arg_max(event_id, event_id) FILTER (event_type = 'click') AS last_click FROM events")
def counts_and_last(spark, d):
    click = F.col("event_type") == "click"
    return t(spark, d, "events").agg(F.count("*").alias("n"), F.count_if(click).alias("clicks"), F.max_by("event_id", F.when(click, F.col("event_id"))).alias("last_click"))


@query("SELECT s_suppkey, least(1.5::DOUBLE * (s_suppkey % 1000), 250.0::DOUBLE) AS stock FROM supplier")
def accrual_capped(spark, d):
    return t(spark, d, "supplier").select("s_suppkey", accrued(F.lit(1.5), (F.col("s_suppkey") % 1000), F.lit(250.0)).alias("stock"))


@query("SELECT p_partkey, CASE WHEN 50 >= p_size THEN p_size + least(7, 50 - p_size) ELSE p_size - least(7, p_size - 50) END::BIGINT AS at FROM part")
def move_toward(spark, d):
    return t(spark, d, "part").select("p_partkey", moved_toward(F.col("p_size"), F.lit(50), F.lit(7)).cast("long").alias("at"))


@query("""WITH m AS (SELECT s_suppkey, s_nationkey || ':' || s_suppkey AS a, (s_nationkey + s_suppkey % 2) || ':' || s_suppkey AS b FROM supplier)
SELECT a AS key, 'DELETE' AS op FROM m WHERE a <> b UNION ALL SELECT b, 'INSERT' FROM m WHERE a <> b""")
def rekey_on_move(spark, d):
    key = F.col("s_suppkey").cast("string")
    return P.rekey(t(spark, d, "supplier"), [F.col("s_nationkey").cast("string"), key], [(F.col("s_nationkey") + F.col("s_suppkey") % 2).cast("string"), key])


# Functions


@query("SELECT event_id, (json_extract(props, '$.k'))::DOUBLE AS k, -1.0::DOUBLE AS missing FROM events")
def json_props_get(spark, d):
    return t(spark, d, "events").select("event_id", json_number(F.col("props"), "$.k", -1).alias("k"), json_number(F.col("props"), "$.none", -1).alias("missing"))


@query("SELECT event_id, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS json FROM events")
def json_roundtrip(spark, d):
    return t(spark, d, "events").select("event_id", F.to_json(F.try_parse_json(F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))))).alias("json"))


@query("SELECT c_custkey, sha256(c_name) AS sha, base64(encode(c_name)) AS b64, lower(hex(encode(c_name))) AS hexed FROM customer")
def digests(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.sha2("c_name", 256).alias("sha"), F.base64(F.col("c_name").cast("binary")).alias("b64"), F.lower(F.hex("c_name")).alias("hexed"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000000 AS s FROM events")
def epochs(spark, d):
    return t(spark, d, "events").select("event_id", epoch_millis(F.col("ts")).alias("ms"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey % 7, p_partkey) AS place FROM part")
def version_compare_sort(spark, d):
    v = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string"), F.col("p_partkey").cast("string"))
    return P.numbered(t(spark, d, "part"), version_parts(v), "place").select("p_partkey", "place")


@query("SELECT event_type, list_sort(list(value))[least(floor(0.99 * count(*)), count(*) - 1)::BIGINT + 1] AS percentile FROM events GROUP BY 1")
def percentile_nearest_rank(spark, d):
    return P.percentile_nearest(t(spark, d, "events"), "event_type", "value", 0.99)


@query("SELECT user_id, list_reduce(list_prepend(0::BIGINT, list(trunc(value)::BIGINT ORDER BY event_id)), lambda a, x: (a * 9 + x) // 10) AS average FROM events GROUP BY 1")
def ema(spark, d):
    return P.moving_average(t(spark, d, "events"), "user_id", "event_id", "value")


@query("SELECT p_partkey, ((1700000000000 << 20) | (p_partkey & 1048575))::BIGINT AS id FROM part")
def id_generate(spark, d):
    return t(spark, d, "part").select("p_partkey", generated_id(1_700_000_000_000, F.col("p_partkey")).alias("id"))


@query("SELECT c_custkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295) / 4294967296.0::DOUBLE AS unit FROM customer")
def hash_to_unit(spark, d):
    return t(spark, d, "customer").select("c_custkey", fnv1a_unit(F.col("c_name")).alias("unit"))


@query("SELECT c_custkey, regexp_full_match(c_name[:c_custkey % 20], '[A-Za-z0-9_-]{1,16}') AS is_name FROM customer")
def name_check(spark, d):
    return t(spark, d, "customer").select("c_custkey", is_name(F.substring("c_name", F.lit(1), (F.col("c_custkey") % 20).cast("int"))).alias("is_name"))


@query("SELECT p_partkey, list_filter(list_transform(string_split(p_type || ', ,' || p_brand, ','), lambda p: lower(trim(p))), lambda p: p <> '') AS words FROM part")
def list_words(spark, d):
    return t(spark, d, "part").select("p_partkey", words_of(F.concat_ws(", ,", "p_type", "p_brand")).alias("words"))


@query(f"""WITH {_POINTS} SELECT id, sqrt((x - 500) * (x - 500) + (y - 500) * (y - 500)) AS away, greatest(least(x, 800), 200)::BIGINT AS kept,
CASE WHEN x = 500 AND y = 500 THEN 0 ELSE round((500 - x) / sqrt((x - 500) * (x - 500) + (y - 500) * (y - 500)), 9) END AS toward FROM p""")
def steering(spark, d):
    dx, dy = 500 - F.col("x"), 500 - F.col("y")
    return _points(spark, d).select("id", distance(dx, dy).alias("away"), clamped(F.col("x"), F.lit(200), F.lit(800)).alias("kept"), F.round(direction(dx, dy)["x"], 9).alias("toward"))


_LATTICE = "(SELECT (xor(h2, h2 >> 16) & 16777215) / 16777216.0::DOUBLE FROM (SELECT (xor(h1, h1 >> 13) * 1274126177) & 4294967295 AS h2 FROM (SELECT (({x}) * 374761393 + ({y}) * 668265263 + 7::BIGINT * 1442695040) & 4294967295 AS h1)))"
_EASE = "({t} * {t} * (3.0::DOUBLE - 2.0::DOUBLE * {t}))"


@query(f"""WITH p AS (SELECT p_partkey AS id, p_partkey % 97 / 8.0::DOUBLE AS x, p_partkey % 89 / 16.0::DOUBLE AS y FROM part),
c AS (SELECT id, floor(x)::HUGEINT AS i, floor(y)::HUGEINT AS j, {_EASE.format(t="(x - floor(x))")} AS u, {_EASE.format(t="(y - floor(y))")} AS v FROM p),
n AS (SELECT id, u, v, {_LATTICE.format(x="i", y="j")} AS a, {_LATTICE.format(x="i + 1", y="j")} AS b, {_LATTICE.format(x="i", y="j + 1")} AS e, {_LATTICE.format(x="i + 1", y="j + 1")} AS f FROM c)
SELECT id, round((a * (1 - u) + b * u) * (1 - v) + (e * (1 - u) + f * u) * v, 9) AS noise FROM n""")
def terrain_noise(spark, d):
    at = t(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 97 / 8.0).alias("x"), (F.col("p_partkey") % 89 / 16.0).alias("y"))
    return at.select("id", F.round(value_noise(F.col("x"), F.col("y"), 7), 9).alias("noise"))


@query("""WITH RECURSIVE r AS (SELECT s_suppkey AS id, 0 AS n, s_suppkey::HUGEINT AS x FROM supplier UNION ALL
SELECT id, n + 1, xor(b, (b * 131072) % 18446744073709551616) FROM (SELECT id, n, xor(a, a // 128) AS b FROM (SELECT id, n, xor(x, (x * 8192) % 18446744073709551616) AS a FROM r WHERE n < 3)))
SELECT id, max(CASE n WHEN 1 THEN (x // 2048)::DOUBLE / 9007199254740992.0::DOUBLE END) AS first, max(CASE n WHEN 3 THEN (x // 2048)::DOUBLE / 9007199254740992.0::DOUBLE END) AS third FROM r GROUP BY id""")
def random_numbers(spark, d):
    walk = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), random_walk(F.col("s_suppkey"), 3).alias("walk"))
    return walk.select("id", F.get("walk", F.lit(0)).alias("first"), F.get("walk", F.lit(2)).alias("third"))


@query(f"""WITH {_POINTS} SELECT id, greatest(least(x + v * 0.5::DOUBLE, 900.0::DOUBLE), -900.0::DOUBLE) AS x,
CASE WHEN x + v * 0.5::DOUBLE > 900 OR x + v * 0.5::DOUBLE < -900 THEN -(v * 0.75::DOUBLE) ELSE v * 0.75::DOUBLE END AS vx FROM (SELECT id, x::DOUBLE AS x, (y - 400)::DOUBLE AS v FROM p)""")
def physics_step(spark, d):
    bodies = _points(spark, d).select("id", F.col("x").cast("double").alias("x"), F.lit(0.0).alias("y"), (F.col("y") - 400).cast("double").alias("vx"), F.lit(0.0).alias("vy"))
    return P.stepped(bodies, F.lit(0.5), 0.5, 900.0).select("id", "x", "vx")


@query()
def absorb_in_order(spark, d):
    """Suppliers of a nation absorb one another in the order of their keys; a sequence that SQL can't express."""
    at = t(spark, d, "supplier").select(F.col("s_nationkey").alias("arena"), F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 53 % 97).alias("x"), (F.col("s_suppkey") * 71 % 89).alias("y"), (F.col("s_suppkey") % 50 * 40 + 10).alias("mass"))
    return P.absorbed(at)


@query("SELECT l_partkey % 60 // 8 AS cx, l_suppkey % 60 // 8 AS cy, count(*) AS n FROM lineitem GROUP BY 1, 2")
def grid_bins(spark, d):
    cell = lambda c: grid_cell(F.col(c) % 60, 8)
    return t(spark, d, "lineitem").groupBy(cell("l_partkey").alias("cx"), cell("l_suppkey").alias("cy")).agg(F.count("*").alias("n"))


@query(f"WITH {EFF} SELECT seq, key, op FROM eff WHERE {_HIT}")
def stream_equals_batch(spark, d):
    """The subscription of sub_match over a stream of the feed, run to its end and read back."""
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")  # folders that all executors see
    base = f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    events = feed(spark, d)
    events.write.parquet(f"{base}/in")
    hits = spark.readStream.schema(events.schema).parquet(f"{base}/in").filter(matches(subscribe("s", "SELECT * FROM events WHERE value > 50"), ROW)).select("seq", "key", "op")
    hits.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(hits.schema).parquet(f"{base}/out")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["where_urgent_large"](spark, d)
