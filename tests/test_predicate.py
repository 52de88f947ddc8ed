import pytest
from pyspark.sql import functions as F

from tidemark.functions.predicate import compile_typed, compile_variant, parse

# (row as JSON, clause, whether it holds)
TRUTHS = [
    # Texts
    ('{"city":"Oslo"}', "city = 'Oslo'", True), ('{"city":"Oslo"}', "city = 'oslo'", False), ('{"city":"Oslo"}', "city <> 'Bergen'", True), ('{"city":"Oslo"}', "city != 'Oslo'", False), ('{"city":"Oslo"}', "city >= 'O' AND city < 'P'", True),
    ('{"city":"10"}', "city < '9'", True), ('{"city":"é"}', "city > 'z'", True), ('{"city":""}', "city < 'a'", True), ('{"note":"it\'s"}', "note = 'it''s'", True), ('{"note":"\'"}', "note = ''''", True),
    # Numbers
    ('{"depth":12.25}', "depth > 12.2 AND depth < 12.3", True), ('{"depth":7}', "depth = 7.0", True), ('{"depth":7.0}', "depth <= 7", True), ('{"depth":-3}', "depth >= -3.0", True), ('{"depth":0}', "depth < +.5", True), ('{"depth":1e3}', "depth = 1000", True),
    # Truth values
    ('{"open":false}', "open = false", True), ('{"open":false}', "open <> TRUE", True), ('{"open":true}', "open >= false", False), ('{"open":true}', "NOT (open < true)", True),
    # Binding of AND, OR and NOT
    ('{"p":1,"q":2,"r":3}', "p = 1 OR q = 0 AND r = 0", True), ('{"p":1,"q":2,"r":3}', "(p = 1 OR q = 0) AND r = 0", False), ('{"p":1,"q":2,"r":3}', "p = 0 AND q = 2 OR r = 3", True), ('{"p":1,"q":2}', "not p = 0 and not q = 0", True),
    ('{"p":1,"q":2}', "NOT (p = 0 OR NOT q = 2)", True), ('{"p":1}', "not not not p = 1", False), ('{"p":1}', "((((p = 1))))", True), ('{"P":5,"p":6}', "P = 5 AND p = 6", True),
    # LIKE
    ('{"file":"log/2024.txt"}', "file LIKE 'log/%.txt'", True), ('{"file":"log/2024.txt"}', "file LIKE 'log/____.txt'", True), ('{"file":"log/2024.txt"}', "file LIKE '%2024'", False), ('{"file":"a(b)[c]"}', "file LIKE '_(b)[c]'", True),
    ('{"file":"a\\\\%"}', "file LIKE 'a\\%'", True), ('{"file":"ab"}', "file LIKE 'a\\%'", False), ('{"file":"LOG"}', "file LIKE 'log'", False), ('{"file":""}', "file LIKE '%'", True), ('{"file":2024}', "file LIKE '%'", False),
    # Null, missing and other types
    ('{"x":null}', "x IS NULL AND y IS NULL", True), ('{"x":0}', "x IS NOT NULL AND NOT x IS NULL", True), ('{"x":null}', "x <> 0 OR x = 0", False), ('{"x":null}', "NOT (x <> 0 OR x = 0)", True), ("{}", "y LIKE '%'", False), ("{}", "NOT y LIKE '%'", True),
    ('{"x":3}', "x = NULL OR x <> NULL", False), ('{"x":3}', "NOT x = NULL", True), ('{"x":"3"}', "x = 3 OR x <> 3 OR x < 9", False), ('{"x":3}', "x = '3' OR x <> '3'", False), ('{"x":1}', "x = true OR x <> true", False), ('{"x":true}', "NOT x = 1", True),
    ("[1]", "x IS NULL", False), ('"x"', "x IS NULL", False), ("7", "NOT x = 1", False),
    ('{"kind":"buoy","depth":4,"note":null}', "kind LIKE 'b%' AND (depth > 10 OR NOT depth > 5) AND note IS NULL AND NOT owner = 'me'", True),
]
REJECTED = [" ", "depth", "depth <", "< 3", "depth = 1 OR", "AND depth = 1", "((depth = 1)", "depth = 1))", "city = 'Oslo", "depth => 1", "depth = 1 city = 'x'", "city LIKE NULL", "city NOT LIKE 'x'", "depth IS 3", "depth IS NOT TRUE", "depth ; 1", "depth = 1.2.3", "depth = 1e3",
            "NOT AND depth = 1", "depth IN (1, 2)", "depth BETWEEN 1 AND 2", "depth = width", "depth + 1 = 2", "t.depth = 1", "upper(city) = 'X'", '"depth" = 1']


def test_variant_rows(spark):
    rows = spark.createDataFrame([(n, j) for n, (j, _, _) in enumerate(TRUTHS)], "n int, j string").withColumn("v", F.parse_json("j"))
    held = {r["n"]: r["held"] for r in rows.select("n", F.array(*[compile_variant(c, F.col("v")) for _, c, _ in TRUTHS]).alias("held")).collect()}
    assert [(j, c) for n, (j, c, want) in enumerate(TRUTHS) if held[n][n] is not want] == []


@pytest.mark.parametrize("clause", REJECTED)
def test_rejected(clause):
    with pytest.raises(ValueError):
        parse(clause)


def test_typed_rows_and_metamorphic(spark):
    df = spark.createDataFrame([(1, 1.5, "a", True), (2, float("nan"), None, False), (3, None, "ab", None)], "i int, x double, s string, b boolean")
    keep = lambda c: sorted(r["i"] for r in df.filter(compile_typed(c, df.schema)).collect())
    assert keep("x > 1") == [1] and keep("NOT x > 1") == [2, 3] and keep("x IS NULL") == [2, 3] and keep("i < 2.5") == [1, 2]
    assert keep("s LIKE 'a_'") == [3] and keep("b != TRUE") == [2] and keep("s = 1") == [] and keep("none IS NULL") == [1, 2, 3] and keep("i = 'x' OR i = 3") == [3]
    for clause in ("x > 1", "s LIKE 'a%' AND i > 1", "b = TRUE OR x = 1.5", "NOT s = 'a'", "none = 3"):
        assert sorted(keep(clause) + keep(f"NOT ({clause})")) == [1, 2, 3]


def test_strict_like_stops_at_lines(spark):
    df = spark.createDataFrame([("a\nb",), ("ab",)], "s string")
    assert df.filter(compile_typed("s LIKE 'a%b'", df.schema)).count() == 2
    assert df.filter(compile_typed("s LIKE 'a%b'", df.schema, strict=True)).count() == 1


def test_filters_reach_the_files(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = df.filter(compile_typed("o_totalprice > 1000 AND o_orderpriority LIKE '1%' AND o_custkey = 5", df.schema)).select("o_orderkey")._jdf.queryExecution().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "StringStartsWith(o_orderpriority,1)" in plan and "EqualTo(o_custkey,5)" in plan
