"""Expressions against a set-algebra model of their semantics."""

import datetime
import operator

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace.errors import EngineError
from millrace.functions import col, lit
from millrace.functions import types as kinds
from millrace.functions.expressions import And, Compare, Literal, Not, Or, parse_comparison
from millrace.operators import filter_rows, project

TAGS = ("red", "green", "blue")
ROWS = [(i, None if i % 10 == 7 else i, i / 2, TAGS[i % 3]) for i in range(100)]
OPS = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


@pytest.fixture(scope="module")
def batch(spark):
    return spark.createDataFrame(ROWS, "i int, value long, score double, tag string").cache()


def kept(df, predicate, semantics="reference"):
    return sorted(r["i"] for r in filter_rows(df, predicate, semantics).collect())


def test_compare_column_with_literal(batch):
    assert kept(batch, col("value") >= 95) == [95, 96, 98, 99]


@pytest.mark.parametrize("op", OPS)
def test_null_never_compares(batch, op):
    rows = kept(batch, Compare(op, col("value"), lit(7)))
    assert all(i % 10 != 7 for i in rows)
    assert rows == [i for i, v, *_ in ROWS if v is not None and OPS[op](v, 7)]


def test_and_or(batch):
    assert kept(batch, (col("value") < 10) & (col("tag") == "red")) == [0, 3, 6, 9]
    assert kept(batch, (col("value") < 3) | (col("value") <= 4)) == [0, 1, 2, 3, 4]


def test_not_keeps_unknown_rows_unless_sql(batch):
    p = ~(col("value") < 5)
    assert kept(batch, p) == [i for i in range(100) if i >= 5 or i % 10 == 7]
    assert kept(batch, p, "sql") == [i for i in range(5, 100) if i % 10 != 7]
    assert kept(filter_rows(batch, col("value") < 10), p) == [5, 6, 8, 9]


def _tree():
    leaf = st.builds(lambda op, v: Compare(op, col("value"), lit(v)), st.sampled_from(list(OPS)), st.integers(-2, 101)) | st.builds(
        lambda op, v: Compare(op, col("tag"), lit(v)), st.sampled_from(list(OPS)), st.sampled_from(TAGS)
    ) | st.builds(lambda v: Literal(v), st.integers(0, 1))
    return st.recursive(leaf, lambda t: st.builds(And, t, t) | st.builds(Or, t, t) | st.builds(Not, t), max_leaves=6)


def model(e, rows):
    if isinstance(e, And):
        return model(e.right, model(e.left, rows))
    if isinstance(e, Or):
        return model(e.left, rows) | model(e.right, rows)
    if isinstance(e, Not):
        return rows - model(e.term, rows)
    if isinstance(e, Literal):
        return rows if e.content else frozenset()
    at = {"value": 1, "tag": 3}[e.left.name]
    return frozenset(i for i in rows if ROWS[i][at] is not None and OPS[e.op](ROWS[i][at], e.right.content))


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(_tree())
def test_predicate_trees_follow_set_algebra(batch, tree):
    assert kept(batch, tree) == sorted(model(tree, frozenset(range(100))))


def test_arithmetic_promotes_and_propagates_null(batch):
    out = {r["i"]: r for r in project(batch, ["i", ("a", col("score") * 2), ("b", col("value") + 1), ("c", col("i") + 1)]).collect()}
    assert out[4]["a"] == 4.0 and out[99]["a"] == 99.0
    assert out[7]["b"] is None and out[8]["b"] == 9
    schema = project(batch, [("a", col("score") * 2), ("b", col("value") + 1), ("c", col("i") + 1)]).schema
    assert [f.dataType.simpleString() for f in schema] == ["double", "bigint", "int"]


def test_projection_follows_filter(batch):
    out = project(filter_rows(batch, col("value") >= 96), ["i", "score"]).orderBy("i").collect()
    assert [r["score"] for r in out] == [48.0, 49.0, 49.5]


def test_division(spark):
    df = spark.createDataFrame([(7, 2), (-7, 2), (7, 0), (None, 0), (7, None)], "a int, b int")
    rows = [r["q"] for r in project(df, [("q", col("a") / col("b"))]).collect()]
    assert rows == [3, -3, 0, None, None]
    assert project(df, [("q", col("a") / col("b"))]).schema["q"].dataType.simpleString() == "int"
    d = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0), (None, 0.0)], "a double, b double")
    assert [r["q"] for r in project(d, [("q", col("a") / col("b"))]).collect()] == [0.0, 0.25, None]
    with pytest.raises(Exception, match="(?i)divi"):
        project(df, [("q", col("a") / col("b"))], "sql").collect()


def test_overflow_is_an_error(spark):
    df = spark.createDataFrame([(2**31 - 1,)], "a int")
    with pytest.raises(Exception, match="(?i)overflow"):
        project(df, [("q", col("a") + col("a"))]).collect()


def test_nan_and_column_comparisons(spark):
    df = spark.createDataFrame([(1, float("nan"), 1.0), (2, 1.0, 2.0), (3, None, 1.0)], "i int, a double, b double")
    assert kept(df, col("a") > col("b")) == [1]
    assert kept(df, col("a") <= col("b")) == [2]


def test_plan_text():
    assert str((col("day") >= 100) & (col("mode") == "AIR")) == "((day >= 100) AND (mode = 'AIR'))"
    assert str(~(col(2) < 0.5) | (col("a") / 2 == 1)) == "((NOT (#2 < 0.5)) OR ((a / 2) = 1))"


def test_columns_by_place(batch):
    assert kept(batch, col(1) >= 98) == [98, 99]


def test_mistakes_are_engine_errors(batch):
    for bad in (col("value"), col("value") + 1, lit("x")):
        with pytest.raises(EngineError):
            filter_rows(batch, bad)
    for bad in (col("value") == 1, ~(col("value") == 1)):
        with pytest.raises(EngineError, match="not a value"):
            project(batch, [("x", bad)])
    for bad in (col("tag") + 1, col("nothing") + 1):
        with pytest.raises(EngineError):
            project(batch, [("x", bad)])
    for bad in (col("i") == col("value"), col("value") == "7", col("tag") == 7, col("value") == 1.5, col("nothing") == 1):
        with pytest.raises(EngineError):
            filter_rows(batch, bad)
    with pytest.raises(EngineError, match="unknown operator"):
        parse_comparison("~")


def test_literals():
    assert kinds.parse_literal("12abc", kinds.INT32) == 12
    assert kinds.parse_literal("abc", kinds.INT64) == 0
    assert kinds.parse_literal("2.5e1x", kinds.DOUBLE) == 25.0
    assert kinds.coerce(3.0, kinds.INT64) == 3
    assert kinds.format_value(0.1) == "0.10000000000000001"
    assert kinds.payload_is_set(-0.0) and not kinds.payload_is_set(0.0)


def test_dates_and_decimals_at_the_boundary(spark):
    df = spark.createDataFrame([(datetime.date(1970, 1, 2), "12.345")], "d date, m string")
    row = df.select(kinds.date_to_int32("d").alias("d"), kinds.decimal_to_int64(df["m"].cast("decimal(18,3)"), 2).alias("m")).head()
    assert (row["d"], row["m"]) == (1, 1235) and kinds.days(datetime.date(1970, 1, 2)) == 1
    back = spark.createDataFrame([(1, 1235)], "d int, m long")
    row = back.select(kinds.int32_to_date("d").alias("d"), kinds.int64_to_decimal(back["m"], 2).alias("m")).head()
    assert row["d"] == datetime.date(1970, 1, 2) and str(row["m"]) == "12.35"
