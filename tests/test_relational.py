"""Operators against brute force over the same rows."""

import random
from collections import Counter, defaultdict

import pytest

from millrace.errors import EngineError
from millrace.functions import avg, col, count, count_rows, max_, min_, sum_
from millrace.operators import aggregate, collect, filter_rows, hash_join, limit, project, scan
from millrace.plans import run, table
from millrace.sources import write_table

MODES = ("AIR", "RAIL", "SHIP", "TRUCK")


def fact_rows(n, seed=12345):
    rng = random.Random(seed)
    return [(i // 4, rng.randrange(50), rng.randrange(10000) / 100, rng.choice(MODES)) for i in range(n)]


@pytest.fixture(scope="module")
def fact(spark):
    rows = fact_rows(5000)
    return rows, spark.createDataFrame(rows, "day int, customer long, amount double, mode string").cache()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = fact_rows(8000)
    path = str(tmp_path_factory.mktemp("fact") / "t")
    write_table(spark.createDataFrame(rows, "day int, customer long, amount double, mode string"), path, 400, ["day"], files=2)
    return rows, path


def test_filter(fact):
    rows, df = fact
    want = [r for r in rows if r[0] >= 900 and r[3] == "AIR"]
    assert want and sorted(map(tuple, filter_rows(df, (col("day") >= 900) & (col("mode") == "AIR")).collect())) == sorted(want)


@pytest.mark.parametrize("day", [0, 1, 500, 999, 1999, 5000])
def test_pushdown_is_exact(spark, stored, day):
    rows, path = stored
    for pushed in (True, False):
        assert scan(spark, path, where=[("day", "=", day)], pushdown=pushed).count() == sum(r[0] == day for r in rows)


def test_pushdown_gives_the_same_rows_for_less_work(spark, stored):
    _, path = stored
    with_it, without = (run(scan(spark, path, where=[("day", ">=", 1900)], pushdown=p)) for p in (True, False))
    assert with_it.rows == without.rows == 400
    assert with_it.rows_scanned <= 800 < without.rows_scanned == 8000


def test_scan_columns(spark, stored):
    df = scan(spark, stored[1], ["mode", "day"])
    assert df.columns == ["mode", "day"] and "ReadSchema: struct<day:int,mode:string>" in df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    ).replace("struct<mode:string,day:int>", "struct<day:int,mode:string>")
    with pytest.raises(EngineError):
        scan(spark, stored[1], ["nothing"])
    with pytest.raises(EngineError):
        scan(spark, stored[1] + "-not-there")


def test_group_by_with_five_aggregates(fact):
    rows, df = fact
    got = {r["mode"]: r for r in aggregate(df, ["mode"], [count_rows("n"), sum_("amount", "s"), min_("amount", "lo"), max_("amount", "hi"), avg("amount", "m")]).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r[2])
    assert set(got) == set(by)
    for mode, xs in by.items():
        g = got[mode]
        assert (g["n"], g["lo"], g["hi"]) == (len(xs), min(xs), max(xs))
        assert abs(g["s"] - sum(xs)) < 1e-6 and abs(g["m"] - sum(xs) / len(xs)) < 1e-9


def test_composite_keys_stay_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc")], "l string, r string")
    assert aggregate(df, ["l", "r"], [count_rows()]).count() == 2


def test_null_aggregates(spark):
    half = spark.createDataFrame([(0, None if i % 2 == 0 else i) for i in range(10)], "k int, v long")
    assert tuple(aggregate(half, ["k"], [count_rows("a"), count("v", "b"), sum_("v", "c")]).head()) == (0, 10, 5, 25)
    none = spark.createDataFrame([(1, None)] * 4, "k int, v long")
    assert tuple(aggregate(none, ["k"], [sum_("v"), min_("v"), max_("v"), avg("v"), count("v")]).head()) == (1, None, None, None, None, 0)


def test_null_key_is_a_key(spark):
    df = spark.createDataFrame([(None,), (0,), (None,)], "k int")
    assert Counter(map(tuple, aggregate(df, ["k"], [count_rows()]).collect())) == Counter([(None, 2), (0, 1)])


def test_types_of_results(spark):
    df = spark.createDataFrame([(1, "x", 1.0)], "i int, s string, d double")
    out = aggregate(df, [], [min_("i"), max_("i"), sum_("i"), avg("i"), min_("d"), sum_("d"), max_("s"), count("s")])
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "bigint", "bigint", "double", "double", "double", "string", "bigint"]
    for bad in (sum_, avg):
        with pytest.raises(EngineError):
            aggregate(df, [], [bad("s")])


def test_global_aggregate(spark):
    df = spark.range(1, 101).withColumnRenamed("id", "v")
    assert tuple(aggregate(df, [], [count_rows(), sum_("v")]).head()) == (100, 5050)


def test_empty_input(spark):
    empty = spark.createDataFrame([], "k long, s string")
    assert filter_rows(empty, col("k") > 0).count() == 0
    assert aggregate(empty, ["k"], [count_rows()]).count() == 0
    assert aggregate(empty, [], [count_rows()]).count() == 0
    assert tuple(aggregate(empty, [], [count_rows(), sum_("k")], "sql").head()) == (0, None)
    full = spark.createDataFrame([(1, "a")], "k long, s string")
    assert hash_join(empty, full, ["k"], ["k"]).count() == hash_join(full, empty, ["k"], ["k"]).count() == 0


def test_distinct_keys(fact):
    rows, df = fact
    assert sorted(r[0] for r in aggregate(df, ["mode"], []).collect()) == sorted({r[3] for r in rows})


@pytest.mark.parametrize("strategy", ["auto", "broadcast", "shuffle_hash", "merge"])
def test_join_against_nested_loops(spark, fact, strategy):
    rows, df = fact
    build = [(i, f"cust{i}") for i in range(40)]
    out = hash_join(df, spark.createDataFrame(build, "id long, name string"), ["customer"], ["id"], strategy=strategy)
    assert out.columns == ["day", "customer", "amount", "mode", "id", "name"]
    assert sorted(map(tuple, out.collect())) == sorted((*r, *b) for r in rows for b in build if r[1] == b[0])


def test_duplicate_build_keys_and_clashing_names(spark):
    build = spark.createDataFrame([(7, 100), (7, 101), (7, 102), (8, 999)], "key int, tag int")
    out = hash_join(spark.createDataFrame([(7,), (8,), (9,)], "key int"), build, ["key"], ["key"])
    assert out.columns == ["key", "key_build", "tag"]
    assert sorted(r["tag"] for r in out.collect()) == [100, 101, 102, 999]


def test_null_join_keys(spark):
    a = spark.createDataFrame([(None, 1, "p"), (1, None, "q"), (1, 1, "r")], "x int, y int, n string")
    b = spark.createDataFrame([(None, 1, "s"), (1, None, "t")], "x int, y int, m string")
    pairs = lambda mode: sorted((r["n"], r["m"]) for r in hash_join(a, b, ["x", "y"], ["x", "y"], mode).collect())
    assert pairs("reference") == [("p", "s"), ("q", "t")]
    assert pairs("sql") == []


def test_join_mistakes(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("1",)], "x string")
    for bad in (([], []), (["x"], ["x"]), (["x"], ["y"])):
        with pytest.raises(EngineError):
            hash_join(a, b, *bad)
    with pytest.raises(EngineError):
        hash_join(a, a, ["x"], ["x"], strategy="nested")


def test_limit_and_project(fact):
    rows, df = fact
    assert [tuple(r) for r in collect(limit(df, 37))] == rows[:37]
    assert limit(df, 0).count() == 0
    with pytest.raises(EngineError):
        limit(df, -1)
    out = project(limit(df, 1000), ["day", ("twice", col("amount") * 2.0)])
    assert [tuple(r) for r in out.collect()] == [(r[0], r[2] * 2) for r in rows[:1000]]


def test_query_chain_and_counters(spark, stored):
    rows, path = stored
    q = table(spark, path, where=[("day", ">=", 1000)]).filter(col("mode") == "AIR").aggregate(["mode"], [count_rows("n")])
    assert str(q).splitlines() == ["aggregate mode, n", "  filter (mode = 'AIR')", f"    scan {path} where (day >= 1000)"]
    want = sum(r[0] >= 1000 and r[3] == "AIR" for r in rows)
    assert q.collect() == [("AIR", want)]
    assert run(q.df).filter_rows_out == want and "PushedFilters" in q.explain()
    named = spark.createDataFrame([("AIR", 1)], "mode string, code int")
    joined = table(spark, path).join(named, ["mode"]).transform(lambda df: df.select("code")).limit(5)
    assert joined.count() == 5
    joined = table(spark, path).join(named, ["mode"], strategy="merge")
    assert run(joined.df).join_rows_out == sum(r[3] == "AIR" for r in rows)
