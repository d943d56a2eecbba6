"""The engine's queries over the star-schema tables, and SQL that gives the same rows.

Sums of money are rounded or taken as decimals where they are compared, because
floating-point sums depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import Aggregate, avg, col, count, count_rows, lit, max_, min_, sum_
from millrace.functions.expressions import SQL, Compare, Expr
from millrace.functions.types import date_to_int32
from millrace.operators import aggregate, filter_rows, hash_join, limit, project, scan
from millrace.plans import table
from millrace.session import load
from millrace.storage_queries import STORAGE

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        QUERIES[name], ORACLE[name] = plan, sql
        return plan

    return add


LINE = ["l_orderkey", "l_linenumber", "l_quantity", "l_tax"]


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem")


def _with_null_tax(df: DataFrame) -> DataFrame:
    """``t`` is ``l_tax`` with zeros as nulls: the tables hold no nulls of their own."""
    return df.withColumn("t", F.nullif(F.col("l_tax"), F.lit(0.0)))


def _rows(predicate: Expr, semantics: str = "reference", null_tax: bool = False) -> Plan:
    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _lineitem(spark, sf_dir)
        return project(filter_rows(_with_null_tax(df) if null_tax else df, predicate, semantics), LINE)

    return plan


def _filter(name: str, predicate: Expr, where: str, semantics: str = "reference", null_tax: bool = False) -> None:
    QUERIES[name] = _rows(predicate, semantics, null_tax)
    ORACLE[name] = f"SELECT {', '.join(LINE)} FROM lineitem WHERE {where}"


for _name, _op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _filter(f"filter_compare_{_name}", Compare(_op, col("l_quantity"), lit(25)), f"l_quantity {_op} 25")
_filter("filter_string_eq", col("l_returnflag") == "A", "l_returnflag = 'A'")
_filter("filter_string_order", (col("l_returnflag") > "A") & (col("l_linestatus") <= "F"), "l_returnflag > 'A' AND l_linestatus <= 'F'")
_filter("filter_and", (col("l_quantity") >= 10) & (col("l_quantity") < 20) & (col("l_returnflag") == "R"), "l_quantity >= 10 AND l_quantity < 20 AND l_returnflag = 'R'")
_filter("filter_or", (col("l_quantity") < 3) | (col("l_quantity") <= 4) | (col("l_tax") > 0.07), "l_quantity < 3 OR l_quantity <= 4 OR l_tax > 0.07")
_filter("filter_or_null", (col("t") > 0.05) | (col("l_quantity") < 5), "nullif(l_tax, 0.0) > 0.05 OR l_quantity < 5", null_tax=True)
_filter("filter_not_null_kept", ~(col("t") > 0.05), "NOT coalesce(nullif(l_tax, 0.0) > 0.05, false)", null_tax=True)
_filter("filter_not_sql", ~(col("t") > 0.05), "NOT (nullif(l_tax, 0.0) > 0.05)", SQL, null_tax=True)
_filter("filter_null_compare", col("t") <= 1.0, "nullif(l_tax, 0.0) <= 1.0", null_tax=True)
_filter("filter_column_column", col("l_tax") > col("l_discount"), "l_tax > l_discount")
_filter("filter_literal_first", lit(25) < col("l_quantity"), "25 < l_quantity")
_filter("filter_arith_predicate", col("l_quantity") * col("l_tax") > 1, "l_quantity * l_tax > 1")
_filter("filter_constant_true", lit(1), "true")
_filter("filter_constant_false", lit(0), "false")


def _values(name: str, made: Expr, sql: str, semantics: str = "reference") -> None:
    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        return project(_with_null_tax(_lineitem(spark, sf_dir)), ["l_orderkey", "l_linenumber", ("value", made)], semantics)

    QUERIES[name], ORACLE[name] = plan, f"SELECT l_orderkey, l_linenumber, {sql} AS value FROM lineitem"


_values("project_arith_add", col("l_orderkey") + col("l_linenumber"), "l_orderkey + l_linenumber")
_values("project_arith_sub", col("l_linenumber") - 10, "l_linenumber - 10")
_values("project_arith_mul", col("l_extendedprice") * (lit(1) - col("l_discount")), "l_extendedprice * (1 - l_discount)")
_values("project_div_double", col("l_extendedprice") / col("l_tax"), "CASE WHEN l_tax = 0 THEN 0 ELSE l_extendedprice / l_tax END")
_values(
    "project_div_int",
    col("l_orderkey") / (col("l_linenumber") - 1),
    "CAST(CASE WHEN l_linenumber - 1 = 0 THEN 0 ELSE l_orderkey // (l_linenumber - 1) END AS BIGINT)",
)
_values(
    "project_div_int32",
    (lit(-7) * col("l_linenumber")) / (col("l_linenumber") - 3),
    "CAST(CASE WHEN l_linenumber - 3 = 0 THEN 0 ELSE trunc((-7.0 * l_linenumber) / (l_linenumber - 3)) END AS INTEGER)",
)
_values("project_null_propagation", col("t") + 1, "nullif(l_tax, 0.0) + 1")
_values("project_null_division", col("t") / (col("l_discount") - col("l_discount")), "CASE WHEN l_tax = 0 THEN NULL ELSE CAST(0 AS DOUBLE) END")


@_query("scan_project_columns", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem")
def _scan_columns(spark, sf_dir):
    return scan(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_shipdate"])


@_query("scan_where", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus = 'F'")
def _scan_where(spark, sf_dir):
    return scan(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"], [("o_totalprice", ">=", 100000.0), ("o_orderstatus", "=", "F")])


@_query("scan_no_pushdown", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 50000")
def _scan_unpruned(spark, sf_dir):
    return scan(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"], [("o_totalprice", "<", 50000.0)], pushdown=False)


@_query("scan_table_counts", "SELECT count(*) AS rows, count(DISTINCT c_nationkey) AS nations FROM customer")
def _counts(spark, sf_dir):
    keys = aggregate(load(spark, sf_dir, "customer"), ["c_nationkey"], [count_rows("n")])
    return aggregate(keys, [], [sum_("n", "rows"), count_rows("nations")])



def _price_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    out = aggregate(df, keys, [count_rows("n"), sum_("l_extendedprice", "total"), min_("l_extendedprice", "low"), max_("l_extendedprice", "high"), avg("l_extendedprice", "mean")])
    return out.withColumn("total", F.round("total", 2)).withColumn("mean", F.round("mean", 4))


_SUMMARY = "count(*) AS n, round(sum(l_extendedprice), 2) AS total, min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(avg(l_extendedprice), 4) AS mean"


@_query("agg_group_all", f"SELECT l_returnflag, {_SUMMARY} FROM lineitem GROUP BY l_returnflag")
def _group_all(spark, sf_dir):
    return _price_summary(_lineitem(spark, sf_dir), ["l_returnflag"])


@_query("agg_two_keys", f"SELECT l_returnflag, l_linestatus, {_SUMMARY} FROM lineitem GROUP BY l_returnflag, l_linestatus")
def _two_keys(spark, sf_dir):
    return _price_summary(_lineitem(spark, sf_dir), ["l_returnflag", "l_linestatus"])


@_query("agg_mixed_keys", "SELECT l_linenumber, l_returnflag, l_tax, count(*) AS n FROM lineitem GROUP BY l_linenumber, l_returnflag, l_tax")
def _mixed_keys(spark, sf_dir):
    return aggregate(_lineitem(spark, sf_dir), ["l_linenumber", "l_returnflag", "l_tax"], [count_rows("n")])


@_query("agg_null_key", "SELECT nullif(l_linenumber, 1) AS k, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS s FROM lineitem GROUP BY nullif(l_linenumber, 1)")
def _null_key(spark, sf_dir):
    return aggregate(_lineitem(spark, sf_dir).withColumn("k", F.nullif("l_linenumber", F.lit(1))), ["k"], [count_rows("n"), sum_("l_orderkey", "s")])


@_query("agg_count_star_vs_col", "SELECT l_returnflag, count(*) AS n, count(nullif(l_tax, 0.0)) AS n_tax FROM lineitem GROUP BY l_returnflag")
def _star_or_column(spark, sf_dir):
    return aggregate(_with_null_tax(_lineitem(spark, sf_dir)), ["l_returnflag"], [count_rows("n"), count("t", "n_tax")])


@_query(
    "agg_all_null_group",
    "SELECT l_tax, count(*) AS n, count(nullif(l_tax, 0.0)) AS n_t, min(nullif(l_tax, 0.0)) AS low, max(nullif(l_tax, 0.0)) AS high, round(sum(nullif(l_tax, 0.0)), 2) AS total, round(avg(nullif(l_tax, 0.0)), 4) AS mean FROM lineitem GROUP BY l_tax",
)
def _all_null(spark, sf_dir):
    out = aggregate(_with_null_tax(_lineitem(spark, sf_dir)), ["l_tax"], [count_rows("n"), count("t", "n_t"), min_("t", "low"), max_("t", "high"), sum_("t", "total"), avg("t", "mean")])
    return out.withColumn("total", F.round("total", 2)).withColumn("mean", F.round("mean", 4))


@_query(
    "agg_minmax_int_widened",
    "SELECT l_returnflag, CAST(min(l_linenumber) AS BIGINT) AS low, CAST(max(l_linenumber) AS BIGINT) AS high, CAST(sum(l_linenumber) AS BIGINT) AS total, round(avg(l_linenumber), 6) AS mean FROM lineitem GROUP BY l_returnflag",
)
def _widened(spark, sf_dir):
    out = aggregate(_lineitem(spark, sf_dir), ["l_returnflag"], [min_("l_linenumber", "low"), max_("l_linenumber", "high"), sum_("l_linenumber", "total"), avg("l_linenumber", "mean")])
    return out.withColumn("mean", F.round("mean", 6))


@_query("agg_minmax_string", "SELECT l_linenumber, min(l_returnflag) AS low, max(l_linestatus) AS high FROM lineitem GROUP BY l_linenumber")
def _string_extremes(spark, sf_dir):
    return aggregate(_lineitem(spark, sf_dir), ["l_linenumber"], [min_("l_returnflag", "low"), max_("l_linestatus", "high")])


@_query("agg_expression_input", "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM lineitem GROUP BY l_returnflag")
def _expression_input(spark, sf_dir):
    df = project(_lineitem(spark, sf_dir), ["l_returnflag", ("r", col("l_extendedprice") * (lit(1) - col("l_discount")))])
    return df.groupBy("l_returnflag").agg(F.sum(F.col("r").cast("decimal(18,4)")).cast("double").alias("revenue"))


@_query("agg_global", f"SELECT {_SUMMARY} FROM lineitem")
def _global(spark, sf_dir):
    return _price_summary(_lineitem(spark, sf_dir), [])


@_query("agg_global_empty", "SELECT count(*) AS n FROM lineitem WHERE l_quantity < 0 HAVING count(*) > 0")
def _global_empty(spark, sf_dir):
    return aggregate(filter_rows(_lineitem(spark, sf_dir), col("l_quantity") < 0), [], [count_rows("n")])


@_query("agg_global_empty_sql", "SELECT count(*) AS n, sum(l_quantity) AS s FROM lineitem WHERE l_quantity < 0")
def _global_empty_sql(spark, sf_dir):
    return aggregate(filter_rows(_lineitem(spark, sf_dir), col("l_quantity") < 0), [], [count_rows("n"), sum_("l_quantity", "s")], SQL)


@_query("agg_grouped_empty", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity < 0 GROUP BY l_returnflag")
def _grouped_empty(spark, sf_dir):
    return aggregate(filter_rows(_lineitem(spark, sf_dir), col("l_quantity") < 0), ["l_returnflag"], [count_rows("n")])


@_query("agg_distinct_keys", "SELECT DISTINCT l_linenumber, l_returnflag FROM lineitem")
def _distinct(spark, sf_dir):
    return aggregate(_lineitem(spark, sf_dir), ["l_linenumber", "l_returnflag"], [])


@_query("agg_high_cardinality", "SELECT l_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_orderkey")
def _high_cardinality(spark, sf_dir):
    return aggregate(_lineitem(spark, sf_dir), ["l_orderkey"], [count_rows("n"), sum_("l_quantity", "quantity")]).withColumn("quantity", F.round("quantity", 2))


@_query("agg_having", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 7")
def _having(spark, sf_dir):
    return filter_rows(aggregate(_lineitem(spark, sf_dir), ["l_orderkey"], [count_rows("n")]), col("n") >= 7)


@_query("join_inner", "SELECT l_orderkey, l_linenumber, l_quantity, o_orderkey, o_custkey, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _join(spark, sf_dir):
    probe = _lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity")
    return hash_join(probe, load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["l_orderkey"], ["o_orderkey"])


@_query("join_unmatched_probe", "SELECT o_orderkey, o_custkey, c_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0")
def _unmatched(spark, sf_dir):
    build = filter_rows(load(spark, sf_dir, "customer"), col("c_acctbal") < 0).select("c_custkey", "c_mktsegment")
    return hash_join(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), build, ["o_custkey"], ["c_custkey"])


@_query("join_duplicate_build", "SELECT o_orderkey, o_orderstatus, l_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def _duplicates(spark, sf_dir):
    build = _lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey")
    return hash_join(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), build, ["o_orderkey"], ["l_orderkey"])


@_query(
    "join_multi_key",
    "SELECT s_suppkey, c_custkey, s_nationkey, n_name FROM (SELECT s_suppkey, c_custkey, s_nationkey, c_nationkey FROM supplier JOIN customer ON s_suppkey = c_custkey) JOIN nation ON s_nationkey = n_nationkey AND c_nationkey = n_nationkey",
)
def _multi_key(spark, sf_dir):
    probe = hash_join(load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), ["s_suppkey"], ["c_custkey"])
    build = load(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").alias("n_again"), "n_name")
    return hash_join(probe, build, ["s_nationkey", "c_nationkey"], ["n_nationkey", "n_again"]).select("s_suppkey", "c_custkey", "s_nationkey", "n_name")


_NULL_KEYS = "(SELECT n_nationkey, nullif(n_regionkey, 1) AS k FROM nation) a JOIN (SELECT r_name, nullif(r_regionkey, 1) AS k FROM region) b"


def _null_keyed(spark, sf_dir):
    a = load(spark, sf_dir, "nation").select("n_nationkey", F.nullif("n_regionkey", F.lit(1)).alias("k"))
    return a, load(spark, sf_dir, "region").select("r_name", F.nullif("r_regionkey", F.lit(1)).alias("k"))


@_query("join_null_keys", f"SELECT n_nationkey, a.k AS k, r_name FROM {_NULL_KEYS} ON a.k IS NOT DISTINCT FROM b.k")
def _null_keys(spark, sf_dir):
    return hash_join(*_null_keyed(spark, sf_dir), ["k"], ["k"]).drop("k_build")


@_query("join_null_keys_sql", f"SELECT n_nationkey, a.k AS k, r_name FROM {_NULL_KEYS} ON a.k = b.k")
def _null_keys_sql(spark, sf_dir):
    return hash_join(*_null_keyed(spark, sf_dir), ["k"], ["k"], SQL).drop("k_build")


@_query("join_empty_build", "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < -100000")
def _empty_build(spark, sf_dir):
    build = filter_rows(load(spark, sf_dir, "customer"), col("c_acctbal") < -100000).select("c_custkey")
    return hash_join(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), build, ["o_custkey"], ["c_custkey"]).drop("o_custkey")


for _strategy in ("broadcast", "shuffle_hash", "merge"):

    def _with_strategy(spark, sf_dir, strategy=_strategy):
        build = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
        probe = _lineitem(spark, sf_dir).select("l_orderkey", "l_partkey", "l_quantity")
        return aggregate(hash_join(probe, build, ["l_partkey"], ["p_partkey"], strategy=strategy), ["p_brand"], [count_rows("n")])

    QUERIES[f"join_{_strategy}"] = _with_strategy
    ORACLE[f"join_{_strategy}"] = "SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"


@_query(
    "join_then_agg",
    "SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
)
def _join_agg(spark, sf_dir):
    probe = project(_lineitem(spark, sf_dir), ["l_orderkey", ("r", col("l_extendedprice") * (lit(1) - col("l_discount")))])
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = hash_join(hash_join(probe, orders, ["l_orderkey"], ["o_orderkey"]), customers, ["o_custkey"], ["c_custkey"])
    return joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("r").cast("decimal(18,4)")).cast("double").alias("revenue"))


@_query("limit_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 37")
def _limit(spark, sf_dir):
    return limit(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey"), 37)


@_query("limit_zero", "SELECT o_orderkey FROM orders LIMIT 0")
def _limit_zero(spark, sf_dir):
    return limit(load(spark, sf_dir, "orders").select("o_orderkey"), 0)


@_query("date_as_int32", "SELECT l_orderkey, l_linenumber, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS day FROM lineitem")
def _date(spark, sf_dir):
    return _lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", date_to_int32("l_shipdate").alias("day"))


@_query("string_groupby_sum", "SELECT l_returnflag, count(*) AS count, round(sum(l_extendedprice), 2) AS sum FROM lineitem WHERE l_quantity >= 40 GROUP BY l_returnflag")
def flagship(spark, sf_dir):
    """Scan, filter, group by a string, count and sum."""
    query = table(spark, f"{sf_dir}/lineitem.parquet", ["l_returnflag", "l_extendedprice"], [("l_quantity", ">=", 40.0)])
    return query.aggregate(["l_returnflag"], [count_rows("count"), sum_("l_extendedprice", "sum")]).df.withColumn("sum", F.round("sum", 2))


@_query("events_by_type", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE value >= 0 GROUP BY event_type")
def _events(spark, sf_dir):
    per_user = aggregate(filter_rows(load(spark, sf_dir, "events"), col("value") >= 0), ["event_type", "user_id"], [count_rows("k")])
    return aggregate(per_user, ["event_type"], [sum_("k", "n"), count_rows("users")])


for _name, (_plan, _sql) in STORAGE.items():
    QUERIES[_name], ORACLE[_name] = _plan, _sql
