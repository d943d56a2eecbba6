"""Queries of the storage side: what is written, reported, skipped and counted.

Layouts depend on how many tasks write, so queries return what holds for any
layout: the rows that come back, and whether a report agrees with the rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import EngineError
from millrace.functions import col, lit
from millrace.operators import filter_rows, hash_join, scan
from millrace.plans.metrics import run
from millrace.session import load
from millrace.sources import TableWriter, can_contain, prune_estimate, read_table, table_report, write_table
from millrace.sources.datagen import generate
from millrace.sources.encodings import DICT, FOR, PLAIN, RLE
from millrace.sources.inspect import ColumnRange
from millrace.sources.segments import read_segments, segment_report, write_segments
from millrace.streaming import CountingSink, drain, drain_files

#: name -> (plan, SQL)
STORAGE: dict[str, tuple] = {}


def _query(name: str, sql: str):
    def add(plan):
        STORAGE[name] = (plan, sql)
        return plan

    return add


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, or in the warehouse where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _one_row(spark: SparkSession, **values) -> DataFrame:
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


_COLUMNS = {
    PLAIN: ["l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag"],
    FOR: ["l_orderkey", "l_linenumber", "l_partkey"],
    DICT: ["l_orderkey", "l_linenumber", "l_discount", "l_returnflag"],
    RLE: ["l_orderkey", "l_linenumber", "l_quantity"],
}


def _add_round_trips() -> None:
    for encoding, names in _COLUMNS.items():

        def plan(spark: SparkSession, sf_dir: str, encoding=encoding, names=names) -> DataFrame:
            df = load(spark, sf_dir, "lineitem").select(*names)
            path = folder(spark, "segments")
            write_segments(df, path, rows_per_group=4096, cluster_by=["l_orderkey", "l_linenumber"], encodings=dict.fromkeys(names, encoding))
            return read_segments(spark, path)

        STORAGE[f"segment_roundtrip_{encoding.lower()}"] = (plan, f"SELECT {', '.join(names)} FROM lineitem")


_add_round_trips()

#: A range that holds some keys at every scale.
_LOW, _HIGH = 450, 500
_IN_RANGE = f"o_orderkey >= {_LOW} AND o_orderkey < {_HIGH}"
_TERMS = [("o_orderkey", ">=", _LOW), ("o_orderkey", "<", _HIGH)]


def _clustered_orders(spark: SparkSession, sf_dir: str, rows_per_group: int = 256) -> str:
    path = folder(spark, "clustered")
    write_table(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), path, rows_per_group=rows_per_group, cluster_by=["o_orderkey"])
    return path


@_query("segment_pruned", f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE {_IN_RANGE}")
def _segment_pruned(spark, sf_dir):
    path = folder(spark, "segments")
    write_segments(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), path, rows_per_group=256, cluster_by=["o_orderkey"])
    return read_segments(spark, path, where=_TERMS)


@_query("pushdown_same_rows", f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE {_IN_RANGE}")
def _pushdown(spark, sf_dir):
    """Orders written in key order with small row groups, read back with a range on the key."""
    return scan(spark, _clustered_orders(spark, sf_dir), where=_TERMS)


@_query(
    "prune_report",
    f"SELECT count(*) AS rows_total, count(*) FILTER ({_IN_RANGE}) AS rows_matching, true AS none_lost, true AS groups_skipped, true AS rows_skipped FROM orders",
)
def _prune_report(spark, sf_dir):
    """A scan's estimate and its counters, with and without pushdown, of a table in key order."""
    path = _clustered_orders(spark, sf_dir)
    found, whole = prune_estimate(spark, path, _TERMS), prune_estimate(spark, path)
    pruned = run(scan(spark, path, where=_TERMS))
    every = run(scan(spark, path, where=_TERMS, pushdown=False))
    return _one_row(
        spark,
        rows_total=whole.rows_read,
        rows_matching=pruned.rows,
        none_lost=pruned.rows == every.rows and pruned.rows <= found.rows_read,
        groups_skipped=found.groups_read < found.groups_total and 0 < found.skip_rate < 1 and whole.skip_rate == 0,
        rows_skipped=pruned.rows_scanned < every.rows_scanned == whole.rows_read,
    )


_OPS = ("=", "<>", "<", "<=", ">", ">=")
_TESTS = {"=": "low <= v AND v <= high", "<>": "NOT (low = v AND high = v)", "<": "low < v", "<=": "low <= v", ">": "high > v", ">=": "high >= v"}


@_query(
    "zone_map_test",
    "WITH z AS (SELECT n_regionkey AS zone, min(n_nationkey) AS low, max(n_nationkey) AS high FROM nation GROUP BY ALL), "
    "v AS (SELECT unnest([-1, 0, 4, 12, 24, 30]) AS v) "
    + " UNION ALL ".join(f"SELECT zone, '{op}' AS op, CAST(v AS BIGINT) AS v, {test} AS may FROM z, v" for op, test in _TESTS.items()),
)
def _zone_map(spark, sf_dir):
    """Each range against each comparison: a row per region, operator and literal."""
    zones = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.min("n_nationkey").alias("low"), F.max("n_nationkey").alias("high")).collect()
    rows = []
    for z in zones:
        found = ColumnRange("n_nationkey", z["n"], 0, z["low"], z["high"], 0, "PLAIN")
        rows += [(z["n_regionkey"], op, v, can_contain(found, op, v)) for op in _OPS for v in (-1, 0, 4, 12, 24, 30)]
    return spark.createDataFrame(rows, "zone long, op string, v long, may boolean").withColumn("zone", F.col("zone").cast(load(spark, sf_dir, "nation").schema["n_regionkey"].dataType))


_REPORTED = ("c_custkey", "c_nationkey", "c_mktsegment")


def _report_sql(nulls: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({nulls.format(c)} AS BIGINT) AS nulls, min({c}) || ' .. ' || max({c}) AS range, true AS sized FROM customer" for c in _REPORTED)


@_query("info_report", _report_sql("count(*) - count({})"))
def _info(spark, sf_dir):
    path = folder(spark, "info")
    write_table(load(spark, sf_dir, "customer").select(*_REPORTED), path, rows_per_group=512)
    return table_report(spark, path).select("column", "nulls", F.regexp_replace("range", '"', "").alias("range"), ((F.col("bits_per_row") > 0) & (F.col("encoding") != "")).alias("sized"))


@_query("segment_info_report", _report_sql("count(*) - count({})"))
def _segment_info(spark, sf_dir):
    path = folder(spark, "info")
    write_segments(load(spark, sf_dir, "customer").select(*_REPORTED), path, rows_per_group=512)
    return segment_report(spark, path).select("column", "nulls", "range", ((F.col("bits_per_row") > 0) & (F.col("bits_per_row") < 200) & (F.col("encoding") != "")).alias("sized"))


@_query("gen_summary", "SELECT CAST(100000 AS BIGINT) AS n, 8000 AS first_day, CAST(8000 + 99999 // 64 AS INTEGER) AS last_day, CAST(1563 AS BIGINT) AS days, CAST(7 AS BIGINT) AS modes, true AS in_range, true AS same_again")
def _gen(spark, sf_dir):
    """The generated table's shape, and that it doesn't depend on partitions."""
    make = lambda parts: generate(spark.newSession(), 100_000).repartition(parts) if parts else generate(spark, 100_000)
    check = lambda df: df.agg(F.bit_xor(F.xxhash64(*df.columns))).head()[0]
    df = make(0)
    inside = F.min(F.col("customer").between(0, 199_999) & (F.col("price") >= 0) & (F.col("price") < 1000))
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_distinct("day").alias("days"), F.count_distinct("mode").alias("modes"), inside.alias("in_range"), F.lit(check(df) == check(make(3))).alias("same_again")
    )


@_query("sink_counts", "SELECT count(*) AS drained, count(*) AS streamed, count(*) FILTER (o_totalprice > 100000) AS filtered, true AS finished FROM orders")
def _sinks(spark, sf_dir):
    """Rows that sinks receive from a DataFrame, from a stream of files, and behind a filter."""
    df = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    path = folder(spark, "stream")
    write_table(df, path, files=5)
    sinks = [CountingSink() for _ in range(3)]
    drain(df, sinks[0])
    drain_files(spark, path, df.schema, sinks[1], folder(spark, "progress"), files_per_batch=2)
    drain_files(spark, path, df.schema, sinks[2], folder(spark, "progress"), step=lambda x: filter_rows(x, col("o_totalprice") > 100000.0))
    return _one_row(spark, drained=sinks[0].rows, streamed=sinks[1].rows, filtered=sinks[2].rows, finished=all(s.finished for s in sinks))


@_query("filter_counters", "SELECT count(*) AS scanned, count(*) FILTER (l_quantity * 2 > 50) AS passed, count(*) FILTER (l_quantity * 2 > 50) AS rows_out FROM lineitem")
def _filter_counters(spark, sf_dir):
    report = run(filter_rows(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"), (col("l_quantity") * lit(2.0)) > lit(50.0)))
    return _one_row(spark, scanned=report.rows_scanned, passed=report.filter_rows_out, rows_out=report.rows)


@_query("join_counters", "SELECT (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM part) AS scanned, count(*) AS joined, count(*) AS rows_out FROM lineitem JOIN part ON l_partkey = p_partkey")
def _join_counters(spark, sf_dir):
    report = run(hash_join(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), load(spark, sf_dir, "part").select("p_partkey", "p_brand"), ["l_partkey"], ["p_partkey"]))
    return _one_row(spark, scanned=report.rows_scanned, joined=report.join_rows_out, rows_out=report.rows)


@_query("writer_appends", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")
def _writer(spark, sf_dir):
    """A table made of two appended parts; it can't be read before it is finished."""
    df, path = load(spark, sf_dir, "nation").select("n_nationkey", "n_name"), folder(spark, "appended")
    writer = TableWriter(spark, path, df.schema)
    for _ in range(2):
        writer.append(df)
    if not _refused(lambda: read_table(spark, path)):
        raise EngineError("an unfinished table was opened")
    writer.finish()
    return read_table(spark, path)


def _refused(action) -> bool:
    try:
        action()
    except EngineError:
        return True
    return False


@_query(
    "refusals",
    "SELECT unnest(['missing table', 'incomplete table', 'no Parquet', 'more columns', 'other type', 'unknown column', 'no rows in a group']) AS what, true AS refused",
)
def _refusals(spark, sf_dir):
    """What must not be opened or written, and whether it was refused."""
    df, path = load(spark, sf_dir, "nation").select("n_nationkey", "n_name"), folder(spark, "broken")
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/incomplete")
    df.select("n_name").write.text(f"{path}/text")
    write_segments(df, f"{path}/segments")
    writer = TableWriter(spark, f"{path}/writer", df.schema)
    tried = {
        "missing table": lambda: read_table(spark, f"{path}/nothing"),
        "incomplete table": lambda: read_table(spark, f"{path}/incomplete"),
        "no Parquet": lambda: read_table(spark, f"{path}/text"),
        "more columns": lambda: writer.append(df.withColumn("x", F.lit(1))),
        "other type": lambda: writer.append(df.withColumn("n_name", F.lit(1))),
        "unknown column": lambda: read_segments(spark, f"{path}/segments", ["x"]),
        "no rows in a group": lambda: write_table(df, f"{path}/none", rows_per_group=0),
    }
    return spark.createDataFrame([(what, _refused(action)) for what, action in tried.items()], "what string, refused boolean")
