"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the threads.
Every query runs once to warm up and then three times (``BENCH_RUNS``); the
median counts. Rows go to Spark's no-op sink, so nothing is collected. The
source tables have one row group each, which only one task can read, so tables
that a query scans are first written again with several row groups; that time is
reported apart.

A query costs a fixed time, whatever it reads. Scans and the conjunction run over
``BENCH_FACT_ROWS`` rows and, where ``BENCH_FACT_TIMES`` is above 1, over that many
times as many, which adds their rates as added rows over added seconds. The published
conjunction and join work on columns that are in memory, so theirs are cached here.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from statistics import median

from pyspark.sql import SparkSession

from millrace import queries as engine
from millrace.functions import col, count_rows, sum_
from millrace.operators import aggregate, hash_join, scan
from millrace.plans import run
from millrace.session import session
from millrace.sources import prune_estimate, write_table
from millrace.sources.datagen import generate

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
#: Rows of the generated fact table, as in the published scan figures.
FACT_ROWS = int(os.environ.get("BENCH_FACT_ROWS", "8000000"))
FACT_TIMES = int(os.environ.get("BENCH_FACT_TIMES", "1"))
TABLES = ("lineitem", "orders", "customer", "part", "supplier", "nation", "region", "events")
HEADLINE = (
    "string_groupby_sum",
    "scan_project_columns",
    "filter_compare_ge",
    "filter_string_eq",
    "filter_and",
    "filter_not_null_kept",
    "project_arith_mul",
    "project_div_int",
    "agg_group_all",
    "agg_two_keys",
    "agg_high_cardinality",
    "agg_global",
    "agg_distinct_keys",
    "join_inner",
    "join_duplicate_build",
    "join_broadcast",
    "join_then_agg",
    "limit_n",
)


def timed(make) -> float:
    def once() -> float:
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    once()
    return median(once() for _ in range(RUNS))


def scans(spark: SparkSession, work: str, rows: int, mark: str, seconds: dict[str, float], extra: dict[str, object]) -> None:
    """Times scans of a fact table of ``rows`` rows, and a conjunction; their names end in ``mark``."""
    for layout in ("clustered", "shuffled"):
        path = f"{work}/fact{mark}_{layout}"
        write_table(generate(spark, rows, clustered=layout == "clustered"), path, cluster_by=["day"] if layout == "clustered" else (), files=CPUS)
        where = [("day", ">=", 8000 + rows // 64 * 9 // 10)]
        seconds[f"prune_{layout}{mark}"] = timed(lambda path=path, where=where: scan(spark, path, ["day", "price"], where))
        groups, ran = prune_estimate(spark, path, where), run(scan(spark, path, ["day", "price"], where))
        extra[f"prune_{layout}{mark}"] = {"groups_read": groups.groups_read, "groups_total": groups.groups_total, "skipped": round(groups.skip_rate, 4), "rows_decoded": ran.rows_scanned, "rows_out": ran.rows}
    fact = f"{work}/fact{mark}_clustered"
    seconds[f"fact_scan_1_column{mark}"] = timed(lambda: aggregate(scan(spark, fact, ["price"]), [], [sum_("price")]))
    seconds[f"fact_scan_4_columns{mark}"] = timed(lambda: scan(spark, fact))
    seconds[f"fact_scan_string_eq{mark}"] = timed(lambda: scan(spark, fact, ["mode", "price"], [("mode", "=", "AIR")]))
    both = spark.range(rows).selectExpr("CAST(pmod(xxhash64(id), 100) AS INT) a", "CAST(pmod(xxhash64(id, 1), 100) AS INT) b").cache()
    seconds[f"conjunction{mark}"] = timed(lambda: aggregate(both.filter(((col("a") < 2) & (col("b") < 50)).predicate(both.schema)), [], [count_rows()]))
    both.unpersist(True)


def main() -> None:
    spark = session("bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=str(CPUS), spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    work = tempfile.mkdtemp(prefix="millrace-bench-")
    seconds: dict[str, float] = {}
    extra: dict[str, object] = {}
    try:
        began = time.perf_counter()
        for t in TABLES:
            write_table(spark.read.parquet(f"{SF_DIR}/{t}.parquet"), f"{work}/{t}.parquet", files=CPUS if t in ("lineitem", "orders") else 1)
        extra["rewrite_sec"] = round(time.perf_counter() - began, 3)
        for name in HEADLINE:
            seconds[name] = timed(lambda name=name: engine.QUERIES[name](spark, work))

        for rows, mark in ((FACT_ROWS, ""), (FACT_ROWS * FACT_TIMES, "_large"))[: min(FACT_TIMES, 2)]:
            scans(spark, work, rows, mark, seconds, extra)
        for groups in (8, 1024, 65536, 1_000_000):
            keyed = spark.range(FACT_ROWS // 2).selectExpr(f"pmod(xxhash64(id), {groups}) key", "1.0D value")
            seconds[f"aggregate_{groups}_groups"] = timed(lambda keyed=keyed: aggregate(keyed, ["key"], [sum_("value")]))
        probe = spark.range(FACT_ROWS // 2).selectExpr("pmod(xxhash64(id), 500000) key").cache()
        build = spark.range(500_000).selectExpr("id key", "id * 3 value").cache()
        seconds["join_4m_500k"] = timed(lambda: aggregate(hash_join(probe, build, ["key"], ["key"]), [], [count_rows()]))
    finally:
        shutil.rmtree(work, ignore_errors=True)
        spark.stop()
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    scanned = ("fact_scan_1_column", "fact_scan_4_columns", "fact_scan_string_eq", "prune_clustered", "prune_shuffled", "conjunction")
    grouped = [n for n in seconds if n.startswith(("aggregate_", "join_4m"))]
    extra["million_rows_per_sec"] = {k: round(n / seconds[k] / 1e6, 1) for names, n in ((scanned, FACT_ROWS), (grouped, FACT_ROWS // 2)) for k in names}
    added = {k: seconds[f"{k}_large"] - seconds[k] for k in scanned if FACT_TIMES > 1}
    extra["million_added_rows_per_added_sec"] = {k: round(FACT_ROWS * (FACT_TIMES - 1) / s / 1e6, 1) if s > 0 else None for k, s in added.items()}
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds[n] for n in HEADLINE), 3), "unit": "sec", "queries": {k: round(v, 4) for k, v in seconds.items()}, "sf": sf, "cpus": CPUS, **extra}))


if __name__ == "__main__":
    sys.exit(main())
