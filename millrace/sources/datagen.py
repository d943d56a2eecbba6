"""A synthetic fact table, the same for a seed at any parallelism."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import EngineError

#: Ship modes of the generated table.
MODES = ("AIR", "RAIL", "SHIP", "TRUCK", "MAIL", "FOB", "REG AIR")


def generate(spark: SparkSession, rows: int, seed: int = 42, clustered: bool = True) -> DataFrame:
    """``day`` (64 rows each from 8000, in order), ``customer``, ``price`` below 1000, ``mode``.

    Columns are hashes of the row number, so rows don't depend on partitions.
    With ``clustered=False``, days are dealt out at random instead.
    """
    if rows < 0:
        raise EngineError("a table has no negative number of rows")
    draw = lambda name, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("id")), F.lit(n))
    day = F.floor(F.col("id") / 64) if clustered else draw("day", max(1, -(-rows // 64)))
    return spark.range(rows).select(
        (F.lit(8000) + day).cast("int").alias("day"),
        draw("customer", 200_000).cast("long").alias("customer"),
        (draw("price", 100_000) / 100).cast("double").alias("price"),
        F.element_at(F.array(*[F.lit(m) for m in MODES]), (draw("mode", len(MODES)) + 1).cast("int")).alias("mode"),
    )
