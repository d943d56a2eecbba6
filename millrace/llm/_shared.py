"""What the corpus operators share: scratch space, input shaping, ranks and ids."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The words of the contracts: everything between ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """The shared folder of the session (``spark.checkpoint.dir``).

    Where the setting is missing, as in tests, a local folder is made once; a
    cluster must name one that all its executors share.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="millrace-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def settle(df: DataFrame) -> DataFrame:
    """Computes ``df`` once into a reliable checkpoint.

    Meant for narrow rows (ids, counts, spans). Where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on, Spark's cleaner
    removes the files when no plan refers to them any more.
    """
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets go of shuffle files and checkpoints that no plan refers to any more.

    Spark removes them when the driver's memory is collected, which a driver with
    room to spare puts off, while many small files of finished rounds add up.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stage(df: DataFrame, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Computes ``df`` once into a Parquet table in the shared folder; the table, and where it is."""
    spark = df.sparkSession
    path = f"{scratch(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """As :func:`stage`, for a table that the result reads, which stays until its owner removes it."""
    return stage(df, codec)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table that no plan reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def free_prefix(*columns: list[str]) -> str:
    """A prefix that no column's name begins with, for columns that are added and dropped again."""
    names = [c.lower() for group in columns for c in group]
    prefix = "_"
    while any(c.startswith(prefix) for c in names):
        prefix += "_"
    return prefix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks_for(rows: int, per_block: int) -> int:
    return max(1, -(-rows // per_block))


def dense_rank_ids(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    block: Column,
    out: str,
    base: DataFrame | None = None,
) -> DataFrame:
    """Numbers the rows of each group from 0 without sorting a group in one task.

    ``block`` splits a group into bounded parts. Parts are counted first (a row
    per group and part), running totals of those counts give each part its
    first number, and rows are numbered inside their part only.
    """
    p = free_prefix(df.columns, base.columns if base is not None else [])
    df = df.withColumn(f"{p}block", block)
    keys = [*group, f"{p}block"]
    counts = (base.withColumn(f"{p}block", block) if base is not None else df).groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{p}n"))
    before = Window.partitionBy(*group).orderBy(f"{p}block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(
        *[F.col(k).alias(f"{p}k_{k}") for k in keys],
        F.coalesce(F.sum(f"{p}n").over(before), F.lit(0)).alias(f"{p}first"),
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{p}k_{k}"))
    return (
        df.withColumn(f"{p}inside", inside)
        .join(first, same, "left")
        .withColumn(out, F.col(f"{p}first") + F.col(f"{p}inside"))
        .drop(*[f"{p}{x}" for x in ("block", "inside", "first")], *[f"{p}k_{k}" for k in keys])
    )
