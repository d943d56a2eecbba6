"""Parquet tables with row groups of a chosen size.

A table is complete once its commit mark is there; a folder without it, as an
aborted write leaves behind, is refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.errors import EngineError, engine_errors

ROWS_PER_GROUP = 65_536
MARK = "_SUCCESS"


def _filesystem(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def write_table(
    df: DataFrame,
    path: str,
    rows_per_group: int = ROWS_PER_GROUP,
    cluster_by: Sequence[str] = (),
    files: int | None = None,
    mode: str = "overwrite",
    compression: str = "snappy",
) -> None:
    """Writes a table; with ``cluster_by``, rows are range-partitioned and sorted by those columns.

    Clustering is what makes row groups skippable: each then holds a narrow
    range. Every task writes its own file, and the commit mark comes last.
    """
    if rows_per_group < 1:
        raise EngineError("a row group has a row at least")
    if cluster_by:
        df = (df.repartitionByRange(files, *cluster_by) if files else df.repartitionByRange(*cluster_by)).sortWithinPartitions(*cluster_by)
    elif files:
        df = df.repartition(files)
    with engine_errors(f"cannot write {path}"):
        (
            df.write.mode(mode)
            .option("parquet.block.row.count.limit", rows_per_group)
            .option("parquet.page.row.count.limit", min(rows_per_group, 20_000))
            .option("compression", compression)
            .option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
            .parquet(path)
        )


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A table, refused where it isn't there, isn't complete or isn't Parquet."""
    with engine_errors(f"cannot open {path}"):
        fs, target = _filesystem(spark, path)
        if not fs.exists(target):
            raise EngineError(f"cannot open {path}: it does not exist")
        if fs.getFileStatus(target).isDirectory() and not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(target, MARK)):
            raise EngineError(f"cannot open {path}: its writing was not completed")
        df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


class TableWriter:
    """Appends DataFrames of one schema to a table that exists once it is finished.

    Appended parts wait in a staging folder beside the table. ``finish`` writes
    them as one table; a writer that is dropped before leaves no table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, rows_per_group: int = ROWS_PER_GROUP):
        self.spark, self.path, self.schema, self.rows_per_group = spark, path, schema, rows_per_group
        self.staging = f"{path.rstrip('/')}.staging"
        self.parts = 0
        self.finished = False

    def append(self, df: DataFrame) -> None:
        if self.finished:
            raise EngineError("the table is finished")
        if len(df.columns) != len(self.schema.fields):
            raise EngineError(f"{len(df.columns)} columns where the table has {len(self.schema.fields)}")
        for have, want in zip(df.schema.fields, self.schema.fields, strict=True):
            if have.dataType != want.dataType:
                raise EngineError(f"column {want.name} is {want.dataType.simpleString()}, not {have.dataType.simpleString()}")
        with engine_errors(f"cannot write {self.path}"):
            df.toDF(*self.schema.names).write.mode("overwrite").parquet(f"{self.staging}/part={self.parts}")
        self.parts += 1

    def finish(self, cluster_by: Sequence[str] = ()) -> int:
        """Completes the table and returns its number of rows."""
        if self.finished:
            raise EngineError("the table is finished")
        rows = self.spark.read.schema(self.schema).parquet(self.staging) if self.parts else self.spark.createDataFrame([], self.schema)
        write_table(rows.select(*self.schema.names), self.path, self.rows_per_group, cluster_by)
        fs, target = _filesystem(self.spark, self.staging)
        fs.delete(target, True)
        self.finished = True
        return self.spark.read.parquet(self.path).count()
