"""Sinks that take rows batch by batch.

A sink gets every batch of a plan and is told when there are no more. Batches
are the micro-batches of a structured stream over a folder of Parquet files, or
one batch of a DataFrame.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Sink(Protocol):
    def consume(self, batch: DataFrame) -> None:
        """Takes a batch."""

    def finish(self) -> None:
        """Hears that the last batch has come."""


class CountingSink:
    """Counts rows."""

    def __init__(self):
        self.rows, self.finished = 0, False

    def consume(self, batch: DataFrame) -> None:
        self.rows += batch.count()

    def finish(self) -> None:
        self.finished = True


def drain(df: DataFrame, sink: Sink) -> None:
    """Sends a DataFrame to a sink as one batch."""
    sink.consume(df)
    sink.finish()


def drain_files(spark: SparkSession, path: str, schema: T.StructType, sink: Sink, checkpoint: str, files_per_batch: int = 64, step=lambda df: df) -> None:
    """Sends the files of a folder that ``checkpoint`` doesn't list yet to a sink, in batches.

    ``step`` is applied to the stream first (filter, project). A restart with
    the same checkpoint goes on after the last completed batch.
    """
    stream = step(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path))
    query = stream.writeStream.foreachBatch(lambda batch, _: sink.consume(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    sink.finish()
