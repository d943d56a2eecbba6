"""Table scans: column pruning, predicates at the scan, and scans without pruning."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.errors import EngineError, engine_errors
from millrace.functions.expressions import Compare, ColumnRef, Literal, parse_comparison


@dataclass(frozen=True)
class Pushdown:
    """``column op literal``; several are ANDed."""

    column: str
    op: str
    literal: object

    def expr(self) -> Compare:
        return Compare(parse_comparison(self.op), ColumnRef(self.column), Literal(self.literal))


def scan(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    where: Sequence[Pushdown | tuple] = (),
    pushdown: bool = True,
    schema: T.StructType | None = None,
) -> DataFrame:
    """A table's columns, in the given order, and only the rows for which all of ``where`` hold.

    Row groups that cannot hold such rows are skipped by their statistics, and
    columns that nothing needs are not read. Without ``pushdown`` every row
    group is read and the rows are the same.
    """
    if not pushdown:
        spark = spark.newSession()
        spark.conf.set("spark.sql.parquet.filterPushdown", "false")
    with engine_errors(f"cannot open {path}"):
        reader = spark.read if schema is None else spark.read.schema(schema)
        df = reader.parquet(path)
    for term in where:
        term = term if isinstance(term, Pushdown) else Pushdown(*term)
        df = df.filter(term.expr().predicate(df.schema))
    if columns is None:
        return df
    if not columns:
        raise EngineError("a scan needs a column")
    return df.select(*[ColumnRef(c).value(df.schema) for c in columns])
