"""COUNT, SUM, MIN, MAX and AVG.

Counts are INT64 and averages DOUBLE. SUM, MIN and MAX are DOUBLE for DOUBLE
input and INT64 for whole numbers. A group without values has null for all but
COUNT. MIN and MAX also take strings, which stay strings; SUM and AVG don't.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import EngineError
from millrace.functions.expressions import REFERENCE, ColumnRef, Expr
from millrace.functions.types import DOUBLE, INT64, STRING

FUNCTIONS = ("count", "sum", "min", "max", "avg")


@dataclass(frozen=True)
class Aggregate:
    """``function`` of ``input`` (a column or a value expression; None counts rows), called ``name``."""

    function: str
    input: Expr | None
    name: str

    def __post_init__(self):
        if self.function not in FUNCTIONS:
            raise EngineError(f"unknown aggregate: {self.function}")
        if self.input is None and self.function != "count":
            raise EngineError(f"{self.function} needs an input")

    def result_type(self, schema: T.StructType) -> str:
        if self.function == "count":
            return INT64
        kind = self.input.type(schema)
        if self.function == "avg":
            return DOUBLE
        return kind if kind in (DOUBLE, STRING) else INT64

    def column(self, schema: T.StructType, semantics: str = REFERENCE) -> Column:
        if self.input is None:
            return F.count(F.lit(1)).alias(self.name)
        value = self.input.value(schema, semantics)
        if self.function == "count":
            return F.count(value).alias(self.name)
        kind = self.input.type(schema)
        if kind == STRING and self.function in ("sum", "avg"):
            raise EngineError(f"{self.function} of a string: {self.input}")
        out = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[self.function](value)
        if self.function in ("min", "max") and self.result_type(schema) == INT64:
            out = out.cast("long")
        return out.alias(self.name)


def _of(function: str, what: str | Expr, name: str | None) -> Aggregate:
    expr = ColumnRef(what) if isinstance(what, str) else what
    return Aggregate(function, expr, name or f"{function}_{expr}")


def count_rows(name: str = "count") -> Aggregate:
    return Aggregate("count", None, name)


def count(what: str | Expr, name: str | None = None) -> Aggregate:
    return _of("count", what, name)


def sum_(what: str | Expr, name: str | None = None) -> Aggregate:
    return _of("sum", what, name)


def min_(what: str | Expr, name: str | None = None) -> Aggregate:
    return _of("min", what, name)


def max_(what: str | Expr, name: str | None = None) -> Aggregate:
    return _of("max", what, name)


def avg(what: str | Expr, name: str | None = None) -> Aggregate:
    return _of("avg", what, name)
