"""A plan as a chain of operators, by name instead of by position."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row, SparkSession

from millrace.functions.aggregates import Aggregate
from millrace.functions.expressions import REFERENCE, Expr
from millrace.operators import relational
from millrace.operators.scan import Pushdown, scan


@dataclass(frozen=True)
class Query:
    """A DataFrame with the steps that made it and the semantics they follow."""

    df: DataFrame
    steps: tuple[str, ...]
    semantics: str = REFERENCE

    def _then(self, step: str, df: DataFrame) -> Query:
        return replace(self, df=df, steps=(*self.steps, step))

    def filter(self, predicate: Expr) -> Query:
        return self._then(f"filter {predicate}", relational.filter_rows(self.df, predicate, self.semantics))

    def project(self, *outputs: str | tuple[str, Expr]) -> Query:
        shown = ", ".join(o if isinstance(o, str) else f"{o[1]} as {o[0]}" for o in outputs)
        return self._then(f"project {shown}", relational.project(self.df, outputs, self.semantics))

    def aggregate(self, keys: Sequence[str], aggregates: Sequence[Aggregate] = ()) -> Query:
        shown = ", ".join([*keys, *(a.name for a in aggregates)])
        return self._then(f"aggregate {shown}", relational.aggregate(self.df, keys, aggregates, self.semantics))

    def join(self, build: Query | DataFrame, probe_keys: Sequence[str], build_keys: Sequence[str] | None = None, strategy: str = "auto") -> Query:
        other = build.df if isinstance(build, Query) else build
        keys = build_keys or probe_keys
        return self._then(f"join {', '.join(probe_keys)} = {', '.join(keys)}", relational.hash_join(self.df, other, probe_keys, keys, self.semantics, strategy))

    def limit(self, rows: int) -> Query:
        return self._then(f"limit {rows}", relational.limit(self.df, rows))

    def transform(self, step: Callable[[DataFrame], DataFrame], name: str = "transform") -> Query:
        """A step of the caller's own."""
        return self._then(name, step(self.df))

    def collect(self) -> list[Row]:
        return relational.collect(self.df)

    def count(self) -> int:
        return self.df.count()

    def __str__(self) -> str:
        return "\n".join(f"{'  ' * i}{s}" for i, s in enumerate(reversed(self.steps)))

    def explain(self) -> str:
        """Spark's physical plan."""
        return self.df._jdf.queryExecution().explainString(self.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def table(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    where: Sequence[Pushdown | tuple] = (),
    pushdown: bool = True,
    semantics: str = REFERENCE,
) -> Query:
    """A query that starts with the scan of a table."""
    terms = " AND ".join(str((t if isinstance(t, Pushdown) else Pushdown(*t)).expr()) for t in where)
    return Query(scan(spark, path, columns, where, pushdown), (f"scan {path}{' where ' + terms if terms else ''}",), semantics)
