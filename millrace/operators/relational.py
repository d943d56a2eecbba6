"""Row operators over DataFrames.

Every operator only declares a plan. Aggregations combine on the map side, joins
leave the choice of sides to the optimizer unless asked, and no operator
collects rows.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from millrace.errors import EngineError
from millrace.functions.aggregates import Aggregate
from millrace.functions.expressions import REFERENCE, SQL, ColumnRef, Expr
from millrace.functions.types import STRING, type_of

#: Bytes up to which a build side may be broadcast on request.
BROADCAST_BYTES = 256 << 20


def filter_rows(df: DataFrame, predicate: Expr, semantics: str = REFERENCE) -> DataFrame:
    """Keeps rows for which the predicate is true."""
    return df.filter(predicate.predicate(df.schema, semantics))


def project(df: DataFrame, outputs: Sequence[str | tuple[str, Expr]], semantics: str = REFERENCE) -> DataFrame:
    """Columns by name, and named value expressions, in order."""
    columns = []
    for out in outputs:
        name, expr = (out, ColumnRef(out)) if isinstance(out, str) else out
        columns.append(expr.value(df.schema, semantics).alias(name))
    return df.select(*columns)


def aggregate(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Aggregate], semantics: str = REFERENCE) -> DataFrame:
    """Groups by ``keys`` (null is a key of its own); keys first, then aggregates.

    Without keys there is one total. Over no rows, that total is absent in
    ``reference`` semantics and one row in ``sql`` semantics. Without
    aggregates, the distinct keys come out.
    """
    for k in keys:
        ColumnRef(k).field(df.schema)
    columns = [a.column(df.schema, semantics) for a in aggregates]
    if not columns:
        return distinct_keys(df, keys)
    if keys:
        return df.groupBy(*[ColumnRef(k).value(df.schema) for k in keys]).agg(*columns)
    if semantics == SQL:
        return df.agg(*columns)
    # A constant group has no row where there is no input; it still combines on the map side.
    return df.groupBy(F.lit(1).alias("_all")).agg(*columns).drop("_all")


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not keys:
        raise EngineError("distinct keys need a key")
    return df.select(*[ColumnRef(k).value(df.schema) for k in keys]).distinct()


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hash_join(
    probe: DataFrame,
    build: DataFrame,
    probe_keys: Sequence[str],
    build_keys: Sequence[str],
    semantics: str = REFERENCE,
    strategy: str = "auto",
    suffix: str = "_build",
) -> DataFrame:
    """Inner equi-join on one or more columns: probe columns, then build columns.

    Null keys match null keys in ``reference`` semantics and nothing in ``sql``
    semantics. Build columns whose names the probe side has get ``suffix``.

    ``strategy``: ``auto`` leaves the sides to the optimizer and adaptive
    execution; ``broadcast`` sends the build side to all executors if its
    estimated size is at most :data:`BROADCAST_BYTES`, else it falls back to
    ``auto``; ``shuffle_hash`` and ``merge`` shuffle both sides by the keys.
    """
    if not probe_keys or len(probe_keys) != len(build_keys):
        raise EngineError("a join needs as many build keys as probe keys, at least one")
    pairs = list(zip(probe_keys, build_keys, strict=True))
    for p, b in pairs:
        x, y = (ColumnRef(k).field(df.schema).dataType for df, k in ((probe, p), (build, b)))
        if x != y and STRING in (type_of(x, p), type_of(y, b)):
            raise EngineError(f"join keys {p} and {b} have types {x.simpleString()} and {y.simpleString()}")
    taken, names = set(probe.columns), {}
    for c in build.columns:
        name = c
        while name in taken:
            name += suffix
        taken.add(name)
        names[c] = name
    renamed = build.select(*[F.col(f"`{c}`").alias(names[c]) for c in build.columns])
    if strategy == "broadcast" and plan_bytes(build) <= BROADCAST_BYTES:
        renamed = F.broadcast(renamed)
    elif strategy in ("shuffle_hash", "merge"):
        renamed = renamed.hint(strategy)
    elif strategy not in ("auto", "broadcast"):
        raise EngineError(f"unknown join strategy: {strategy}")
    terms = []
    for p, b in pairs:
        left, right = F.col(f"`{p}`"), F.col(f"`{names[b]}`")
        terms.append(left == right if semantics == SQL else left.eqNullSafe(right))
    return probe.join(renamed, functools.reduce(operator.and_, terms), "inner")


def limit(df: DataFrame, rows: int) -> DataFrame:
    """The first rows; which they are is only fixed after a total order."""
    if rows < 0:
        raise EngineError("a limit is not negative")
    return df.limit(rows)


def collect(df: DataFrame) -> list[Row]:
    """All rows on the driver: for results that are known to be small."""
    return df.collect()
