"""Segment tables: row groups of encoded column chunks with their value ranges.

A row of the table is a row group; a column of it is a chunk: encoding, encoded
values, validity bits, least and greatest value, number of nulls. Ranges are
ordinary columns, so that a scan skips row groups by a filter on them and reads
only the chunks it needs, and the table lies wherever Spark writes.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import EngineError
from millrace.functions.expressions import Compare, ColumnRef, Literal, parse_comparison
from millrace.functions.types import DOUBLE, INT32, INT64, SPARK_TYPES, STRING, coerce, type_of
from millrace.operators.scan import Pushdown
from millrace.sources.encodings import decode, encode, encode_best, fits
from millrace.sources.tables import ROWS_PER_GROUP, read_table

_NUMPY = {INT32: np.dtype("int32"), INT64: np.dtype("int64"), DOUBLE: np.dtype("float64"), STRING: np.dtype(object)}
_ARROW = {INT32: pa.int32(), INT64: pa.int64(), DOUBLE: pa.float64(), STRING: pa.string()}


def _chunk_type(kind: str) -> T.StructType:
    value = SPARK_TYPES[kind]
    return T.StructType(
        [
            T.StructField("encoding", T.StringType()),
            T.StructField("body", T.BinaryType()),
            T.StructField("validity", T.BinaryType()),
            T.StructField("low", value),
            T.StructField("high", value),
            T.StructField("nulls", T.LongType()),
        ]
    )


def _encode_chunk(column: pa.Array, kind: str, wanted: str | None = None) -> dict:
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    if kind == STRING:
        values = np.empty(len(column), dtype=object)
        values[:] = [v or b"" for v in column.cast(pa.binary()).to_pylist()]
    else:
        values = column.fill_null(0).to_numpy(zero_copy_only=False).astype(_NUMPY[kind])
    encoding, body = (wanted, encode(wanted, values)) if wanted and fits(wanted, values) else encode_best(values)
    there = values[valid]
    low = high = None
    if kind == DOUBLE and np.isnan(there).any():
        there = there[:0]  # a range says nothing about NaN
    if len(there):
        low, high = (f(there.tolist()) for f in (min, max))
        if kind == STRING:
            low, high = low.decode("utf-8"), high.decode("utf-8")
    return {"encoding": encoding, "body": body, "validity": b"" if valid.all() else np.packbits(valid, bitorder="little").tobytes(), "low": low, "high": high, "nulls": int((~valid).sum())}


def write_segments(df: DataFrame, path: str, rows_per_group: int = ROWS_PER_GROUP, cluster_by: Sequence[str] = (), encodings: Mapping[str, str] | None = None) -> None:
    """Writes a segment table; every task makes row groups of ``rows_per_group`` rows and one shorter one.

    Each chunk has the smallest encoding, or that which ``encodings`` names for
    its column where that one takes the column's type.
    """
    if rows_per_group < 1:
        raise EngineError("a row group has a row at least")
    kinds = [type_of(f.dataType, f.name) for f in df.schema.fields]
    names, wanted = df.columns, dict(encodings or {})
    schema = T.StructType([T.StructField("rows", T.LongType()), *[T.StructField(n, _chunk_type(k)) for n, k in zip(names, kinds, strict=True)]])
    arrow = pa.schema([("rows", pa.int64()), *[(n, pa.struct([("encoding", pa.string()), ("body", pa.binary()), ("validity", pa.binary()), ("low", _ARROW[k]), ("high", _ARROW[k]), ("nulls", pa.int64())])) for n, k in zip(names, kinds, strict=True)]])
    if "rows" in names:
        raise EngineError("a segment table has no column called rows")
    if cluster_by:
        df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)

    def group(table: pa.Table) -> pa.RecordBatch:
        row = {"rows": table.num_rows} | {n: _encode_chunk(table.column(n).combine_chunks(), k, wanted.get(n)) for n, k in zip(names, kinds, strict=True)}
        return pa.RecordBatch.from_pylist([row], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= rows_per_group:
                table = pa.Table.from_batches(held)
                yield group(table.slice(0, rows_per_group))
                rest = table.slice(rows_per_group)
                held, n = rest.to_batches(), rest.num_rows
        if n:
            yield group(pa.Table.from_batches(held))

    df.mapInArrow(run, schema).write.mode("overwrite").option("compression", "none").parquet(path)


def _can_contain(chunk: Column, rows: Column, op: str, literal: Column) -> Column:
    """The range test of a row group as a filter on its chunk."""
    low, high = chunk["low"], chunk["high"]
    test = {"=": (low <= literal) & (high >= literal), "<>": ~((low == literal) & (high == literal)), "<": low < literal, "<=": low <= literal, ">": high > literal, ">=": high >= literal}[op]
    return (chunk["nulls"] < rows) & F.coalesce(test, F.lit(True))


def read_segments(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Sequence[Pushdown | tuple] = (), pushdown: bool = True) -> DataFrame:
    """Rows of a segment table for which all of ``where`` hold; without ``pushdown`` no row group is skipped."""
    groups = read_table(spark, path)
    kinds = {f.name: type_of(f.dataType["low"].dataType, f.name) for f in groups.schema.fields if f.name != "rows"}
    terms = [t if isinstance(t, Pushdown) else Pushdown(*t) for t in where]
    wanted = list(columns or kinds)
    for c in [*wanted, *(t.column for t in terms)]:
        if c not in kinds:
            raise EngineError(f"there is no column {c}")
    if pushdown:
        for t in terms:
            kind = kinds[t.column]
            literal = F.lit(coerce(t.literal, kind)).cast(SPARK_TYPES[kind])
            groups = groups.filter(_can_contain(F.col(f"`{t.column}`"), F.col("rows"), parse_comparison(t.op), literal))
    needed = list(dict.fromkeys([*wanted, *(t.column for t in terms)]))
    chunks = groups.select("rows", *[F.struct(*[F.col(f"`{c}`.{f}").alias(f) for f in ("encoding", "body", "validity")]).alias(c) for c in needed])
    schema = T.StructType([T.StructField(c, SPARK_TYPES[kinds[c]]) for c in needed])

    def column(chunk: dict, n: int, kind: str) -> pa.Array:
        values = decode(chunk["encoding"], chunk["body"], n, _NUMPY[kind])
        nulls = None
        if chunk["validity"]:
            nulls = ~np.unpackbits(np.frombuffer(chunk["validity"], np.uint8), bitorder="little", count=n).astype(bool)
        if kind == STRING:
            return pa.array(values, pa.binary(), mask=nulls).cast(pa.string())
        return pa.array(values, _ARROW[kind], mask=nulls, from_pandas=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([column(row[c], row["rows"], kinds[c]) for c in needed], names=needed)

    rows = chunks.mapInArrow(run, schema)
    for t in terms:
        rows = rows.filter(Compare(parse_comparison(t.op), ColumnRef(t.column), Literal(t.literal)).predicate(rows.schema))
    return rows.select(*[F.col(f"`{c}`") for c in wanted])


def segment_report(spark: SparkSession, path: str) -> DataFrame:
    """One row per column: encoding (``*`` if row groups differ), bytes, bits a row, nulls, row groups.

    Only lengths and ranges are aggregated; chunks stay where they are.
    """
    groups = read_table(spark, path)
    names = [n for n in groups.columns if n != "rows"]

    def measures(name: str) -> list[Column]:
        c = F.col(f"`{name}`")
        size = F.octet_length(c["body"]) + F.octet_length(c["validity"])
        return [F.min(c["encoding"]).alias("first"), F.count_distinct(c["encoding"]).alias("kinds"), F.sum(size).alias("bytes"), F.sum("rows").alias("n"), F.sum(c["nulls"]).alias("nulls"), F.min(c["low"]).cast("string").alias("low"), F.max(c["high"]).cast("string").alias("high"), F.count(F.lit(1)).alias("row_groups")]

    # One pass over the table for all columns.
    flat = groups.agg(*[m.alias(f"m{k}_{i}") for k, n in enumerate(names) for i, m in enumerate(measures(n))])
    fields = ("first", "kinds", "bytes", "n", "nulls", "low", "high", "row_groups")
    each = F.array(*[F.struct(F.lit(n).alias("column"), *[F.col(f"m{k}_{i}").alias(f) for i, f in enumerate(fields)]) for k, n in enumerate(names)])
    return flat.select(F.explode(each).alias("r")).select("r.*").select(
        "column",
        F.concat("first", F.when(F.col("kinds") > 1, "*").otherwise("")).alias("encoding"),
        "bytes",
        (F.col("bytes") * 8 / F.col("n")).alias("bits_per_row"),
        "nulls",
        F.coalesce(F.concat("low", F.lit(" .. "), "high"), F.lit("(all null)")).alias("range"),
        "row_groups",
    )
