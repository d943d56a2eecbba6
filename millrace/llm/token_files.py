"""Token ids in binary files.

Ids are renumbered by how often they occur in the corpus (0 is the commonest),
so that most take one byte. A document is coded as two strings: ``data`` holds
each number in 1 to 4 bytes, little-endian and without leading zeros; a
``control`` byte holds the lengths, less one, of four numbers in two bits each,
the first lowest. A reader looks a control byte up in a table of 256 rows.

A token store is a folder::

    ranks/   rank, id, n     the renumbering and the counts behind it
    tokens/  part, start_in_part, doc_id, n_tokens, control, data

Documents lie in ascending order of id, inside a part by ``start_in_part`` and
from part to part by number. Both tables are written by Spark's own writer, so
the store can lie wherever Spark reaches and lost executors' parts are written
again.

Defined results: a null text is its end id alone; rows that share an id lie side
by side in the order of their checksums; an empty table makes an empty store;
texts of any length are coded whole.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._shared import scratch, staged, table
from millrace.llm._worker import begin
from millrace.llm.encoding import encoder

#: Control byte -> lengths of its four numbers.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
#: Length -> which of four bytes belong to a number.
_USED = np.arange(4) < np.arange(5)[:, None]
_SHIFT = np.array([1, 4, 16, 64], dtype=np.uint8)


#: Numbers that are coded at once.
TOGETHER = 1 << 18


def _padded(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where control bytes of documents end, and the places of numbers once documents are padded to fours."""
    ends = np.cumsum(-(-sizes // 4))
    shift = np.concatenate(([0], ends[:-1])) * 4 - (np.cumsum(sizes) - sizes)
    return ends, np.arange(int(sizes.sum())) + np.repeat(shift, sizes)


def encode_numbers(numbers: np.ndarray, sizes: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """``control`` and ``data`` of documents of unsigned 32-bit numbers that lie one after another."""
    numbers = np.ascontiguousarray(numbers, dtype="<u4")
    code = (numbers >= 1 << 8).astype(np.uint8) + (numbers >= 1 << 16) + (numbers >= 1 << 24)
    ends, place = _padded(sizes)
    full = np.zeros(int(ends[-1]) * 4 if len(ends) else 0, dtype=np.uint8)
    full[place] = code
    control = (full.reshape(-1, 4) * _SHIFT).sum(axis=1, dtype=np.uint8)
    data = numbers.view(np.uint8).reshape(-1, 4)[_USED[code + 1]]
    stops = np.concatenate(([0], np.cumsum(code.astype(np.int64) + 1)))[np.cumsum(sizes)]
    return _binary(control, ends), _binary(data, stops)


def _binary(whole: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings of bytes that lie one after another and end at ``ends``."""
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(whole))]).cast(pa.binary())


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings of a column, and where each begins."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def decode_numbers(control: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of coded documents that lie one after another, by table lookup."""
    _, place = _padded(sizes)
    lengths = LENGTHS[control].ravel()[place]
    out = np.zeros((len(lengths), 4), dtype=np.uint8)
    out[_USED[lengths]] = data
    return out.view("<u4").ravel()


def _together(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents to be coded at once."""
    held = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(held, (held[first - 1] if first else 0) + TOGETHER, side="right")))
        yield first, last
        first = last


def tokenize(docs: DataFrame, vocabulary: str, drops_space: bool, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, crc, ids`` of whole texts; ``ids`` are little-endian unsigned numbers.

    They have 16 bits where the vocabulary has no more than that, else 32; ``n``
    tells which.
    """
    from pyspark.sql import types as T

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    schema = T.StructType([rows.schema.fields[0], T.StructField("crc", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("token files")
        coder = encoder(vocabulary, drops_space)
        kind = "<u2" if max(end_id, coder.tokenizer.get_vocab_size() - 1) < 1 << 16 else "<u4"
        for batch in batches:
            for first, last, whole, bounds in coder.encode_batch(batch.column(1), end_id):
                places = bounds.tolist()
                crc = [zlib.crc32(whole[a:b]) for a, b in zip(places[:-1], places[1:], strict=True)]
                ids = whole.astype(kind)
                made = [pa.array(crc, pa.int64()), pa.array(np.diff(bounds)), _binary(ids.view(np.uint8), bounds[1:] * ids.itemsize)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *made], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def _numbers(ids: pa.Array, n: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all documents of a column, and how many each has."""
    sizes = n.to_numpy(zero_copy_only=False)
    data, bounds = _bytes(ids)
    return data.view("<u4" if bounds[-1] == 4 * sizes.sum() else "<u2"), sizes


def count_ids(tokens: DataFrame) -> DataFrame:
    """``id, n``: how often each id occurs; tasks send one row per id they have seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                n = np.bincount(_numbers(batch.column(0), batch.column(1))[0])
                if len(n) > len(total):
                    total, n = n.astype(np.int64), total
                total[: len(n)] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    return tokens.select("ids", "n").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(tokens: DataFrame, path: str) -> None:
    """Writes tokenized documents (settled: they are read twice) as a token store.

    The renumbering has a row per id of the vocabulary, whatever the corpus.
    """
    spark = tokens.sparkSession
    ranked = count_ids(tokens).orderBy(F.desc("n"), "id").collect()
    spark.createDataFrame([(k, r["id"], r["n"]) for k, r in enumerate(ranked)], "rank long, id long, n long").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(max((r["id"] for r in ranked), default=0) + 1, dtype=np.uint32)
    for k, r in enumerate(ranked):
        rank[r["id"]] = k
    shared = spark.sparkContext.broadcast(rank)
    from pyspark.sql import types as T

    key = next(f for f in tokens.schema.fields if f.name == "doc_id")
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("start_in_part", T.LongType()), key, T.StructField("n_tokens", T.LongType()), T.StructField("control", T.BinaryType()), T.StructField("data", T.BinaryType())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rank, part, at = shared.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers, sizes = _numbers(batch.column(1), batch.column(2))
            ends = np.cumsum(sizes)
            for a, b in _together(sizes):
                control, data = encode_numbers(rank[numbers[ends[a] - sizes[a] : ends[b - 1]]], sizes[a:b])
                made = [pa.array(np.full(b - a, part, np.int32)), pa.array(at + ends[a:b] - sizes[a:b], pa.int64()), batch.column(0).slice(a, b - a), pa.array(sizes[a:b]), control, data]
                yield pa.RecordBatch.from_arrays(made, names=[f.name for f in schema.fields])
            at += int(ends[-1])

    # Rows are put in order before they are coded: the range is then found without running Python twice.
    ordered = tokens.repartitionByRange("doc_id", "crc").sortWithinPartitions("doc_id", "crc").select("doc_id", "ids", "n")
    ordered.mapInArrow(code, schema).write.option("compression", "zstd").parquet(f"{path}/tokens")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of a token store and, if asked for, ``ids`` (unsigned 32 bits).

    A part's first place is the sum of the parts before it; there are as many
    parts as files.
    """
    from pyspark.sql import types as T

    ids = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], dtype="<u4")
    shared = spark.sparkContext.broadcast(ids)
    rows = spark.read.parquet(f"{path}/tokens")
    totals = sorted(rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    firsts, at = [], 0
    for part, n in totals:
        firsts.append((part, at))
        at += n
    first = spark.createDataFrame(firsts, "_part int, _first long")
    key = next(f for f in rows.schema.fields if f.name == "doc_id")
    schema = T.StructType([key, *[T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32")], *([T.StructField("ids", T.BinaryType())] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(2).to_numpy(zero_copy_only=False)
            (control, controls), (data, datas) = _bytes(batch.column(3)), _bytes(batch.column(4))
            for a, b in _together(sizes):
                whole = ids[decode_numbers(control[controls[a] : controls[b]], data[datas[a] : datas[b]], sizes[a:b])]
                ends = np.cumsum(sizes[a:b])
                places = [0, *ends.tolist()]
                made = [*[batch.column(i).slice(a, b - a) for i in range(3)], pa.array([zlib.crc32(whole[x:y]) for x, y in zip(places[:-1], places[1:], strict=True)], pa.int64()), *([_binary(whole.view(np.uint8), ends * 4)] if with_ids else [])]
                yield pa.RecordBatch.from_arrays(made, names=[f.name for f in schema.fields])

    placed = rows.join(F.broadcast(first), F.col("part") == F.col("_part"))
    return placed.select("doc_id", (F.col("_first") + F.col("start_in_part")).alias("start"), "n_tokens", "control", "data").mapInArrow(run, schema)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokens = staged(tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), drops_space=False, end_id=0))
    path = f"{scratch(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(tokens, path)
    return read_tokens(spark, path)
