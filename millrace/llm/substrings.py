"""Removal of repeated passages, by super-k-mers of words.

A window is ``width`` consecutive words. Every word is removed that lies in a
window whose words also start earlier: in a smaller document id, or earlier in
the same document. Windows are judged on the input.

Consecutive windows that share a minimiser (the smallest hash among their runs
of ``run`` words) form a super-k-mer. It travels once, as one packed string of
words, to the bucket of its minimiser, where equal windows meet and are sorted;
all but the first occurrence of a window are repeats.

* A task settles repeats among its own documents first and sends only its
  earliest occurrence of a window. A passage that a third of all documents share
  reaches its bucket once per task, not once per document.
* A task's super-k-mers for one bucket are one compressed row.
* Bucket loads are counted before words travel. In a bucket with more than its
  share, windows are dealt by a hash of their words over as many further buckets
  as the load asks for, so no bucket grows with a common phrase.
* Equal windows are found by two 64-bit hashes of their words.

Documents are placed by (id, hash of text): rows that share an id but not a text
are ordered by that hash, and fully equal rows count as one document.

Defined results: null texts have no words; a null id comes first; ids may be of
any type that has an order; texts shorter than a window lose nothing; an empty
table gives no rows; texts of any length are whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._shared import free_prefix, settle, table
from millrace.llm._worker import begin
from millrace.llm.words import U, scramble, utf8, words_in

WIDTH, RUN = 20, 4
#: Windows that a bucket should hold, and words of a task that are settled together.
LOAD, TOGETHER = 250_000, 2_000_000
#: Words in a row that travels, but for a longer super-k-mer.
BODY = 400_000
_GAP = re.compile(r"[\x20\x09-\x0D]+")
#: White space to Python that doesn't end a word here.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    if any(x in text for x in "\x1c\x1d\x1e\x1f") or not text.isascii() and _ODD.search(text):
        return [w for w in _GAP.split(text) if w]
    return text.split()


def rolling(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash of every run of ``width`` consecutive words, in order."""
    n = len(hashes) - width + 1
    mixed = scramble(hashes ^ _MIX[seed])
    out = np.zeros(max(0, n), dtype=np.uint64)
    for k in range(width if n > 0 else 0):
        out *= _MIX[1 - seed]
        out += mixed[k : k + n]
    return scramble(out)


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """The smallest of every ``span`` consecutive values, by doubling."""
    out, have = values, 1
    while have < span:
        step = min(have, span - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _equals(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal (a, b) are neighbours, early ones first, and whether each equals the one before."""
    order = np.argsort(a, kind="stable")
    same = np.concatenate((np.zeros(min(1, len(a)), bool), a[order[1:]] == a[order[:-1]]))
    if (b[order[1:]] != b[order[:-1]])[same[1:]].any():
        order = np.lexsort((b, a))
        same[1:] = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
    return order, same


def _runs(flags: np.ndarray) -> np.ndarray:
    """Rows of (start, end) of runs of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edges.reshape(-1, 2)


class _Batch:
    """Documents of a task, and what is known of all their windows."""

    def __init__(self, width: int, run: int):
        self.width, self.run, self.size = width, run, 0
        self.held: list[tuple] = []

    def add(self, doc: int, mark: int, raw: bytes) -> None:
        starts, ends, hashes = words_in(raw)
        if len(hashes) >= self.width:
            self.held.append((doc, mark, raw, starts.astype(np.int32), ends.astype(np.int32), hashes))
            self.size += len(hashes)

    def settle(self) -> None:
        """Orders the documents, hashes their windows, and finds what is first here."""
        self.held.sort(key=lambda d: d[:2])
        held = [d for k, d in enumerate(self.held) if k == 0 or d[:2] != self.held[k - 1][:2]]
        self.doc = np.array([d[0] for d in held], dtype=np.int64)
        self.mark = np.array([d[1] for d in held], dtype=np.int64)
        self.raw, self.starts, self.ends = [d[2] for d in held], [d[3] for d in held], [d[4] for d in held]
        self.base = np.concatenate(([0], np.cumsum([len(d[5]) - self.width + 1 for d in held], dtype=np.int64)))
        join = lambda make: np.concatenate([make(d[5]) for d in held]) if held else np.zeros(0, np.uint64)
        self.one = join(lambda h: rolling(h, self.width, 0))
        self.two = join(lambda h: rolling(h, self.width, 1))
        self.low = join(lambda h: _least(rolling(h, self.run, 0), self.width - self.run + 1))
        self.held = []
        order, same = _equals(self.one, self.two)
        self.first = np.ones(len(order), dtype=bool)
        self.first[order] = ~same

    def slice(self, doc: int, start: int, windows: int) -> bytes:
        """The words of some consecutive windows."""
        return self.raw[doc][self.starts[doc][start] : self.ends[doc][start + windows + self.width - 2]]

    def repeats(self) -> Iterator[tuple[int, int, int, int]]:
        """(document, start, end) of runs of windows that come earlier in this batch."""
        again = ~self.first
        for k in range(len(self.doc)):
            for a, b in _runs(again[self.base[k] : self.base[k + 1]]):
                yield k, int(a), int(b)

    def pieces(self, bucket_of) -> tuple[np.ndarray, ...]:
        """Super-k-mers of first windows: bucket, document, first window, number of windows."""
        at = np.flatnonzero(self.first)
        bucket = bucket_of(self.low[at], self.one[at])
        doc = np.searchsorted(self.base, at, side="right") - 1
        new = np.ones(len(at), dtype=bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(doc) != 0) | (np.diff(bucket) != 0)
        head = np.flatnonzero(new)
        return bucket[head], doc[head], at[head] - self.base[doc[head]], np.diff(np.concatenate((head, [len(at)])))


class _Buckets:
    """From (minimiser, window hash) to bucket.

    ``hot`` lists the counted buckets that are over their load, with the first
    and the number of the further buckets that take their windows.
    """

    def __init__(self, counted: int, buckets: int, hot: list[tuple[int, int, int]]):
        self.counted, self.buckets = counted, buckets
        self.first, self.parts = np.zeros(counted, dtype=np.int64), np.zeros(counted, dtype=np.uint64)
        for b, first, parts in hot:
            self.first[b], self.parts[b] = first, parts

    def __call__(self, low: np.ndarray, one: np.ndarray) -> np.ndarray:
        b = (low % U(self.counted)).astype(np.int64)
        parts = self.parts[b]
        split = parts > 0
        further = self.first[b[split]] + (scramble(one[split]) % parts[split]).astype(np.int64)
        b %= self.buckets
        b[split] = further
        return b


def _documents(batches: Iterator[pa.RecordBatch], width: int, run: int) -> Iterator[_Batch]:
    """A task's documents (id, mark, text), in batches of bounded size."""
    now = _Batch(width, run)
    for batch in batches:
        for doc, mark, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            now.add(doc.as_py(), mark.as_py(), utf8(text.as_py()))
            if now.size >= TOGETHER:
                now.settle()
                yield now
                now = _Batch(width, run)
    if now.size:
        now.settle()
        yield now


def _head(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, length: np.ndarray) -> bytes:
    """Places as bytes. Documents ascend, so they are kept as steps; what repeats compresses away."""
    with np.errstate(over="ignore"):
        steps = np.diff(doc, prepend=np.int64(0))
    return b"".join((len(doc).to_bytes(4, "little"), steps.astype("<i8").tobytes(), mark.astype("<i8").tobytes(), start.astype("<i4").tobytes(), length.astype("<i4").tobytes()))


_PACKED = "bucket long, windows long, body binary"


def _pack(batch: _Batch, bucket_of) -> Iterator[tuple[int, int, bytes]]:
    """One compressed row per bucket: places of super-k-mers, and their words."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    bucket, doc, start, length = batch.pieces(bucket_of)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    for rows in _bounded(np.split(order, edges) if len(order) else (), length, batch.width):
        texts = [batch.slice(d, s, n) for d, s, n in zip(doc[rows].tolist(), start[rows].tolist(), length[rows].tolist(), strict=True)]
        body = _head(batch.doc[doc[rows]], batch.mark[doc[rows]], start[rows], length[rows]) + b"\n".join(texts)
        yield int(bucket[rows[0]]), int(length[rows].sum()), press.compress(body)


def _bounded(groups, length: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The groups of super-k-mers, those of more than ``BODY`` words in parts."""
    for rows in groups:
        words = np.cumsum(length[rows] + width - 1)
        if words[-1] <= BODY:
            yield rows
        else:
            yield from np.split(rows, np.flatnonzero(np.diff(words // BODY)) + 1)


def _pack_repeats(batch: _Batch, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Repeats settled here, as rows that pass through buckets unchanged (no words, 0 windows)."""
    import zstandard

    found = list(batch.repeats())
    if found:
        k, a, b = np.array(found, dtype=np.int64).T
        yield int(batch.one[0] % U(buckets)), 0, zstandard.ZstdCompressor(level=3).compress(_head(batch.doc[k], batch.mark[k], a, b - a))


def _unpack(body: bytes) -> tuple[np.ndarray, bytes]:
    """The places of a row's super-k-mers, and all their words."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(body)
    n = int.from_bytes(raw[:4], "little")
    steps, mark = np.frombuffer(raw, dtype="<i8", count=2 * n, offset=4).reshape(2, n)
    start, length = np.frombuffer(raw, dtype="<i4", count=2 * n, offset=4 + 16 * n).reshape(2, n).astype(np.int64)
    return np.stack((np.cumsum(steps), mark, start, length)), raw[4 + 24 * n :]


def _judge(bodies: list[bytes], width: int) -> np.ndarray:
    """Repeats (document, mark, start, windows) among the super-k-mers of one bucket."""
    heads, one, two = [], [], []
    for body in bodies:
        head, raw = _unpack(body)
        heads.append(head)
        h = words_in(raw)[2]
        inside = np.ones(len(h) - width + 1, dtype=bool)
        for k in range(1, width):
            inside[np.cumsum(head[3] + width - 1)[:-1] - k] = False
        one.append(rolling(h, width, 0)[inside])
        two.append(rolling(h, width, 1)[inside])
    head = np.concatenate(heads, axis=1)
    a, b = np.concatenate(one), np.concatenate(two)
    order, same = _equals(a, b)
    several = order[same | np.concatenate((same[1:], [False]))]
    if not len(several):
        return np.zeros((4, 0), dtype=np.int64)
    # Only windows that have equals are put in the order of their places.
    ends = np.cumsum(head[3])
    piece = np.searchsorted(ends, several, side="right")
    doc, mark, start = head[0][piece], head[1][piece], head[2][piece] + several - (ends - head[3])[piece]
    order = np.lexsort((start, mark, doc, b[several], a[several]))
    x, y = a[several][order], b[several][order]
    same = np.concatenate(([False], (x[1:] == x[:-1]) & (y[1:] == y[:-1])))
    # A window is a repeat if it isn't in the first place of its equals; fully equal rows share their places.
    first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    other = (start[order] != start[first]) | (doc[order] != doc[first]) | (mark[order] != mark[first])
    again = np.zeros(len(a), dtype=bool)
    again[several[order[same & other]]] = True
    edge = np.zeros(len(a), dtype=bool)
    edge[ends[:-1]] = True
    begin = again & (edge | ~np.concatenate(([False], again[:-1])))
    stop = again & np.concatenate((edge[1:] | ~again[1:], [True]))
    at, to = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    piece = np.searchsorted(ends, at, side="right")
    return np.stack((head[0][piece], head[1][piece], head[2][piece] + at - (ends - head[3])[piece], to - at))


def find_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, run: int = RUN, load: int = LOAD) -> DataFrame:
    """``doc, mark, runs`` (start and number of repeated windows), one row per document that has any.

    ``doc`` is the id's place (see :func:`with_place`), ``mark`` tells rows of
    one id apart (see :func:`mark_of`).
    """
    docs, place = with_place(docs, doc_id)
    return _find(docs.select(place.alias("doc"), mark_of(docs, place, text).alias("mark"), F.col(text).alias("_text")), width, run, load)


def _find(rows: DataFrame, width: int, run: int, load: int) -> DataFrame:
    """The repeats of :func:`find_repeats` among rows (doc, mark, text)."""
    spark = rows.sparkSession

    counted = 1 << max(14, (8 * rows.rdd.getNumPartitions() - 1).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("repeats")
        total = np.zeros(counted, dtype=np.int64)
        for batch in _documents(batches, width, run):
            total += np.bincount((batch.low[batch.first] % U(counted)).astype(np.int64), minlength=counted)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    loads = settle(rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")))
    total = loads.agg(F.sum("n")).head()[0] or 0
    load = max(load, total // counted)
    buckets = min(counted, 1 << max(0, (total // load).bit_length()))
    hot, following = [], buckets
    for r in loads.filter(F.col("n") > 2 * load).orderBy("bucket").collect():
        parts = -(-r["n"] // load)
        hot.append((r["bucket"], following, parts))
        following += parts
    bucket_of = spark.sparkContext.broadcast(_Buckets(counted, buckets, hot))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("repeats")
        for batch in _documents(batches, width, run):
            for found in (_pack(batch, bucket_of.value), _pack_repeats(batch, buckets)):
                made: list[tuple] = []
                for row in found:
                    made.append(row)
                    if len(made) >= 256:
                        yield _rows(made)
                        made = []
                yield _rows(made)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("repeats")
        now, bodies = None, []
        for batch in batches:
            for bucket, windows, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if windows == 0:
                    yield _found(_unpack(body.as_py())[0])
                    continue
                if bucket != now and bodies:
                    yield _found(_judge(bodies, width))
                    bodies = []
                now = bucket
                bodies.append(body.as_py())
        if bodies:
            yield _found(_judge(bodies, width))

    packed = rows.mapInArrow(spread, _PACKED)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-following // 4))
    dealt = packed.repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(judge, "doc long, mark long, start long, size long")
    return found.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "size")).alias("runs"))


def _rows(made: list[tuple]) -> pa.RecordBatch:
    columns = zip(*made, strict=True) if made else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "windows", "body"])


def _found(head: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in head], names=["doc", "mark", "start", "size"])


def _cut(text: str | None, spans: list[list[int]]) -> str | None:
    """A text without the words in ``spans``, each cut up to the next word."""
    if not spans:
        return text
    at = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)] + [len(text)]
    kept, last = [], 0
    for a, b in spans:
        kept.append(text[last : at[a]])
        last = at[b]
    return "".join([*kept, text[last:]])


def with_place(docs: DataFrame, doc_id: str) -> tuple[DataFrame, Column]:
    """The documents, and a long column that orders them by id; a null id comes first.

    Whole numbers are their own places. Other ids are numbered in their order:
    sorted in ranges, of which each starts above all numbers of those before.
    """
    first = F.lit(-(2**63))
    if isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        return docs, F.coalesce(F.col(doc_id).cast("long"), first)
    p = free_prefix(docs.columns)
    ids = docs.select(F.col(doc_id).alias(f"{p}id")).filter(F.col(f"{p}id").isNotNull()).distinct()
    ids = settle(ids.repartitionByRange(f"{p}id").sortWithinPartitions(f"{p}id").withColumn(f"{p}place", F.monotonically_increasing_id()))
    return docs.join(ids, F.col(doc_id) == F.col(f"{p}id"), "left").drop(f"{p}id"), F.coalesce(F.col(f"{p}place"), first)


def mark_of(docs: DataFrame, place: Column, text: str) -> Column:
    """What tells rows of one id apart: their text's hash, or nothing where no id comes twice."""
    ids = docs.groupBy(place.alias("doc")).agg(F.count(F.lit(1)).alias("n"))
    unique = ids.filter("n > 1").limit(1).count() == 0
    return F.lit(0).cast("long") if unique else F.xxhash64(F.coalesce(F.col(text), F.lit("")))


RESULTS = ("n_words", "n_removed", "removed", "kept_text")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, run: int = RUN, load: int = LOAD, keep: list[str] | None = None, layout: bool = False) -> DataFrame:
    """The columns in ``keep``, and ``n_words, n_removed, removed, kept_text`` of every document.

    ``removed`` are (start, end) in words; ``kept_text`` has the other words,
    joined by one space or, with ``layout``, with the white space around them.
    Kept columns that bear the name of a result are left out.
    """
    keep = [c for c in keep or [doc_id] if c not in RESULTS]
    return _without_repeats(docs, doc_id, text, width, run, load, keep, layout).toDF(*keep, *RESULTS)


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """The documents with repeated words cut out of their texts, and ``length`` (if there) following.

    A null text stays null, with length 0. Other columns stay, whatever their names.
    """
    others = [c for c in docs.columns if c not in (text, length)]
    cut = _without_repeats(docs, doc_id, text, WIDTH, RUN, LOAD, others, layout=True)
    made = {c: F.col(f"_k{i}") for i, c in enumerate(others)} | {text: F.col("kept_text")}
    if length in docs.columns:
        made[length] = F.coalesce(F.length("kept_text"), F.lit(0)).cast(docs.schema[length].dataType)
    return cut.select(*[made[c].alias(c) for c in docs.columns])


def _without_repeats(docs: DataFrame, doc_id: str, text: str, width: int, run: int, load: int, keep: list[str], layout: bool) -> DataFrame:
    """The columns ``keep`` as ``_k0``, ``_k1`` and so on, and the results."""
    docs, place = with_place(docs, doc_id)
    mark = mark_of(docs, place, text)
    found = _find(docs.select(place.alias("doc"), mark.alias("mark"), F.col(text).alias("_text")), width, run, load)
    named = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], place.alias("_doc"), mark.alias("_mark"), F.col(text).alias("_text"))
    joined = named.join(found, (F.col("_doc") == F.col("doc")) & (F.col("_mark") == F.col("mark")), "left")
    rows = joined.select(*[f"_k{i}" for i in range(len(keep))], "_text", "runs")
    kinds = (T.LongType(), T.LongType(), T.ArrayType(T.ArrayType(T.IntegerType())), T.StringType())
    schema = T.StructType([*rows.schema.fields[: len(keep)], *[T.StructField(n, k) for n, k in zip(RESULTS, kinds, strict=True)]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[], [], [], []]
            for body, runs in zip(batch.column(len(keep)), batch.column(len(keep) + 1), strict=True):
                words = words_of(body.as_py())
                spans: list[list[int]] = []
                kept = words
                if runs.is_valid:
                    gone = np.zeros(len(words) + 1, dtype=np.int64)
                    start = runs.values.field("start").to_numpy()
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + runs.values.field("size").to_numpy() + width - 1, -1)
                    gone = np.cumsum(gone)[:-1] > 0
                    spans = _runs(gone).tolist()
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                for column, value in zip(made, (len(words), len(words) - len(kept), spans, _cut(body.as_py(), spans) if layout else " ".join(kept)), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32())), pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *[pa.array(v, k) for v, k in zip(made, kinds, strict=True)]], names=[f.name for f in schema.fields])

    return rows.mapInArrow(cut, schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))

