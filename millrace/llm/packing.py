"""Best-fit packing by bin completion.

Packing depends on lengths only, and there are at most ``capacity`` of those, so
the problem is solved on the histogram of lengths, of the same size for any
corpus. A solution is a list of fillings (lengths that share a sequence) with
how often each is used. Pieces are then numbered within their length, and a
piece's number tells its sequence and offset.

Search: best-fit decreasing gives the first incumbent and the total length a
bound. While they differ, bin completion looks for fewer sequences: around the
largest remaining document it enumerates fillings that no other dominates, least
waste first, and abandons a branch once its waste exceeds what one sequence
fewer would allow. Completed branches become incumbents, as do partial ones
closed by best fit. Where fillings were left out and the search ends without
proof, it starts again with more of them. The search stops at a documented
number of nodes (every ``STEPS`` steps of enumeration count as one) and is never
worse than best fit. :func:`report` tells how a solution stands to the bound;
:func:`pack` warns where it needs more sequences than that.

Defined results: a null text is empty and packs as its end id alone; repeated
rows are packed each; an empty table gives no rows; texts of any length are cut
into pieces of ``capacity``.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._shared import dense_rank_ids, settle, table
from millrace.llm._worker import begin
from millrace.llm.encoding import encoder

CAPACITY = 4096
#: Branches that the search may open (each applies a filling as often as it fits, or once).
NODES = 2000
#: Fillings that are weighed at a branch, and steps spent on finding them, at first. A
#: search that ends without proof starts again with twice as many and four times the steps.
WIDTH, STEPS = 6, 600

Filling = tuple[int, ...]
_log = logging.getLogger(__name__)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing over a histogram: fillings and how often each is used."""
    open_bins: dict[int, list[list]] = {}
    room = np.zeros(capacity + 1, dtype=bool)

    def put(left: int, filling: Filling, n: int) -> None:
        open_bins.setdefault(left, []).append([filling, n])
        room[left] = True

    for length in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[length])
        while n:
            fits = np.flatnonzero(room[length:])
            if len(fits):
                left = length + int(fits[0])
                filling, have = open_bins[left].pop()
                used = min(n, have)
                if have > used:
                    open_bins[left].append([filling, have - used])
                if not open_bins[left]:
                    room[left] = False
                put(left - length, (*filling, length), used)
                n -= used
            else:
                each = min(capacity // length, n)
                put(capacity - each * length, (length,) * each, n // each)
                n %= each
    return [(f, n) for groups in open_bins.values() for f, n in groups]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: by total length, and by documents that can't share."""
    lengths = np.arange(len(counts))
    most = -(-int((counts * lengths).sum()) // capacity)
    for small in np.unique(np.minimum(lengths[counts > 0], capacity - lengths[counts > 0])).tolist():
        if 0 < small <= capacity // 2:
            alone = int(counts[capacity - small + 1 :].sum())
            big = counts.copy()
            big[: capacity // 2 + 1] = 0
            big[capacity - small + 1 :] = 0
            half = counts.copy()
            half[:small] = 0
            half[capacity // 2 + 1 :] = 0
            over = int((half * lengths).sum()) - (int(big.sum()) * capacity - int((big * lengths).sum()))
            most = max(most, alone + int(big.sum()) + max(0, -(-over // capacity)))
    return most


def _dominated(a: Filling, b: Filling) -> bool:
    """Whether the documents of ``a`` fit into places the size of ``b``'s documents."""

    def fit(k: int, left: tuple[int, ...]) -> bool:
        if k == len(a):
            return True
        return any(a[k] <= x and (i == 0 or x not in left[:i]) and fit(k + 1, (*left[:i], x - a[k], *left[i + 1 :])) for i, x in enumerate(left))

    return len(a) <= 8 and fit(0, b)


class Effort:
    """How widely fillings are enumerated, the steps spent on it, and whether any were left out."""

    def __init__(self, width: int = WIDTH, steps: int = STEPS):
        self.width, self.steps, self.spent, self.cut = width, steps, 0, False

    def widen(self) -> None:
        self.width, self.steps, self.cut = 2 * self.width, 4 * self.steps, False


def fillings(counts: np.ndarray, room: int, effort: Effort | None = None) -> list[Filling]:
    """Undominated fillings of ``room`` from the documents left, least waste first."""
    effort = effort or Effort()
    have = np.flatnonzero(counts[: room + 1])[::-1].tolist()
    left = {x: int(counts[x]) for x in have}
    found: dict[Filling, int] = {}
    spent = 0

    def visit(at: int, room: int, chosen: Filling) -> None:
        nonlocal spent
        spent += 1
        if room in left and left[room] and (not chosen or room <= chosen[-1]):
            found[(*chosen, room)] = 0
            return
        fitted = False
        for i in range(at, len(have)):
            x = have[i]
            if x > room or not left[x]:
                continue
            fitted = True
            if spent > effort.steps and found:
                effort.cut = True
                return
            left[x] -= 1
            visit(i, room - x, (*chosen, x))
            left[x] += 1
        if not fitted:
            found[chosen] = room

    visit(0, room, ())
    effort.spent += spent
    best = sorted(found, key=lambda f: (found[f], tuple(-x for x in f)))
    effort.cut |= len(best) > 4 * effort.width
    out: list[Filling] = []
    for f in best[: 4 * effort.width]:
        if not any(_dominated(f, g) for g in out):
            out.append(f)
    effort.cut |= len(out) > effort.width
    return out[: effort.width]


def complete(counts: np.ndarray, capacity: int, nodes: int = NODES, effort: Effort | None = None) -> list[tuple[Filling, int]]:
    """Bin completion with branch and bound; see the module's text."""
    incumbent = best_fit(counts, capacity)
    used = lambda solution: sum(n for _, n in solution)
    bound, best = lower_bound(counts, capacity), used(incumbent)
    total = int((counts * np.arange(len(counts))).sum())
    opened, restart, effort = 0, True, effort or Effort()
    spent = lambda: max(opened, effort.spent // STEPS)
    while best > bound and spent() < nodes and restart:
        restart = False
        left, taken, waste = counts.copy(), [], 0
        stack: list[Iterator] = []
        step = _branches(left, capacity, effort)
        stack.append(step)
        while stack and spent() < nodes:
            choice = next(stack[-1], None)
            if choice is None:
                stack.pop()
                if taken:
                    filling, n = taken.pop()
                    for x in filling:
                        left[x] += n
                    waste -= n * (capacity - sum(filling))
                continue
            filling, n = choice
            spare = (best - 1) * capacity - total
            lost = capacity - sum(filling)
            n = min(n, (spare - waste) // lost) if lost else n
            if n < 1:
                continue
            opened += 1
            for x in filling:
                left[x] -= n
            waste += n * lost
            taken.append((filling, n))
            if not left.any():
                incumbent, best, restart = list(taken), used(taken), True
                break
            if opened % 64 == 1:
                closed = best_fit(left, capacity)
                if used(taken) + used(closed) < best:
                    incumbent, best = [*taken, *closed], used(taken) + used(closed)
                    restart = True
                    if best == bound:
                        break
            stack.append(_branches(left, capacity, effort))
        if not restart and not stack and effort.cut:
            effort.widen()
            restart = True
    return incumbent


def _branches(left: np.ndarray, capacity: int, effort: Effort) -> Iterator[tuple[Filling, int]]:
    """Ways to fill a sequence around the largest document: as often as it can be, then once."""
    present = np.flatnonzero(left)
    if not len(present):
        return
    largest = int(present[-1])
    rest = left.copy()
    rest[largest] -= 1
    options = [tuple(sorted((largest, *f), reverse=True)) for f in fillings(rest, capacity - largest, effort)]
    often = [min(int(left[x]) // f.count(x) for x in set(f)) for f in options]
    yield from zip(options, often, strict=True)
    yield from ((f, 1) for f, n in zip(options, often, strict=True) if n > 1)


def solve(counts: np.ndarray, capacity: int, nodes: int = NODES) -> list[tuple[Filling, int]]:
    """Fillings and how often each is used, for a histogram indexed by length."""
    return complete(np.asarray(counts, dtype=np.int64), capacity, nodes)


@dataclass(frozen=True)
class Report:
    """Sequences of a solution, those that best fit takes, and those that any packing needs."""

    sequences: int
    best_fit: int
    needed: int


def report(counts: np.ndarray, capacity: int, solution: list[tuple[Filling, int]]) -> Report:
    return Report(sum(n for _, n in solution), sum(n for _, n in best_fit(counts, capacity)), lower_bound(counts, capacity))


def _places(solution: list[tuple[Filling, int]]) -> tuple[np.ndarray, ...]:
    """For each length, runs of numbers with their first sequence and their offset, sorted."""
    rows, seen, sequence = [], {}, 0
    for filling, n in solution:
        at = 0
        for length in filling:
            first = seen.get(length, 0)
            rows.append((length, first, sequence, at))
            seen[length] = first + n
            at += length
        sequence += n
    rows.sort()
    return tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4


def pack(pieces: DataFrame, length: str = "length", order: tuple[str, ...] = (), capacity: int = CAPACITY, per_block: int | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to settled pieces no longer than ``capacity``.

    ``pieces`` is read twice; lengths are counted, then pieces are numbered
    within their length. A length that more than ``per_block`` pieces share is
    numbered in parts of about that many: if not given, a task's share of all
    pieces, 256 at least and 200,000 at most.
    """
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.groupBy(length).agg(F.count(F.lit(1)).alias("n")).collect():
        if r[0] is None or not 1 <= r[0] <= capacity:
            raise ValueError(f"a piece has length {r[0]}; 1 to {capacity} are allowed")
        counts[r[0]] = r[1]
    solution = solve(counts, capacity)
    found = report(counts, capacity, solution)
    if found.sequences > found.needed:
        _log.warning("%d sequences (best fit: %d), of which %d are needed for certain", found.sequences, found.best_fit, found.needed)
    first = _places(solution)
    per_block = per_block or int(min(200_000, max(256, counts.sum() // int(spark.conf.get("spark.sql.shuffle.partitions")))))
    parts = spark.createDataFrame([(i, int(-(-n // per_block))) for i, n in enumerate(counts.tolist()) if n] or [(0, 1)], "_length int, _parts int")
    order = order or tuple(c for c in pieces.columns if c != length)
    split = F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.col("_parts"))
    joined = pieces.join(F.broadcast(parts), F.col(length) == F.col("_length")).drop("_length")
    numbered = dense_rank_ids(joined, [length], [F.col(c) for c in order], split, "_number").drop("_parts")
    shared = spark.sparkContext.broadcast(first)
    from pyspark.sql import types as T

    schema = T.StructType([*[f for f in numbered.schema.fields if f.name != "_number"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at, number = numbered.columns.index(length), numbered.columns.index("_number")
    kept = [i for i in range(len(numbered.columns)) if i != number]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, starts, sequences, offsets = shared.value
        order = lengths << 44 | starts
        for batch in batches:
            n = batch.column(number).to_numpy(zero_copy_only=False).astype(np.int64)
            key = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64) << 44 | n
            i = np.searchsorted(order, key, side="right") - 1
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array(sequences[i] + n - starts[i]), pa.array(offsets[i])], names=[f.name for f in schema.fields])

    return numbered.mapInArrow(run, schema)


def tokenize_pieces(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Pieces of whole texts: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``."""
    from pyspark.sql import types as T

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    fields = [rows.schema.fields[0], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.IntegerType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType([*fields, *([T.StructField("ids", T.BinaryType())] if keep_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("packing")
        coder = encoder(vocabulary, drops_space=True)
        for batch in batches:
            for first, _, whole, bounds in coder.encode_batch(batch.column(1), end_id):
                sizes = np.diff(bounds)
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, sizes[row] - start)
                parts = [whole[a:b] for a, b in zip((bounds[row] + start).tolist(), (bounds[row] + start + length).tolist(), strict=True)]
                made = [batch.column(0).take(pa.array(row + first)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*made, *([pa.array([x.tobytes() for x in parts], pa.binary())] if keep_ids else [])], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence, from packed pieces that kept theirs: ``sequence_id, ids, doc_ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("_p")).select(
        "sequence_id",
        F.aggregate("_p", F.lit(b""), lambda s, p: F.concat(s, p["ids"])).alias("ids"),
        F.transform("_p", lambda p: p["doc_id"]).alias("doc_ids"),
    )


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    pieces = settle(tokenize_pieces(docs, path or vocabulary()))
    return pack(pieces, order=("doc_id", "piece", "ids_crc32")).withColumn("length", F.col("length").cast("long"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
