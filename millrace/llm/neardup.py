"""Near-duplicates by improved consistent weighted sampling.

A text is the weighted set of its 5-word shingles, weighted by TF-IDF. Samples
of improved consistent weighted sampling are equal between two texts with the
probability of their weighted Jaccard similarity. Samples are banded, texts that
share a band are compared, and a pair whose weighted Jaccard similarity reaches
``threshold`` is linked; links make classes.

Weights. A shingle weighs ``tf * (1 + DAMPING * idf)`` with
``idf = log(N / df) / log(N)``, from 1 for a shingle of one document to 0 for one
of all, in ``LEVELS`` steps. Document frequencies of all shingles come from one
pass over all documents into a table of ``CELLS`` counters (a shingle's hash
picks its counter; the median counter is taken off as what other shingles add),
so that what is sent and broadcast has one size for any corpus. The damping is
there because a large group of copies makes its own shingles common: with the
full idf, the few words in which its members differ would outweigh all they
share.

Sampling. The random variables of a shingle come from a pool, picked by the
shingle's hash, so that all its samples cost one look-up.

Comparing. Texts equal in full are one node (by MD5). In every band group,
members are compared with a leader, the member with most company over all
bands. Only where candidates that hang together then still hold several classes,
members of different classes are held against each other: by signatures of 125
bytes in blocks, where each block holds parts of one class or small classes
whole, and blocks of one class never meet. Members that look similar to one of
another class then meet with their texts. No group is collected into one task,
and no group is expanded into all its pairs.

Defined results: texts without words (null, empty) are alone in their class,
which bears their id; texts of fewer than 5 words are one shingle; repeated rows
share a class; texts of any length are whole; columns besides id and text are
not looked at. A class is named by its smallest id. Where ids are null or belong
to several texts, so that this names no class or more than one, ``class_id`` of
the class with the smaller ``class_key`` stands and the others' is a negative
number made from their key; ``class_key`` (MD5 of one of its texts) always tells
classes apart. Whole numbers as ids give ``class_id`` as long, all others as
string. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._shared import discard, free_prefix, release, settle, stage, table
from millrace.llm._worker import begin, held
from millrace.llm.components import components, contracted
from millrace.llm.substrings import rolling
from millrace.llm.words import U, scramble, utf8, words_in

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
DAMPING, LEVELS = 0.25, 8
#: Counters of document frequencies, and how many travel as one row.
CELLS, CELL_BLOCK = 1 << 22, 1 << 16
#: Random variables in the pool of each sample.
POOL = 1 << 13
#: Estimated similarity from which a pair of signatures is compared in full (five deviations below the threshold).
LOOKS_SIMILAR = 0.62
#: Signatures and bytes of text in a block; members that one copy of a leader's text serves.
BLOCK, BLOCK_BYTES, SERVED = 1024, 8_000_000, 2048


def shingles(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text, ascending, and how often each occurs."""
    h = words_in(utf8(text))[2]
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(rolling(h, min(size, len(h)), 0), return_counts=True)


def cells_of(hashes: np.ndarray) -> np.ndarray:
    return (scramble(hashes) >> U(64 - CELLS.bit_length() + 1)).astype(np.int64)


class Weights:
    """TF-IDF weights, given the counters of document frequencies."""

    def __init__(self, documents: int, counters: np.ndarray):
        others = int(np.partition(counters, len(counters) // 2)[len(counters) // 2])
        self.level = np.empty(len(counters), np.uint8)
        # In blocks: this runs in the driver, where whole tables of wide numbers would count.
        for k in range(0, len(counters), CELL_BLOCK):
            frequency = np.clip(counters[k : k + CELL_BLOCK].astype(np.int64) - others, 1, max(1, documents))
            idf = np.log(documents / frequency) / math.log(documents) if documents > 1 else np.ones(len(frequency))
            self.level[k : k + CELL_BLOCK] = np.rint(np.clip(idf, 0.0, 1.0) * (LEVELS - 1))

    def __call__(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return counts * weight_of(self.level[cells_of(hashes)])


def weight_of(level: np.ndarray) -> np.ndarray:
    """The weight of a shingle that occurs once."""
    return 1.0 + DAMPING * level / (LEVELS - 1)


class Sampler:
    """Improved consistent weighted sampling with pooled random variables.

    Tables have a row per place in the pool and a column per sample, so that a
    shingle's variables lie side by side. Of shingles in one place of the pool,
    the one with the smaller hash stands for both.
    """

    def __init__(self, samples: int, seed: int = 20260102):
        rng = np.random.default_rng(seed)
        shape = (POOL, samples)
        self.r = rng.gamma(2.0, 1.0, shape).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, shape)).astype(np.float32)
        self.beta = rng.random(shape, dtype=np.float32)
        self.salt = np.arange(samples, dtype=np.uint64)
        self.usual = weight_of(np.arange(LEVELS))
        every = np.arange(POOL)
        #: What is minimised for a shingle that occurs once: a row per level and place.
        self.once = np.concatenate([self._rows(every, np.full(POOL, w)) for w in self.usual])

    def _rows(self, places: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The logarithms of what is minimised, a row per shingle."""
        r = self.r[places]
        t = np.floor(np.log(weights).astype(np.float32)[:, None] / r + self.beta[places])
        return self.log_c[places] - r * (t - self.beta[places]) - r

    def __call__(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One 64-bit sample per sampling of a weighted set with ascending hashes."""
        samples = len(self.salt)
        best, chosen = np.full(samples, np.inf, np.float32), np.zeros(samples, np.int64)
        places = (scramble(hashes) % U(POOL)).astype(np.int64)
        level = np.clip(np.rint((weights - 1.0) / DAMPING * (LEVELS - 1)), 0, LEVELS - 1).astype(np.int64)
        other = self.usual[level] != weights
        for i in range(0, len(hashes), 1 << 13):
            part = slice(i, i + (1 << 13))
            a = self.once[level[part] * POOL + places[part]]
            if other[part].any():
                at = np.flatnonzero(other[part])
                a[at] = self._rows(places[part][at], weights[part][at])
            least, first = _least(a)
            better = least < best
            best[better], chosen[better] = least[better], first[better] + i
        at = places[chosen], np.arange(samples)
        t = np.floor(np.log(weights[chosen]).astype(np.float32) / self.r[at] + self.beta[at]).astype(np.int64)
        return scramble(hashes[chosen] ^ scramble(t.view(np.uint64) * U(0x9E3779B97F4A7C15) + self.salt))


def _least(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least of every column and the first row that has it."""
    least = a.min(axis=0)
    row, k = np.nonzero(a == least)
    first = np.zeros(a.shape[1], np.int64)
    first[k[::-1]] = row[::-1]
    return least, first


def bands_of(samples: np.ndarray) -> np.ndarray:
    """One 64-bit value per band."""
    parts = samples.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        out = scramble(out * U(0x9E3779B97F4A7C15) + parts[:, j])
    return out.view(np.int64)


def _sampler() -> Sampler:
    return held("sampler", lambda: Sampler(BANDS * ROWS))


def similarity(a: tuple, b: tuple, weights: Weights) -> float:
    """Weighted Jaccard similarity of two shingle sets."""
    (h, n), (g, m) = a, b
    _, i, j = np.intersect1d(h, g, assume_unique=True, return_indices=True)
    x, y = weights(h, n), weights(g, m)
    both = float(np.minimum(x[i], y[j]).sum())
    return both / max(1e-300, float(x.sum() + y.sum()) - both)


def count_documents(texts: DataFrame) -> Weights:
    """Weights from the document frequencies of all shingles in all ``texts`` (one column).

    A task sends its counters in blocks, small numbers in one byte each and
    compressed; blocks are added up in two steps, so that no task receives more
    than the square root of their number.
    """
    spark = texts.sparkSession
    salts = max(1, math.isqrt(texts.rdd.getNumPartitions()))
    schema = "block int, salt int, documents long, body binary"

    def rows(counters: np.ndarray, documents: int, salt: int) -> Iterator[pa.RecordBatch]:
        for k in range(0, CELLS, CELL_BLOCK):
            part = counters[k : k + CELL_BLOCK]
            if k == 0 or part.any():
                made = [pa.array([k // CELL_BLOCK], pa.int32()), pa.array([salt], pa.int32()), pa.array([documents if k == 0 else 0]), pa.array([_packed(part)], pa.binary())]
                yield pa.RecordBatch.from_arrays(made, names=["block", "salt", "documents", "body"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        begin("near-duplicates")
        counters, documents = np.zeros(CELLS, dtype=np.int64), 0
        for batch in batches:
            documents += batch.num_rows
            for body in batch.column(0):
                np.add.at(counters, cells_of(shingles(body.as_py())[0]), 1)
        yield from rows(counters, documents, TaskContext.get().partitionId() % salts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for block, documents, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                have = sums.setdefault(block, [0, np.zeros(CELL_BLOCK, np.int64)])
                have[0] += documents
                have[1] += _unpacked(body.as_py())
        for block, (documents, part) in sums.items():
            made = [pa.array([block], pa.int32()), pa.array([0], pa.int32()), pa.array([documents]), pa.array([_packed(part)], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=["block", "salt", "documents", "body"])

    counted = texts.mapInArrow(count, schema)
    if salts > 1:
        counted = counted.repartition("block", "salt").mapInArrow(add, schema)
    total = counted.repartition("block").mapInArrow(add, schema)
    found = total.collect()  # CELLS numbers, whatever the corpus
    return Weights(sum(r["documents"] for r in found), _table({r["block"]: bytes(r["body"]) for r in found}))


def _table(blocks: dict[int, bytes]) -> np.ndarray:
    """All counters, from their blocks, in the narrowest of the blocks' types that holds them."""
    counters = np.zeros(CELLS, max((np.dtype(body[:3].decode()) for body in blocks.values()), key=lambda kind: kind.itemsize, default=np.dtype("<u1")))
    for k, body in blocks.items():
        counters[k * CELL_BLOCK :][:CELL_BLOCK] = _unpacked(body)
    return counters


def _packed(counters: np.ndarray) -> bytes:
    import zstandard

    kind = next(k for k in ("<u1", "<u4", "<i8") if counters.max(initial=0) <= np.iinfo(k).max)
    return kind.encode() + zstandard.ZstdCompressor(level=1).compress(counters.astype(kind).tobytes())


def _unpacked(body: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(body[3:]), dtype=body[:3].decode()).astype(np.int64)


def text_key(text: str):
    return F.unhex(F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")))


def sign(docs: DataFrame, doc_id: str, text: str, weights) -> DataFrame:
    """``doc, key, size, bands, signature`` of every document; no bands where there are no words."""
    rows = docs.select(F.col(doc_id).alias("doc"), text_key(text).alias("key"), F.octet_length(text).cast("long").alias("size"), F.col(text).alias("_text"))
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("signature", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("near-duplicates")
        sampler, weigh = _sampler(), weights.value
        for batch in batches:
            bands, signatures = [], []
            for body in batch.column(3):
                h, n = shingles(body.as_py())
                if len(h):
                    samples = sampler(h, weigh(h, n))
                    bands.append(bands_of(samples))
                    signatures.append((samples >> U(17)).astype(np.uint8).tobytes())
                else:
                    bands.append(np.zeros(0, np.int64))
                    signatures.append(b"")
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def _verify(pairs: DataFrame, texts: DataFrame, weights, threshold: float) -> DataFrame:
    """``u, v`` of the pairs (member, leader) whose texts are similar enough.

    A leader's text travels once for ``SERVED`` members, not once for each.
    """
    leaders = settle(pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / SERVED).cast("int").alias("parts")))
    held_texts = texts.select(F.col("key").alias("_k"), "text")
    dealt = pairs.join(leaders.withColumnRenamed("v", "_v"), F.col("v") == F.col("_v")).select("u", "v", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part"))
    members = dealt.join(held_texts, F.col("u") == F.col("_k")).select("v", "part", "u", "text")
    lead = leaders.join(held_texts, F.col("v") == F.col("_k")).select("v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("binary").alias("u"), "text")
    met = lead.unionByName(members).repartition("v", "part").sortWithinPartitions("v", "part", F.col("u").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("near-duplicates")
        weigh, leader = weights.value, None
        for batch in batches:
            keep = []
            for u, body in zip(batch.column(2), batch.column(3), strict=True):
                if not u.is_valid:
                    leader = shingles(body.as_py())
                    keep.append(False)
                else:
                    keep.append(similarity(shingles(body.as_py()), leader, weigh) >= threshold - 1e-12)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(run, "u binary, v binary")


def _in_blocks(members: DataFrame) -> DataFrame:
    """Deals the members (key, group, root, size, ...) of open groups into blocks: adds ``own``, ``skip`` and ``past``.

    A class over a block's load has blocks of its own, ``skip`` to ``past - 1``;
    the others share blocks by their root, and skip none.
    """
    load = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_BYTES)).cast("int")
    classes = settle(members.groupBy("group", "root").agg(load.alias("parts"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")))
    shared = classes.filter("parts = 1").groupBy("group").agg(F.ceil(F.greatest(F.sum("n") / BLOCK, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("shared"))
    counted = classes.join(shared.withColumnRenamed("group", "_g"), F.col("group") == F.col("_g"), "left").drop("_g").fillna(0, ["shared"])
    # A row per large class, of which there is at most one in BLOCK members of a group.
    large = counted.filter("parts > 1")
    large = large.withColumn("skip", (F.col("shared") + F.sum("parts").over(Window.partitionBy("group").orderBy("root")) - F.col("parts")).cast("int"))
    large = large.select("group", "root", "parts", "skip", (F.col("skip") + F.col("parts")).alias("past"))
    small = counted.filter("parts = 1").select("group", "root", F.col("shared").alias("parts"), F.lit(0).alias("skip"), F.lit(0).alias("past"))
    blocks = shared.select("group", F.col("shared").alias("blocks")).unionByName(large.select("group", F.col("parts").alias("blocks"))).groupBy("group").agg(F.sum("blocks").cast("int").alias("blocks"))
    each = large.unionByName(small).join(blocks.withColumnRenamed("group", "_g"), F.col("group") == F.col("_g")).select(F.col("root").alias("_root"), "parts", "skip", "past", "blocks")
    by = F.when(F.col("past") > 0, F.xxhash64("key")).otherwise(F.xxhash64("root"))
    return members.join(settle(each), F.col("root") == F.col("_root")).withColumn("own", (F.col("skip") + F.pmod(by, F.col("parts"))).cast("int")).drop("_root", "parts")


def _meeting(rows: DataFrame, kept: tuple[str, ...]) -> DataFrame:
    """Every row beside the blocks that its own one meets: ``group, i, j, side`` and ``kept``, in that order."""
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: (b < F.col("skip")) | (b >= F.col("past")))
    met = rows.select("group", "own", F.explode(others).alias("_b"), *kept)
    met = met.select("group", F.least("own", "_b").alias("i"), F.greatest("own", "_b").alias("j"), F.when(F.col("own") <= F.col("_b"), 0).otherwise(1).alias("side"), *kept)
    return met.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "side", "key")


def _unresolved(pairs: DataFrame, roots: DataFrame, nodes: DataFrame, texts: DataFrame, weights, threshold: float) -> DataFrame:
    """Links ``u, v`` between classes whose members share bands, directly or through others.

    Classes that pairs connect form groups, all members of which are dealt in
    blocks. Every two blocks that may hold different classes meet in one task,
    with signatures alone; members that look similar to one of another class
    meet there again with their texts, and are compared in full, the likeliest
    first. A link joins two classes for the rest of the task, so that a task gives fewer links than
    it has members.
    """
    groups = settle(components(contracted(pairs, roots)).select(F.col("node").alias("_n"), F.col("root").alias("group")))
    if not groups.limit(1).count():
        return groups.select(F.col("_n").alias("u"), F.col("group").alias("v"))
    linked = roots.join(groups, F.col("root") == F.col("_n")).select(F.col("node").alias("key"), "group", "root")
    alone = groups.join(roots, F.col("_n") == F.col("node"), "left_anti").select(F.col("_n").alias("key"), "group", F.col("_n").alias("root"))
    members = linked.unionByName(alone).join(nodes.select(F.col("key").alias("_k"), "size", "signature"), F.col("key") == F.col("_k")).drop("_k")
    rows = settle(_in_blocks(settle(members)))
    release(rows.sparkSession)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, held_rows in _by_place(batches):
            likely = _likely(held_rows, place)
            n = len(likely)
            made = [pa.array([place[0]] * n, pa.binary()), pa.array([place[1]] * n, pa.int32()), pa.array([place[2]] * n, pa.int32()), pa.array([held_rows[k][0] for k in likely], pa.int32())]
            made += [pa.array([held_rows[k][c] for k in likely], pa.binary()) for c in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays(made, names=["group", "i", "j", "side", "key", "root", "signature"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("near-duplicates")
        for place, held_rows in _by_place(batches):
            yield _join_classes(held_rows, weights.value, threshold, place)

    found = settle(_meeting(rows, ("key", "root", "signature")).mapInArrow(look, "group binary, i int, j int, side int, key binary, root binary, signature binary"))
    again = found.join(texts.select(F.col("key").alias("_k"), "text"), F.col("key") == F.col("_k")).drop("_k")
    again = again.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "side", "key")
    return again.mapInArrow(compare, "u binary, v binary")


def _by_place(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[list]]]:
    """Rows (side, key, class, signature, ...) of two blocks at a time, with the place (group, i, j)."""
    now, rows = None, []
    for batch in batches:
        for group, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (group, i, j) != now:
                if rows:
                    yield now, rows
                now, rows = (group, i, j), []
            rows.append(row)
    if rows:
        yield now, rows


def _pairs_of(rows: list[list], place: tuple) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, rows of another class that look similar to it, how similar), each pair once."""
    signatures = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
    names = {c: k for k, c in enumerate(dict.fromkeys(r[2] for r in rows))}
    classes = np.array([names[r[2]] for r in rows])
    left = sum(r[0] == 0 for r in rows)
    alone = place[1] == place[2]
    for i in range(left if len(names) > 1 else 0):
        first = i + 1 if alone else left
        like = ((signatures[i] == signatures[first:]).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
        near = np.flatnonzero((like >= LOOKS_SIMILAR) & (classes[first:] != classes[i]))
        if len(near):
            yield i, first + near, like[near]


def _likely(rows: list[list], place: tuple) -> list[int]:
    """The rows that look similar to one of another class."""
    found = np.zeros(len(rows), dtype=bool)
    for i, near, _ in _pairs_of(rows, place):
        found[i] = found[near] = True
    return np.flatnonzero(found).tolist()


def _join_classes(rows: list[list], weigh: Weights, threshold: float, place: tuple) -> pa.RecordBatch:
    """Links that join classes among the members (side, key, class, signature, text) of two blocks."""
    u, v, sets = [], [], {}
    parent = {r[2]: r[2] for r in rows}

    def find(x: bytes) -> bytes:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def shingled(k: int) -> tuple:
        if k not in sets:
            sets[k] = shingles(rows[k][4])
        return sets[k]

    for i, near, like in _pairs_of(rows, place):
        for j in near[np.argsort(-like, kind="stable")].tolist():
            a, b = find(rows[i][2]), find(rows[j][2])
            if a != b and similarity(shingled(i), shingled(j), weigh) >= threshold - 1e-12:
                parent[max(a, b)] = min(a, b)
                u.append(max(rows[i][1], rows[j][1]))
                v.append(min(rows[i][1], rows[j][1]))
    return pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])


def _named(placed: DataFrame) -> DataFrame:
    """``root, class_id`` of classes, from their members (key, doc, root); see the module's text."""
    whole = isinstance(placed.schema["doc"].dataType, T.IntegralType)
    least = placed.groupBy("root").agg(F.min("doc").cast("long" if whole else "string").alias("least"))
    # Ids come once in most tables, and then every class has a name of its own.
    taken = least.groupBy("least").agg(F.min("root").alias("owner")).withColumnRenamed("least", "_l")
    other = -F.pmod(F.xxhash64("root"), F.lit(2**62)) - 1 if whole else F.concat(F.lit("class "), F.hex("root"))
    own = (F.col("root") == F.col("owner")) & F.col("least").isNotNull()
    return least.join(taken, F.col("least").eqNullSafe(F.col("_l"))).select(F.col("root").alias("_r"), F.when(own, F.col("least")).otherwise(other).alias("class_id"))


def find_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc, key, class_id, class_key``: a row for each row of ``docs``; ``key`` is the MD5 of its text."""
    spark = docs.sparkSession
    weights = spark.sparkContext.broadcast(count_documents(docs.select(F.col(text).alias("_text"))))
    signed = settle(sign(docs, doc_id, text, weights))
    worded = signed.filter(F.size("bands") > 0)
    nodes = settle(worded.groupBy("key").agg(F.min("doc").alias("doc"), *[F.first(c).alias(c) for c in ("size", "bands", "signature")]))
    release(spark)

    rows = nodes.select("key", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    rows = settle(rows.join(shared.withColumnRenamed("band", "_b"), F.col("band") == F.col("_b")).drop("_b"))
    company = rows.groupBy("key").agg(F.sum("size").alias("company")).withColumnRenamed("key", "_k")
    ranked = rows.join(company, F.col("key") == F.col("_k")).drop("_k", "size")
    leads = ranked.groupBy("band").agg(F.max(F.struct("company", "key"))["key"].alias("lead")).withColumnRenamed("band", "_b")
    bands = settle(rows.drop("size").join(leads, F.col("band") == F.col("_b")).drop("_b"))
    pairs = settle(bands.filter("key <> lead").select(F.col("key").alias("u"), F.col("lead").alias("v")).distinct())
    release(spark)

    wanted = bands.select("key").distinct().join(nodes.select(F.col("key").alias("_k"), "doc"), F.col("key") == F.col("_k")).drop("_k").withColumnRenamed("key", "_key")
    here = docs.select(F.col(doc_id).alias("_doc"), text_key(text).alias("key"), F.col(text).alias("text"))
    texts = here.join(wanted, (F.col("key") == F.col("_key")) & F.col("_doc").eqNullSafe(F.col("doc"))).select("key", "text")
    if worded.groupBy("doc", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        texts = texts.groupBy("key").agg(F.first("text").alias("text"))
    texts, path = stage(texts)
    release(spark)

    links = settle(_verify(pairs, texts, weights, threshold))
    release(spark)
    roots = settle(components(links))
    release(spark)
    found = settle(_unresolved(pairs, roots, nodes, texts, weights, threshold))
    discard(spark, path)
    release(spark)
    placed = nodes.select("key").join(roots, F.col("key") == F.col("node"), "left").select("key", F.coalesce("root", "key").alias("root"))
    if found.limit(1).count():
        joined = settle(components(contracted(found, roots))).select(F.col("node").alias("_n"), F.col("root").alias("_joined"))
        placed = placed.join(joined, F.col("root") == F.col("_n"), "left").select("key", F.coalesce("_joined", "root").alias("root"))
    # A document without words is a class of its own, told apart by its id.
    wordless = F.unhex(F.md5(F.encode(F.concat(F.lit("no words "), F.coalesce(F.col("doc").cast("string"), F.lit("null")), F.hex("key")), "UTF-8")))
    rooted = signed.select("doc", "key", (F.size("bands") > 0).alias("worded")).join(placed.withColumnRenamed("key", "_k"), F.col("worded") & (F.col("key") == F.col("_k")), "left")
    rooted = settle(rooted.select("doc", "key", F.coalesce("root", wordless).alias("root")))
    named = _named(rooted)
    return rooted.join(named, F.col("root") == F.col("_r")).select("doc", "key", "class_id", F.lower(F.hex("root")).alias("class_key"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class with words, with all its columns, whatever their names.

    It is the one with the smallest id and, among texts of that id, the smallest
    MD5; a null id comes last. Of rows that repeat it in full one stays; rows
    without words all stay.
    """
    p = free_prefix(docs.columns)
    found = settle(find_classes(docs, doc_id, text))
    release(docs.sparkSession)
    # Sorted by (is the id null, id, key), the least of a class stays.
    order = F.struct(F.col("doc").isNull().alias("a"), F.col("doc").alias("b"), F.col("key").alias("c"))
    stay = found.groupBy("class_key").agg(F.min(order).alias("s"), F.count(F.lit(1)).alias("n"))
    stay = settle(stay.select(F.col("s.b").alias(f"{p}doc"), F.col("s.c").alias(f"{p}key")))
    wordless = ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    here = docs.withColumn(f"{p}here", text_key(text))
    kept = here.join(stay, F.col(doc_id).eqNullSafe(F.col(f"{p}doc")) & (F.col(f"{p}here") == F.col(f"{p}key")), "left_semi")
    if found.groupBy("doc", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        kept = here.filter(wordless).unionByName(kept.filter(~wordless).dropDuplicates([doc_id, f"{p}here"]))
    return kept.select(*docs.columns)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "class_id", "class_key")
