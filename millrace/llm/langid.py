"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A 3-gram's vector binds (by
multiplication) the vectors of its letters, each permuted (rotated) by its
place. A text's vector bundles (adds) its 3-grams, a language prototype bundles
its training texts, and a text belongs to the prototype with the largest cosine.

Letters are lower-cased and folded into :data:`SYMBOLS` symbols (a-z each have
their own, other letters share the rest by code point); all that is not a letter
is one word boundary. The average of all prototypes, which is what languages
have in common, is taken off each prototype before cosines are taken.

Training adds up integers, so prototypes don't depend on how rows are dealt.
What workers send is one vector per language and task.

Defined results: null texts and texts without a letter give ``und`` with score
0; with nothing to learn from, every text gives ``und``; equal texts get equal
predictions; an empty table gives no rows; whole texts count at any length.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._shared import free_prefix, table
from millrace.llm._worker import begin, held

SYMBOLS = 64
DIMENSIONS = 1024
GRAM = 3
#: Vectors of 3-grams that a worker keeps, and that are added up at once.
MEMORY, TOGETHER = 1 << 16, 4096
#: Languages whose counts a task of :func:`learn` holds at once.
HELD = 32
UNKNOWN = "und"


def letter_vectors(dimensions: int = DIMENSIONS) -> np.ndarray:
    """One random +1/-1 vector for each symbol, the same everywhere."""
    return np.random.default_rng(20260101).choice(np.array([-1, 1], dtype=np.int8), size=(SYMBOLS, dimensions))


class _Folding:
    """Code point -> symbol, extended as code points are met. 0 is the boundary."""

    def __init__(self):
        self.table = np.full(sys.maxunicode + 2, 255, dtype=np.uint8)

    def __call__(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        out = self.table[points]
        if (out == 255).any():
            for p in np.unique(points[out == 255]):
                c = chr(p)
                low = c.lower()[:1]
                self.table[p] = 0 if not c.isalpha() else 1 + ord(low) - 97 if "a" <= low <= "z" else 27 + ord(low) % (SYMBOLS - 27)
            out = self.table[points]
        return out


_fold = _Folding()


def gram_codes(text: str) -> np.ndarray:
    """Codes of a text's 3-grams over symbols; runs of boundaries count as one."""
    s = _fold(text)
    s = np.concatenate((np.zeros(1, np.uint8), s, np.zeros(1, np.uint8)))
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))].astype(np.int32)
    if len(s) < GRAM:
        return s[:0]
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


class GramVectors:
    """Bound vectors of 3-grams, kept once made for at most ``MEMORY`` of them."""

    def __init__(self, dimensions: int = DIMENSIONS):
        letters = letter_vectors(dimensions)
        self.places = [np.roll(letters, GRAM - 1 - k, axis=1) for k in range(GRAM)]
        self.row = np.full(SYMBOLS**GRAM, -1, dtype=np.int32)
        self.rows = np.empty((0, dimensions), dtype=np.int8)
        self.used = 0

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of distinct codes."""
        new = codes[self.row[codes] < 0]
        if self.used + len(new) > MEMORY:
            return self._bound(codes)
        if len(new):
            if self.used + len(new) > len(self.rows):
                more = np.empty((min(MEMORY, max(4096, 2 * (self.used + len(new)))) - len(self.rows), self.rows.shape[1]), np.int8)
                self.rows = np.concatenate((self.rows, more))
            self.rows[self.used : self.used + len(new)] = self._bound(new)
            self.row[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
        return self.rows[self.row[codes]]

    def _bound(self, codes: np.ndarray) -> np.ndarray:
        a, b, c = codes // SYMBOLS**2, codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
        return self.places[0][a] * self.places[1][b] * self.places[2][c]

    def add(self, codes: np.ndarray, counts: np.ndarray, kind=np.int64) -> np.ndarray:
        """The sum of the codes' vectors, each as often as it counts, a bounded number of vectors at a time."""
        out = np.zeros(self.rows.shape[1], dtype=kind)
        for i in range(0, len(codes), TOGETHER):
            part = slice(i, i + TOGETHER)
            out += counts[part].astype(kind) @ self(codes[part]).astype(kind)
        return out


def bundle(vectors: GramVectors, counts: np.ndarray) -> np.ndarray:
    """The integer vector of gram counts (index: code)."""
    codes = np.flatnonzero(counts)
    return vectors.add(codes, counts[codes])


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes of all languages in ``docs``, over all its rows.

    Each task adds up gram counts per language and sends one bundled vector per
    language; the driver holds languages x dimensions numbers.
    """
    names, kinds = ["lang", "i", "v"], [pa.string(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = _kept(dimensions)
        counts: dict[str, np.ndarray] = {}

        def out(name: str) -> pa.RecordBatch:
            v = bundle(vectors, counts.pop(name))
            return pa.RecordBatch.from_arrays([pa.array([name] * len(v), kinds[0]), pa.array(np.arange(len(v)), kinds[1]), pa.array(v, kinds[2])], names=names)

        for batch in batches:
            for name, body in zip(batch.column(0), batch.column(1), strict=True):
                codes, n = np.unique(gram_codes(body.as_py()), return_counts=True)
                name = name.as_py()
                if name in counts:
                    counts[name] = counts.pop(name)  # the last is the one met last
                else:
                    if len(counts) == HELD:
                        yield out(next(iter(counts)))
                    counts[name] = np.zeros(SYMBOLS**GRAM, dtype=np.int64)
                counts[name][codes] += n
        for name in list(counts):
            yield out(name)

    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang), F.col(text))
    total = rows.mapInArrow(run, "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in total.orderBy("lang", "i").toLocalIterator():
        out.setdefault(r["lang"], np.zeros(dimensions, dtype=np.int64))[r["i"]] = r["v"]
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str], text: str = "text") -> DataFrame:
    """Returns ``keep``, ``lang_pred`` and ``score`` (the cosine, 0 at least).

    Kept columns that bear the name of a result are left out.
    """
    from pyspark.sql import types as T

    keep = [c for c in keep if c.lower() not in ("lang_pred", "score")]
    langs = sorted(prototypes)
    dimensions = len(next(iter(prototypes.values()))) if langs else DIMENSIONS
    matrix = np.zeros((len(langs), dimensions), dtype=np.float64)
    for k, name in enumerate(langs):
        matrix[k] = prototypes[name] / max(1.0, float(np.linalg.norm(prototypes[name])))
    centre = matrix.mean(axis=0) if len(langs) > 1 else np.zeros(dimensions)
    matrix = matrix - centre
    matrix = (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    middle = centre.astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((langs, matrix, middle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix, middle = shared.value
        vectors = _kept(dimensions)
        for batch in batches:
            found, scores = [], []
            for body in batch.column(len(keep)):
                codes = gram_codes(body.as_py() or "")
                name, score = UNKNOWN, 0.0
                if codes.any() and langs:
                    codes, n = np.unique(codes, return_counts=True)
                    v = vectors.add(codes, n, np.float32)
                    v /= max(1e-12, float(np.linalg.norm(v)))
                    v -= middle
                    cosines = matrix @ v / max(1e-12, float(np.linalg.norm(v)))
                    best = int(np.argmax(cosines))
                    name, score = langs[best], min(1.0, max(0.0, float(cosines[best])))
                found.append(name)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    rows = docs.select(*keep, F.col(text).alias(f"{free_prefix(keep)}text"))
    schema = T.StructType([*rows.schema.fields[: len(keep)], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def _kept(dimensions: int) -> GramVectors:
    """Vectors live as long as the worker serves this operator."""
    begin("languages")
    return held(("vectors", dimensions), lambda: GramVectors(dimensions))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the four fifths that aren't held out, predicts for all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    docs = docs.withColumn("held_out", fold == 0)
    prototypes = learn(docs.filter(~F.col("held_out")))
    return predict(docs, prototypes, ["doc_id", "held_out"])
