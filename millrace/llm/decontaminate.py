"""Benchmark decontamination with one Aho-Corasick automaton.

Test questions and answers are normalised to lower-case words, and so is a text,
whose words are then scanned once; hits are mapped back to places in the
original text.

The automaton reads words, not letters: each word of the benchmark has a number,
and all other words are 0. A window of ``width`` item words (or a shorter item as
a whole) counts as found where all its words stand in a row. Patterns are not all
windows, which would be ``width`` times the benchmark, but blocks of
``BLOCK_WORDS`` words at every ``width - BLOCK_WORDS + 1``-th place of an item:
every window holds one. Where a block occurs, its neighbours in the item are held
against those in the text, which tells exactly the windows around it.

Defined results: null and wordless texts have no words and no hits; items
without words have no patterns; equal items each count; repeated documents are
judged alike; texts of any length are scanned whole; an empty benchmark leaves
every document clean; an item without an id is listed as an empty string.
Columns to be kept may bear any name but those of results.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm._shared import staged, table
from millrace.llm._worker import begin, held

#: A-Z become a-z; digits, a-z and all bytes of non-ASCII characters stay; the rest separates words.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

#: Words of a pattern.
BLOCK_WORDS = 5
#: Benchmark words in one automaton (some 200 bytes of memory each); a longer benchmark is scanned for in rounds.
AUTOMATON_WORDS = 1_000_000


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Scanner:
    """The automaton of some items (id, words) for windows of ``width`` words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.width, self.block = width, min(BLOCK_WORDS, width)
        self.numbers: dict[bytes, int] = {}
        self.items = [(name, tuple([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words])) for name, words in items]
        # Block -> its neighbours in items (at most as far as a window reaches) -> one place, and all items.
        patterns: dict[tuple, dict[tuple, tuple[int, int, list[str]]]] = defaultdict(dict)
        more = width - self.block
        for k, (name, words) in enumerate(self.items):
            if 0 < len(words) < width:
                patterns[words].setdefault((), (k, -1, []))[2].append(name)
            for i in range(0, len(words) - self.block + 1, more + 1) if len(words) >= width else ():
                around = (words[max(0, i - more) : i], words[i + self.block : i + self.block + more])
                patterns[words[i : i + self.block]].setdefault(around, (k, i, []))[2].append(name)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for words, places in patterns.items():
            self.automaton.add_word(words, (len(words), list(places.values())))
        self.empty = not patterns
        if patterns:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items of which windows occur."""
        hit, found = np.zeros(len(words), dtype=bool), set()
        if self.empty or not words:
            return hit, found
        number = self.numbers.get
        text = tuple([number(w, 0) for w in words])
        for end, (n, places) in self.automaton.iter(text):
            for k, at, names in places:
                if at < 0:
                    hit[end - n + 1 : end + 1] = True
                    found.update(names)
                    continue
                item = self.items[k][1]
                # Every window that holds this block reaches at most so far to either side.
                more = self.width - n
                a, b = end - n + 1, end + 1
                left = right = 0
                while left < more and a - left > 0 and at - left > 0 and text[a - left - 1] == item[at - left - 1]:
                    left += 1
                while right < more and b + right < len(text) and at + n + right < len(item) and text[b + right] == item[at + n + right]:
                    right += 1
                if left + n + right >= self.width:
                    hit[a - left : b + right] = True
                    found.update(names)
        return hit, found


def _rounds(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items with their words, in rounds of about ``limit`` words.

    The benchmark is streamed to the driver one partition at a time; a round
    holds whole items, so that it exceeds ``limit`` by less than an item.
    """
    now: list[tuple[str, list[bytes]]] = []
    size = 0
    for row in benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")), text).toLocalIterator():
        now.append((row[0], _words(row[1])))
        size += len(now[-1][1])
        if size >= limit:
            yield now
            now, size = [], 0
    yield now


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    limit: int = AUTOMATON_WORDS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Returns ``doc_id, n_words, n_hit, items, spans`` of every document, and the columns in ``keep``.

    ``spans`` are places (start, end in code points) of hit words in the
    original text, touching words joined; ``items`` are the item ids found. A
    benchmark above ``limit`` words is scanned for in rounds, each adding its
    finds to those before, which are written to the shared folder. Kept columns that bear the
    name of a result are left out.
    """
    names = [n for n in dict.fromkeys([doc_id, *(keep or [])]) if n not in RESULTS]
    found = _find(docs, benchmark, names, text, item_id, item_text, width, limit)
    return found.toDF(*names, *RESULTS)


RESULTS = ("n_words", "n_hit", "items", "spans")


def _find(docs: DataFrame, benchmark: DataFrame, names: list[str], text: str, item_id: str, item_text: str, width: int, limit: int) -> DataFrame:
    """The columns ``names`` as ``_0``, ``_1`` and so on, and the results."""
    places = [f"_{i}" for i in range(len(names))]
    kept = docs.select(*[F.col(n).alias(p) for n, p in zip(names, places, strict=True)], F.col(text).alias("_text"))
    out = kept.withColumns({"_items": F.array().cast("array<string>"), "_hits": F.array().cast("array<array<int>>")})
    rounds = _rounds(benchmark, item_id, item_text, limit)
    items = next(rounds)
    while items is not None:
        following = next(rounds, None)
        shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, width, items))
        out = _scan_round(out, places, shared, kept.drop("_text").schema, last=following is None)
        if following is not None:
            out = staged(out)  # else a task would hold the automata of all rounds at once
        items = following
    return out


def _scan_round(df: DataFrame, names: list[str], shared, kept_schema, last: bool) -> DataFrame:
    if last:
        fields = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("items", T.ArrayType(T.StringType())), ("spans", T.ArrayType(T.ArrayType(T.IntegerType())))]
    else:
        fields = [("_text", T.StringType()), ("_items", T.ArrayType(T.StringType())), ("_hits", T.ArrayType(T.ArrayType(T.IntegerType())))]
    schema = T.StructType([*kept_schema.fields, *[T.StructField(n, t) for n, t in fields]])
    kinds = [to_arrow_type(t) for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("decontamination")
        name, width, items = shared.value
        scanner = held(("scanner", name), lambda: Scanner(items, width))
        for batch in batches:
            made: list[list] = [[] for _ in fields]
            texts, items, hits = (batch.column(batch.schema.get_field_index(n)) for n in ("_text", "_items", "_hits"))
            for text, seen, runs in zip(texts, items, hits, strict=True):
                text = text.as_py()
                words = _words(text)
                hit, found = scanner.scan(words)
                seen, runs = seen.as_py(), runs.as_py()
                for a, b in runs:
                    hit[a:b] = True
                found.update(seen)
                edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                runs = edges.reshape(-1, 2).tolist()
                if last:
                    row = (len(words), int(hit.sum()), sorted(found), _places(text, runs))
                else:
                    row = (text, sorted(found), runs)
                for column, value in zip(made, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(names))], *[pa.array(v, type=k) for v, k in zip(made, kinds, strict=True)]],
                names=[f.name for f in schema.fields],
            )

    return df.mapInArrow(run, schema)


def _places(text: str | None, runs: list[list[int]]) -> list[list[int]]:
    if not runs:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [[at[a][0], at[b - 1][1]] for a, b in runs]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns."""
    found = _find(docs, benchmark, docs.columns, "text", "item_id", "text", width, AUTOMATON_WORDS)
    return found.filter("n_hit = 0").drop(*RESULTS).toDF(*docs.columns)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
