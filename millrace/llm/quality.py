"""Quality rules as weak supervision, in DataFrame functions only.

Each rule looks at one measure of a text and votes good, votes bad or abstains.
Expectation-maximisation over all documents estimates how far each vote can be
trusted, without labels, and a document is kept by its posterior probability of
being good, not by passing every rule.

The votes of a document form a pattern. Documents are first counted by pattern,
so the estimation sees at most ``3 ** len(RULES)`` rows however many documents
there are, and the posterior becomes an ordinary column expression.

Defined results: a null or empty text has no words and all measures 0; rules
abstain where their measure has no basis; an empty table gives no rows; equal
rows get equal verdicts. Whole texts are measured at any length. 5-word windows
are compared by 64-bit hashes inside their own text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._shared import WORD_GAP, settle, staged, table

GOOD, BAD, ABSTAIN = 1, -1, 0


@dataclass(frozen=True)
class Rule:
    """Votes bad outside ``[low, high]``, good inside ``[good_low, good_high]``, else abstains."""

    name: str
    measure: str
    low: float
    high: float
    good_low: float
    good_high: float

    def vote(self) -> Column:
        m = F.expr(self.measure)
        return (
            F.when(m.isNull(), F.lit(ABSTAIN))
            .when((m < self.low) | (m > self.high), F.lit(BAD))
            .when(m.between(self.good_low, self.good_high), F.lit(GOOD))
            .otherwise(F.lit(ABSTAIN))
            .cast("byte")
        )


#: Measures are expressions over the columns of :func:`measure`.
RULES = (
    Rule("word_count", "n_words", 10, math.inf, 50, math.inf),
    Rule("word_length", "word_chars / nullif(n_words, 0)", 2.5, 12, 3.5, 7.5),
    Rule("symbols_a_word", "n_symbols / nullif(n_words, 0)", 0, 0.1, 0, 0.02),
    Rule("symbol_share", "n_symbols / nullif(word_chars, 0)", 0, 0.03, 0, 0.005),
    Rule("repeated_lines", "n_dup_lines / nullif(n_lines, 0)", 0, 0.3, 0, 0.1),
    Rule("repeated_words", "n_repeat_words / nullif(n_words, 0)", 0, 0.2, 0, 0.1),
    Rule("sentence_ends", "n_stops / nullif(n_words, 0)", 0.004, 0.6, 0.02, 0.35),
    Rule("letter_share", "n_letters / nullif(word_chars, 0)", 0.75, 1, 0.9, 1),
)


@dataclass(frozen=True)
class LabelModel:
    """``good`` and ``bad``: per rule, the probabilities of its votes (bad, abstain, good) in that class."""

    prior: float
    good: tuple[tuple[float, float, float], ...]
    bad: tuple[tuple[float, float, float], ...]

    def log_odds(self, votes: tuple[int, ...]) -> float:
        return math.log(self.prior / (1 - self.prior)) + sum(math.log(g[v + 1] / b[v + 1]) for g, b, v in zip(self.good, self.bad, votes, strict=True))

    def posterior(self, votes: list[Column]) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for g, b, v in zip(self.good, self.bad, votes, strict=True):
            w = [math.log(x / y) for x, y in zip(g, b, strict=True)]
            total = total + F.when(v == BAD, w[0]).when(v == GOOD, w[2]).otherwise(w[1])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100, prior: float = 0.8, trust: float = 0.85, strength: float = 0.002) -> LabelModel:
    """Expectation-maximisation over counted vote patterns.

    It starts from rules that are right with probability ``trust``. Estimated
    vote probabilities are mixed with that start by ``strength`` of the mass of
    the class, which keeps the two classes from changing places.
    """
    n_rules = len(patterns[0][0]) if patterns else 0
    start_good = ((1 - trust) / 2, (1 - trust) / 2, trust)
    start_bad = (trust / 2, 0.5, (1 - trust) / 2 + 1e-9)
    start_bad = tuple(x / sum(start_bad) for x in start_bad)
    model = LabelModel(prior, (start_good,) * n_rules, (start_bad,) * n_rules)
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        sums = {c: [[0.0, 0.0, 0.0] for _ in range(n_rules)] for c in "gb"}
        mass = {"g": 0.0, "b": 0.0}
        for votes, n in patterns:
            p = 1 / (1 + math.exp(-max(-60.0, min(60.0, model.log_odds(votes)))))
            for c, part in (("g", n * p), ("b", n * (1 - p))):
                mass[c] += part
                for j, v in enumerate(votes):
                    sums[c][j][v + 1] += part
        mixed = {}
        for c, start in (("g", start_good), ("b", start_bad)):
            extra = strength * total + 1.0
            mixed[c] = tuple(tuple((sums[c][j][k] + extra * start[k]) / (mass[c] + extra) for k in range(3)) for j in range(n_rules))
        new = LabelModel(min(0.99, max(0.01, (mass["g"] + prior) / (total + 1))), mixed["g"], mixed["b"])
        moved = max([abs(a - b) for x, y in ((new.good, model.good), (new.bad, model.bad)) for r, s in zip(x, y, strict=True) for a, b in zip(r, s, strict=True)], default=0)
        model = new
        if moved < 1e-6:
            break
    return model


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measures of a text (all ``long``) to ``df``."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_words", F.filter(F.split(body, WORD_GAP), lambda w: w != ""))
    df = df.withColumn("_lines", F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("_joined", F.array_join("_words", ""))
    df = df.withColumn("_hashed", F.transform("_words", lambda w: F.xxhash64(w)))
    windows = F.transform(
        F.sequence(F.lit(0), F.size("_words") - 5),
        lambda i: F.xxhash64(*[F.get(F.col("_hashed"), i + k) for k in range(5)]),
    )
    df = df.withColumn("_windows", F.when(F.size("_words") > 5, windows))
    # Only texts in which a window recurs need the places of those windows.
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_placed", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), placed))
    again = F.filter(
        "_placed",
        lambda x, k: (x["h"] == F.get(F.col("_placed"), k - 1)["h"]) | (x["h"] == F.get(F.col("_placed"), k + 1)["h"]),
    )
    df = df.withColumn("_again", F.array_sort(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(
        "_again",
        F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(5), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    whole = lambda c: c.cast("long")
    df = df.withColumns(
        {
            "n_words": whole(F.size("_words")),
            "word_chars": whole(F.length("_joined")),
            "n_symbols": whole(F.length(F.regexp_replace("_joined", r"[^#*$%&|<>]+", ""))),
            "n_lines": whole(F.size("_lines")),
            "n_dup_lines": whole(F.size("_lines") - F.size(F.array_distinct("_lines"))),
            "n_repeat_words": whole(F.coalesce(covered, F.lit(0))),
            "n_stops": whole(F.length(F.regexp_replace("_joined", r"[^.!?。؟।]+", ""))),
            "n_letters": whole(F.length(F.regexp_replace("_joined", r"[^\p{L}]+", ""))),
        }
    )
    return df.drop("_words", "_lines", "_joined", "_hashed", "_windows", "_placed", "_again")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stops", "n_letters")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """Adds ``votes``, ``quality`` (posterior) and ``kept`` to a measured, settled table.

    ``measured`` is read twice: once to count vote patterns, once to be judged.
    """
    voted = measured.withColumn("votes", F.array(*[r.vote() for r in rules]))
    counted = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()
    model = fit([(tuple(r["votes"]), r["n"]) for r in counted]) if counted else LabelModel(0.5, ((1 / 3,) * 3,) * len(rules), ((1 / 3,) * 3,) * len(rules))
    quality = model.posterior([F.get("votes", F.lit(j)) for j in range(len(rules))])
    return voted.withColumn("quality", quality).withColumn("kept", ~base_failed() & (F.col("quality") >= least))


def filter_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns, whatever their names.

    Rows are written once with their measures; votes are counted and judged on
    what was written, so that no row has to find its verdict again.
    """
    places = [f"c{i}" for i in range(len(docs.columns))]
    measured = staged(measure(docs.toDF(*places), places[docs.columns.index(text)]))
    return judge(measured).filter("kept").select(*places).toDF(*docs.columns)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(settle(measure(docs).drop("text"))).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        "kept",
        "quality",
    )
