"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that the one
before it kept, and returns a DataFrame; all but the last return the columns of
``documents``:

1. quality rules: documents that weak supervision rejects go;
2. near-duplicates: one document of each class stays;
3. repeated passages: words of a 20-word window that starts earlier are cut out
   of the texts, and ``n_chars`` follows; a document may be left without words;
4. decontamination: documents in which a benchmark window occurs go;
5. packing: pieces of at most 4096 tokens with their sequence and offset.

Other columns pass through every stage but the last, whatever their names. No
stage can be said in SQL (estimated weights, sampling, tokenizers), so
``ORACLE_SQL`` is None and the stages are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm._shared import discard, stage, table
from millrace.llm.decontaminate import drop_contaminated
from millrace.llm.neardup import keep_one
from millrace.llm.packing import pack_documents
from millrace.llm.quality import filter_quality
from millrace.llm.substrings import cut_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. A null or wordless text is rejected; equal rows fare alike; no rows give none."""
    return filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts stays, that with the smallest id (a null id comes last). Rows without
    words all stay, of rows that are equal in id and text one does; no rows give none."""
    return keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated words go, the documents all stay. A null id comes first; a null text stays null; equal rows lose alike;
    no rows give none."""
    return cut_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go. A null or wordless text stays; equal rows fare alike; no rows give none."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places. A null or wordless text is its end id alone; equal rows are packed
    each; no rows give none."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, step in STAGES[:-1]:
        docs, path = stage(step(spark, docs, sf_dir))
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
