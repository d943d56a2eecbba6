"""Sharding by jump consistent hashing.

A stable key and the number of shards decide a row's shard. There is no ring
table, and appending shards moves only the rows that the new shards take.

Defined results: a null key hashes as its own fixed key; repeated rows share a
shard and get different slots; an empty table gives no rows; other columns pass
through untouched unless they bear the names this operator adds, which it
replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._shared import blocks_for, dense_rank_ids, settle, table

#: Multiplier of the published jump hash's linear congruential step (fixed value).
JUMP_STEP = 2862933555777941757

#: Bytes that a row counts for besides its text.
ROW_OVERHEAD = 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of unsigned 64-bit keys, all keys at once."""
    state = keys.astype(np.uint64).copy()
    bucket = np.zeros(len(state), dtype=np.int64)
    jumped = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    with np.errstate(over="ignore"):
        while live.size:
            bucket[live] = jumped[live]
            state[live] = state[live] * np.uint64(JUMP_STEP) + np.uint64(1)
            span = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
            jumped[live] = ((bucket[live] + 1) * (float(1 << 31) / span)).astype(np.int64)
            live = live[jumped[live] < shards]
    return bucket.astype(np.int32)


def shard_of(key, shards: int):
    """Column: the shard of a 64-bit hash column among ``shards``."""

    @F.pandas_udf("int")
    def assign(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(jump(part.to_numpy(dtype=np.int64).view(np.uint64), shards))

    return assign(key)


def assign_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Adds ``shard`` and ``grown_shard`` (the shard once one more is appended)."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    hashed = F.xxhash64(F.lit("shard"), F.col(key))
    return df.withColumns({"shard": shard_of(hashed, shards), "grown_shard": shard_of(hashed, shards + 1)})


def with_slots(df: DataFrame, key: str, per_block: int = 200_000) -> DataFrame:
    """Adds ``slot``: places from 0 without a gap inside each shard.

    A shard is numbered in parts of about ``per_block`` rows, so that no task
    holds a whole shard.
    """
    total = df.select(F.count(F.lit(1))).head()[0]
    shards = df.select(F.max("shard")).head()[0]
    parts = blocks_for(total, per_block * max(1, (shards or 0) + 1))
    block = F.pmod(F.xxhash64(F.lit("slot"), F.col(key)), F.lit(parts))
    return dense_rank_ids(df, ["shard"], [F.col(key), *[F.col(c) for c in df.columns if c not in (key, "shard")]], block, "slot")


def write_shards(df: DataFrame, key: str, shards: int, path: str, slices: int = 8) -> None:
    """Writes whole rows into one folder per shard, each in ``slices`` files at most."""
    placed = assign_shards(df, key, shards)
    part = F.pmod(F.xxhash64(F.lit("slice"), F.col(key)), F.lit(slices))
    placed.repartition(shards * slices, "shard", part).write.partitionBy("shard").parquet(path)


def op5_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 40 shards by ``doc_id`` (law ``key``).

    Text is read once and reduced to its size and checksum; only those travel.
    """
    docs = table(spark, sf_dir, "documents")
    body = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    rows = assign_shards(
        docs.select(
            "doc_id",
            (F.octet_length(body).cast("long") + ROW_OVERHEAD).alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.lit("key").alias("law"),
        ),
        "doc_id",
        40,
    )
    return with_slots(settle(rows), "doc_id")
