"""Reproducible shuffling into shards by a Feistel permutation of global row numbers.

Row r of N goes to position P(r), where P permutes 0 .. N-1; its shard is P(r) mod shards and its
slot P(r) div shards. So shard counts differ by one at most, slots have no gaps, and both
directions can be computed from (N, shards, seed) alone, without a table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import bound_batches
from clickloom.llm.numbering import numbered

SHARDS = 24
SEED = 20240229
ROUNDS = 6
_MASK = np.uint64(0xFFFFFFFF)


def _round_keys(seed: int) -> list[np.uint64]:
    return [np.uint64((seed * 0x9E3779B1 + k * 0x85EBCA6B + k * k) & 0xFFFFFFFF) for k in range(1, ROUNDS + 1)]


def _scramble(half: np.ndarray, key: np.uint64) -> np.ndarray:
    """A 32-bit function of half a row number and a round key."""
    x = ((half & _MASK) ^ (half >> np.uint64(32)) ^ key) & _MASK
    x = (x * np.uint64(0x85EBCA6B)) & _MASK
    x ^= x >> np.uint64(13)
    x = (x * np.uint64(0xC2B2AE35)) & _MASK
    return x ^ (x >> np.uint64(16))


def half_bits(n: int) -> int:
    """Bits of each half: the smallest even-width domain that holds n values (under 4 n of them)."""
    bits = 1
    while 1 << (2 * bits) < n:
        bits += 1
    return bits


def _once(x: np.ndarray, bits: int, keys: list[np.uint64]) -> np.ndarray:
    width, low = np.uint64(bits), np.uint64((1 << bits) - 1)
    left, right = x >> width, x & low
    for key in keys:
        left, right = right, left ^ (_scramble(right, key) & low)
    return (left << width) | right


def _back(x: np.ndarray, bits: int, keys: list[np.uint64]) -> np.ndarray:
    width, low = np.uint64(bits), np.uint64((1 << bits) - 1)
    left, right = x >> width, x & low
    for key in reversed(keys):
        left, right = right ^ (_scramble(left, key) & low), left
    return (left << width) | right


def _walk(step, rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Apply ``step`` until each value is below n again: the walk stays on the value's own cycle."""
    bits, keys = half_bits(n), _round_keys(seed)
    out = step(rows.astype(np.uint64), bits, keys)
    outside = np.flatnonzero(out >= n)
    while len(outside):
        out[outside] = step(out[outside], bits, keys)
        outside = outside[out[outside] >= n]
    return out.astype(np.int64)


def permuted(rows: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The position of each row number after the shuffle."""
    return _walk(_once, rows, n, seed)


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """The row number that a shard holds at a slot: the inverse, so readers can seek."""
    return _walk(_back, slot * shards + shard, n, seed)


def with_shards(df: DataFrame, key: list, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df`` with columns ``shard`` and ``slot`` (in place of columns of that name).

    Rows are numbered by a hash of ``key`` and permuted. Equal texts need no common shard here,
    so a hot group spreads like any other rows. Repeated rows are interchangeable; null keys are
    keys like others; an empty table gives an empty result.
    """
    bound_batches(df.sparkSession)
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    keyed = df.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_own"),  # no name can clash
        *(c.alias(f"_key{k}") for k, c in enumerate(key)),
    )
    rows = numbered(keyed, [], [F.col(f"_key{k}") for k in range(len(key))], "_row", "shard-offsets")
    n = max(1, df.count())

    @F.pandas_udf("long")
    def position(row: pd.Series) -> pd.Series:
        return pd.Series(permuted(row.to_numpy(), n, seed))

    return rows.withColumn("_at", position("_row")).select(
        *(F.col(f"_own.`{c}`") for c in kept),
        F.pmod("_at", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("_at") / F.lit(shards)).alias("slot"),
    )


def shard_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law (``rows``), shard, slot, grown_shard.

    A null text has no bytes (size 8, checksum 0). Repeated rows are rows of their own.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    small = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    dealt = with_shards(small, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], shards)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(df: DataFrame, path: str, key: list, shards: int = SHARDS, seed: int = SEED, parts: int = 8) -> None:
    """Write one folder per shard; each shard's files hold ascending ranges of slots.

    A shard is cut into ``parts`` slot ranges, so one task never writes a whole shard.
    """
    dealt = with_shards(df, key, shards, seed)
    span = F.ceil(F.lit(max(1, df.count())) / F.lit(shards * parts))
    (
        dealt.withColumn("_part", F.floor(F.col("slot") / span))
        .repartition("shard", "_part")
        .sortWithinPartitions("shard", "slot")
        .drop("_part")
        .write.partitionBy("shard")
        .parquet(path)
    )
