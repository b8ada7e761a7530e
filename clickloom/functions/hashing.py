"""Seeded, engine-independent hashing, so a draw never depends on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(*parts: Column) -> Column:
    """Unsigned 32-bit hash of the parts joined by ``|``; nulls read as empty text."""
    texts = [F.coalesce(part.cast("string"), F.lit("")) for part in parts]
    digest = F.md5(F.concat_ws("|", *texts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_uniform(seed: str, *parts: Column) -> Column:
    """A draw in [0, 1) fixed by the seed and the row's parts."""
    return hash32(F.lit(seed), *parts) / F.lit(4294967296.0)


def hash_bucket(columns: Sequence[str], buckets: int) -> Column:
    return F.pmod(hash32(*[F.col(name) for name in columns]), F.lit(buckets))
