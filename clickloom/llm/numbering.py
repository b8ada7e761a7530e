"""Gapless row numbers without a global sort and without a group in one task."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import materialize

CHUNK_ROWS = 4096


def numbered(df: DataFrame, group: list[str], key: list[Column], name: str, label: str) -> DataFrame:
    """``df`` with column ``name``: 0, 1, 2 ... within each value of the ``group`` columns.

    Rows are ordered by a hash of ``key``. A row's chunk is a fixed function of the row, so a
    retried task and a second pass agree; a first pass counts rows per chunk (aggregated before
    its shuffle), the second numbers rows within chunks of about ``CHUNK_ROWS`` rows and adds the
    chunk's offset. Rows that agree in the whole key are interchangeable. Group values must not
    be null.
    """
    chunks = max(1, ceil(df.count() / CHUNK_ROWS))
    keyed = df.withColumns({"_h": F.xxhash64(*key)}).withColumn("_chunk", F.pmod("_h", F.lit(chunks)))
    sizes = keyed.groupBy(*group, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        sizes.select(*group, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")),
        label,
    )
    inside = Window.partitionBy(*group, "_chunk").orderBy("_h", *key)
    return (
        keyed.join(offsets, [*group, "_chunk"])
        .withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_h", "_chunk", "_offset")
    )
