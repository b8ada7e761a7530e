"""Helpers shared by the operators: bounded Arrow batches, groups of sorted rows, stored results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.session import fresh_path, materialize

__all__ = [
    "Scratch", "bitmap_of", "bound_batches", "by_group", "fresh_path", "materialize", "maybe_column", "maybe_in", "pick",
    "read_table", "split_join", "where_maybe",
]

BATCH_BYTES = 2 << 20
BITMAP_BITS = 1 << 26  # 8 MB, whatever the input
_PAGE = 32_768  # bits of one built-in bitmap


class Scratch:
    """Stored intermediates of one job that are deleted after their last reader.

    Drop a table only once everything computed from it is stored itself: lost tasks of later
    passes then never need it again.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def store(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` to the shared folder and read it back."""
        path = self.paths[label] = fresh_path(self.spark, label)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        """Delete the named tables."""
        jvm = self.spark._jvm
        for label in labels:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(label))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """Cut the batches sent to Python by bytes as well as by rows, so long texts stay bounded.

    Only the size of the batches changes, never a result.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the shared tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under the operator's own names; other columns cannot clash."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def by_group(
    work: Callable[[pa.Table], pa.RecordBatch | None], keys: list[str]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over rows sorted by ``keys``: call ``work`` with each run of equal keys.

    Holds the rows of one group (and one batch) at a time. The caller bounds the groups.
    """

    def cut(batch: pa.RecordBatch) -> list[int]:
        table = batch.select(keys).to_pydict()
        rows = list(zip(*table.values(), strict=True))
        return [0, *(i for i in range(1, len(rows)) if rows[i] != rows[i - 1]), len(rows)]

    def key_of(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch.column(k)[row].as_py() for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            edges = cut(batch)
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(lo, hi - lo)
                if held and (lo > 0 or key_of(held[0], 0) != key_of(part, 0)):
                    out = work(pa.Table.from_batches(held))
                    held = []
                    if out is not None and out.num_rows:
                        yield out
                held.append(part)
        if held:
            out = work(pa.Table.from_batches(held))
            if out is not None and out.num_rows:
                yield out

    return run


def split_join(big: DataFrame, small: DataFrame, on: list[str], how: str, label: str) -> DataFrame:
    """Join ``big`` with a side that has one row per key, where a key may hold much of ``big``.

    The small side is stored first. Both sides then enter the join straight from an exchange,
    so adaptive execution can cut an oversized key of ``big`` into several tasks (or broadcast a
    side whose stored size it has measured).
    """
    return big.join(materialize(small, label), on, how)


def bitmap_of(df: DataFrame, column: str):
    """A broadcast bitmap of the values of a long column, modulo its fixed number of bits.

    It lets a pass drop rows that cannot meet ``df`` before they are shuffled. Values that share
    a bit pass too, so an exact join follows (or the extra rows must do no harm); with very many
    values it passes everything and only saves nothing.
    """
    bit = F.pmod(F.col(column), F.lit(BITMAP_BITS))
    pages = (
        df.where(F.col(column).isNotNull())
        .select(F.expr(f"{_pmod(column)} div {_PAGE}").alias("page"), (bit % _PAGE).alias("bit"))
        .groupBy("page")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()
    )
    whole = np.zeros((BITMAP_BITS // _PAGE, _PAGE // 8), np.uint8)
    for row in pages:
        whole[row.page] = np.frombuffer(row.bits, np.uint8)
    return df.sparkSession.sparkContext.broadcast(whole.reshape(-1))


def _pmod(column: str) -> str:
    return f"pmod(`{column}`, {BITMAP_BITS})"


def maybe_in(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value's bit is set; no value that went in is missed."""
    at = np.mod(values, BITMAP_BITS)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def where_maybe(df: DataFrame, column: str, bitmap, wanted: bool = True) -> DataFrame:
    """Rows whose value may be in the bitmap, or (``wanted`` false) those whose value is not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = batch.column(column).to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(maybe_in(bitmap.value, values) == wanted))

    return df.mapInArrow(run, df.schema)


def maybe_column(column, bitmap):
    """As ``where_maybe``, as a condition: only this column goes to Python, whole rows stay behind."""

    @F.pandas_udf("boolean")
    def found(values: pd.Series) -> pd.Series:
        return pd.Series(maybe_in(bitmap.value, values.to_numpy(np.int64)))

    return found(column)


def store_of(path: str):
    """The pyarrow file system of a shared path and the path within it, for files of own formats."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def row_keys(*columns: str) -> list:
    """Two 64-bit hashes that stand for a row in joins of narrow tables; equal rows share them."""
    own = [F.col(f"`{c}`") for c in columns]
    absent = [c.isNull() for c in own]
    return [
        F.xxhash64(*own, *absent).alias("row_a"),
        F.xxhash64(F.lit(7), *own[::-1], *absent).alias("row_b"),
    ]
