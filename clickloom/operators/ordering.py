"""Sequence operators over data whose order has to be cut into pieces.

A window over everything runs in one task. These operators cut the sort order into ranges,
work inside each range, and carry a small summary from range to range. The ranges are stored:
retried tasks and separate passes read the same range number with the row. A carry table has
one row per range and is broadcast for that reason.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.session import materialize

CHUNK = "_chunk"
CELL_BITS = 12  # a pass over a range counts rows in so many cells, as a power of two


def default_chunks(df: DataFrame) -> int:
    """Twice the shuffle partitions: the setting that is sized for the data sizes the ranges."""
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_chunks(df: DataFrame, order: Sequence[str], chunks: int | None = None) -> DataFrame:
    """``df`` stored in ranges of ``order``, with the range number."""
    ranged = df.repartitionByRange(chunks or default_chunks(df), *order)
    return materialize(ranged.withColumn(CHUNK, F.spark_partition_id()), "ranges")


def _within(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(CHUNK, *keys).orderBy(*order)


def _attach_carry(df: DataFrame, summary: DataFrame, keys: Sequence[str], carried: list[str]) -> DataFrame:
    """Join range summaries back. Only keys that cross a range boundary have a carry, and a
    boundary is crossed by at most one key."""
    carry = summary.where(F.col(carried[0]).isNotNull()).select(CHUNK, *keys, *carried)
    return df.join(F.broadcast(carry), [CHUNK, *keys], "left")


_COMBINE = {
    "sum": lambda value: F.sum(value),
    "min": lambda value: F.min(value),
    "max": lambda value: F.max(value),
}


def running_in_order(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    outputs: Mapping[str, tuple[str, str]],
) -> DataFrame:
    """Running sum, min or max up to and including each row, within ``keys``.

    ``outputs`` maps a new column to ``(operation, column)``; ``df`` already has chunks.
    """
    summaries = df.groupBy(CHUNK, *keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[_COMBINE[op](F.col(column)).alias(f"_s_{out}") for out, (op, column) in outputs.items()],
    )
    earlier = (
        Window.partitionBy(*keys)
        .orderBy(CHUNK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    summaries = summaries.select(
        CHUNK,
        *keys,
        F.sum("_rows").over(earlier).alias("_c_rows"),
        *[
            _COMBINE[op](F.col(f"_s_{out}")).over(earlier).alias(f"_c_{out}")
            for out, (op, _) in outputs.items()
        ],
    )
    carried = ["_c_rows"] + [f"_c_{out}" for out in outputs]
    joined = _attach_carry(df, summaries, keys, carried)
    within = _within(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged: dict[str, Column] = {}
    for out, (op, column) in outputs.items():
        inside = _COMBINE[op](F.col(column)).over(within)
        carry = F.col(f"_c_{out}")
        if op == "sum":
            both = F.coalesce(inside + carry, inside, carry)
        elif op == "min":
            both = F.least(inside, carry)
        else:
            both = F.greatest(inside, carry)
        merged[out] = both
    return joined.withColumns(merged).drop(*carried)


def value_at_rank(df: DataFrame, column: str, rank: int) -> tuple[int, int]:
    """The value of a whole-number column at a zero-based rank, and how many values are smaller.

    Bisection by many parts: each pass counts the rows of the range that is left in some thousand
    cells and goes on with the cell that holds the rank. Ranges are pushed into the scan, where
    file statistics skip what lies outside.
    """
    low, high = df.agg(F.min(column), F.max(column)).first()
    before = 0
    while low < high:
        shift = max(0, (high - low).bit_length() - CELL_BITS)
        inside = df.where(F.col(column).between(low, high))
        cells = inside.groupBy(F.shiftright(F.col(column).cast("long"), shift).alias("cell")).count().collect()
        for cell, n in sorted((row[0], row[1]) for row in cells):
            if before + n > rank:
                break
            before += n
        low, high = max(low, cell << shift), min(high, (cell + 1 << shift) - 1)
    return low, before


def _row_at(df: DataFrame, order: Sequence[str], rank: int) -> list[int]:
    """The order columns of the row at a rank."""
    values = []
    for column in order:
        value, before = value_at_rank(df, column, rank)
        values.append(value)
        rank -= before
        df = df.where(F.col(column) == value)
    return values


def _beside(order: Sequence[str], values: Sequence[int], after: bool) -> Column:
    """Rows at or after (or at or before) a row in sort order; the first column's bound can be pushed down."""
    def at_least(column: str, value: int) -> Column:
        return F.col(column) >= value if after else F.col(column) <= value

    test = at_least(order[-1], values[-1])
    for column, value in zip(reversed(order[:-1]), reversed(values[:-1]), strict=True):
        one = F.col(column)
        test = at_least(column, value) & ((one != value) | test)
    return test


def row_slice(df: DataFrame, order: Sequence[str], start: int = 0, rows: int | None = None) -> DataFrame:
    """Rows ``start`` up to ``start + rows`` in sort order.

    ``order`` names whole-number columns without nulls that identify a row. The rows at both ends are found
    by counting; what comes back is a plain range filter over ``df``, without sort or copy.
    """
    n = df.count()
    stop = n if rows is None else min(n, start + rows)
    if start >= stop:
        return df.where(F.lit(False))
    inside = df
    if start > 0:
        inside = inside.where(_beside(order, _row_at(df, order, start), after=True))
    if stop < n:
        inside = inside.where(_beside(order, _row_at(df, order, stop - 1), after=False))
    return inside


def row_positions(df: DataFrame, order: Sequence[str], out: str, chunks: int | None = None) -> DataFrame:
    """Zero-based position of every row in sort order; ``order`` must identify a row."""
    chunked = with_chunks(df, order, chunks).withColumn("_one", F.lit(1).cast("bigint"))
    counted = running_in_order(chunked, [], order, {out: ("sum", "_one")})
    return counted.withColumn(out, F.col(out) - 1).drop(CHUNK, "_one")
