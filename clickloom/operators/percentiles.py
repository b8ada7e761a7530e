"""Exact continuous percentiles by radix selection: no sort and no gathering of a column."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.session import materialize

MANTISSA_BITS = 51
FIRST_BITS = 6  # leading mantissa bits of the first cells, beside the exponent
STEP_BITS = 10  # bits by which a pass refines a cell
SMALL = 1 << 16  # values left in all open cells that are counted one by one
LOWEST_EXPONENT = 1075
NAN_KEY = (1 << 63) - 1


def ordered_long(value: Column) -> Column:
    """A whole number that never falls while ``value`` grows: exponent, then leading mantissa bits.

    Values that differ in their last bit may share a number, and values just below a power of two
    may share that power's. NaN comes last, as in Spark's order.
    """
    plain = F.abs(value)
    finite = (plain > 0) & (plain < F.lit(float("inf")))
    size = F.when(finite, plain).otherwise(F.lit(1.0))
    exponent = F.floor(F.log2(size))
    fraction = F.greatest(size / F.pow(F.lit(2.0), exponent.cast("double")) - 1, F.lit(0.0))
    whole = F.lit(1 << MANTISSA_BITS)
    key = (exponent + LOWEST_EXPONENT) * whole + F.floor(fraction * F.lit(float(1 << MANTISSA_BITS)))
    key = F.when(plain == 0, F.lit(0)).when(finite, key).otherwise(F.lit(NAN_KEY - 1))
    return F.when(F.isnan(value), F.lit(NAN_KEY)).when(value < 0, -key).otherwise(key).cast("bigint")


class _Cell:
    """Values that agree in the leading bits: how many there are, how many lie before, their extremes."""

    __slots__ = ("before", "high", "key", "low", "n", "ranks", "statistic")

    def __init__(self, statistic, key, n, low, high):
        self.statistic, self.key, self.n, self.low, self.high = statistic, key, n, low, high
        self.before, self.ranks = 0, []


def _deal(cells: list[_Cell], before: int, ranks: list[int]) -> list[_Cell]:
    """Place sorted cells after ``before`` values and keep those that hold a wanted rank."""
    held, at = [], 0
    for cell in cells:
        cell.before = before
        before += cell.n
        first = at
        while at < len(ranks) and ranks[at] < before:
            at += 1
        if at > first:
            cell.ranks = ranks[first:at]
            held.append(cell)
    return held


def _settle(cells: list[_Cell], found: dict) -> list[_Cell]:
    """Read off the ranks whose value is known; the other cells stay open."""
    opened = []
    for cell in cells:
        ends = {cell.before: cell.low, cell.before + cell.n - 1: cell.high}
        if cell.low == cell.high or math.isnan(cell.low):
            ends |= dict.fromkeys(cell.ranks, cell.low)
        found.update({(cell.statistic, rank): ends[rank] for rank in cell.ranks if rank in ends})
        cell.ranks = [rank for rank in cell.ranks if rank not in ends]
        if cell.ranks:
            opened.append(cell)
    return opened


def _inside(cells: list[_Cell], shift: int) -> Column:
    """Whether a value lies in one of the cells."""
    by_name: dict[str, list[int]] = {}
    for cell in cells:
        by_name.setdefault(cell.statistic, []).append(cell.key)
    at = F.shiftright("key", shift)
    tests = [(F.col("statistic") == name) & at.isin(keys) for name, keys in by_name.items()]
    test = tests[0]
    for other in tests[1:]:
        test = test | other
    return test


def _counted(values: DataFrame, *keys: Column) -> list:
    return values.groupBy("statistic", *keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    ).collect()


def _refined(values: DataFrame, cells: list[_Cell], shift: int, finer: int, found: dict) -> list[_Cell]:
    """Open cells cut by the next bits (or, at the last step, by value), with their ranks."""
    exact = finer < 0
    last = F.col("value") if exact else F.shiftright("key", finer)
    inside = values.where(_inside(cells, shift))
    parts: dict[tuple, list[_Cell]] = {}
    for row in _counted(inside, F.shiftright("key", shift).alias("cell"), last.alias("part")):
        own = _Cell(row["statistic"], row["part"], row["n"], row["low"], row["high"])
        parts.setdefault((row["statistic"], row["cell"]), []).append(own)
    opened = []
    for cell in cells:
        own = sorted(parts[cell.statistic, cell.key], key=lambda c: (math.isnan(c.low), c.low))
        opened += _settle(_deal(own, cell.before, cell.ranks), found)
    return opened


def select_ranks(df: DataFrame, columns: Sequence[str], wanted) -> dict[str, tuple[int, dict[int, float]]]:
    """Per column: how many values it has, and the values at the ranks that ``wanted(count)`` asks for.

    A first aggregate counts values by exponent and leading bits, folded before the shuffle. Each
    later one cuts only the cells that hold a wanted rank, by ten more bits; a cell whose values
    are all equal is done. Few values left are counted one by one. What reaches the driver is bounded by the
    number of cells (of ranks times 1,024 in a later pass), whatever the number of values.
    """
    wide = materialize(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), "values")
    values = wide.unpivot([], list(columns), "statistic", "value").where(F.col("value").isNotNull())
    values = values.withColumn("key", ordered_long(F.col("value")))
    shift = MANTISSA_BITS - FIRST_BITS
    cells: dict[str, list[_Cell]] = {name: [] for name in columns}
    for row in _counted(values, F.shiftright("key", shift).alias("part")):
        cells[row["statistic"]].append(_Cell(row["statistic"], row["part"], row["n"], row["low"], row["high"]))
    found: dict[tuple[str, int], float] = {}
    counts, opened = {}, []
    for name, own in cells.items():
        own.sort(key=lambda c: c.key)
        counts[name] = sum(c.n for c in own)
        opened += _settle(_deal(own, 0, sorted(wanted(counts[name]))), found)
    while opened:
        finer = -1 if shift == 0 or sum(c.n for c in opened) <= SMALL else max(0, shift - STEP_BITS)
        opened = _refined(values, opened, shift, finer, found)
        shift = finer
    return {name: (n, {rank: v for (own, rank), v in found.items() if own == name}) for name, n in counts.items()}


def exact_percentiles(df: DataFrame, columns: Sequence[str], fractions: Sequence[float]) -> DataFrame:
    """One row per column: ``(statistic, percentiles array<double>)``, nulls ignored.

    Between two ranks the value is interpolated. A column without values has no percentiles.
    """

    def places(n: int) -> list[tuple[int, int, float]]:
        exact = [(n - 1) * fraction for fraction in fractions]
        return [(math.floor(e), math.ceil(e), e - math.floor(e)) for e in exact]

    def wanted(n: int) -> set[int]:
        return {rank for low, high, _ in places(n) for rank in (low, high)} if n else set()

    selected = select_ranks(df, columns, wanted)
    rows = []
    for name in columns:
        n, at = selected[name]
        found = [at[low] * (1 - part) + at[high] * part for low, high, part in places(n)] if n else None
        rows.append((name, found))
    return df.sparkSession.createDataFrame(rows, "statistic string, percentiles array<double>")
