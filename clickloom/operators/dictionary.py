"""Distinct strings as order-preserving numbers, so aggregates compare numbers instead of strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.session import materialize

NUMBER = "_number"
STRING = "_string"


def ordered_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The stored dictionary of all values of some string columns: a larger string, a larger number.

    Numbers follow the ranges of the strings' order and the place in a range; they have gaps and
    need no task that sees all strings. Nulls have no entry.
    """
    values = df.select(F.explode(F.array(*[F.col(c) for c in columns])).alias(STRING))
    distinct = values.where(F.col(STRING).isNotNull()).distinct()
    ordered = distinct.repartitionByRange(STRING).sortWithinPartitions(STRING)
    return materialize(ordered.withColumn(NUMBER, F.monotonically_increasing_id()), "dictionary")


def _swapped(df: DataFrame, numbers: DataFrame, columns: Sequence[str], old: str, new: str) -> DataFrame:
    names = df.columns
    for column in columns:
        entries = numbers.select(F.col(old).alias(column), F.col(new).alias("_new"))
        joined = df.join(entries, column, "left")
        df = joined.select(*[F.col("_new").alias(c) if c == column else F.col(c) for c in names])
    return df


def with_numbers(df: DataFrame, numbers: DataFrame, columns: Sequence[str]) -> DataFrame:
    """String columns replaced by their numbers. The planner broadcasts a dictionary whose stored
    files are small and shuffles otherwise."""
    return _swapped(df, numbers, columns, STRING, NUMBER)


def with_strings(df: DataFrame, numbers: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The inverse of ``with_numbers``."""
    return _swapped(df, numbers, columns, NUMBER, STRING)
