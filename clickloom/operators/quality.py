"""Data-quality gates: checks that raise, and violation frames for reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class QualityError(ValueError):
    """A gate did not hold."""


def expect_row_count(df: DataFrame, expected: int | None = None) -> int:
    """The row count; raises when it differs from ``expected``, or is 0 if none is given."""
    found = df.count()
    if expected is None and found == 0:
        raise QualityError("expected at least one row, found none")
    if expected is not None and found != expected:
        raise QualityError(f"expected {expected} rows, found {found}")
    return found


def expect_nonempty(df: DataFrame, name: str = "result") -> None:
    if df.isEmpty():
        raise QualityError(f"{name} is missing or empty")


def expect_columns(df: DataFrame, columns: Sequence[str]) -> None:
    """Exactly these columns in this order."""
    if list(df.columns) != list(columns):
        raise QualityError(f"expected columns {list(columns)}, found {df.columns}")


def expect_column_subset(df: DataFrame, columns: Sequence[str]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise QualityError(f"missing columns {missing}")


def expect_artifacts(frames: Mapping[str, DataFrame]) -> None:
    for name, frame in frames.items():
        expect_nonempty(frame, name)


def expect_split_nonempty(counts: DataFrame) -> dict[str, int]:
    """Both parts of a train/test split hold rows. Takes the output of split_counts."""
    found = {row["split"]: row["row_count"] for row in counts.collect()}
    empty = sorted(name for name in ("train", "test") if not found.get(name))
    if empty:
        raise QualityError(f"empty split: {empty}")
    return found


def unique_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Value combinations that occur more than once, with their row count."""
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("row_count"))
    return counts.where(F.col("row_count") > 1)


def null_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls per column, one row each, from one pass."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot([], list(columns), "column_name", "null_count")


def reconcile(raw: DataFrame, clean: DataFrame, dlq: DataFrame) -> DataFrame:
    """Record counts of the three tables and whether none was lost or doubled."""

    def count_of(frame: DataFrame, name: str) -> DataFrame:
        return frame.agg(F.count(F.lit(1)).alias(name))

    counts = count_of(raw, "raw_records").withColumns(
        {
            "clean_records": count_of(clean, "n").scalar(),
            "dlq_records": count_of(dlq, "n").scalar(),
        }
    )
    total = F.col("clean_records") + F.col("dlq_records")
    return counts.withColumn("balanced", F.col("raw_records") == total)


def describe_table(df: DataFrame) -> DataFrame:
    """Column names, types and nullability."""
    rows = [
        (field.name, field.dataType.simpleString(), field.nullable) for field in df.schema.fields
    ]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, data_type string, nullable boolean"
    )
