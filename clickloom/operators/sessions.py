"""Staging and session-level features."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.hashing import hash_bucket
from clickloom.operators.dictionary import ordered_numbers, with_numbers, with_strings
from clickloom.schema import (
    CATEGORY_COLUMNS,
    EVENT_COLUMNS,
    FEATURE_COLUMNS,
    PRODUCER_NAMES,
    SUPPORTED_EVENT_TYPES,
    UNKNOWN_PRODUCER,
)

SPLIT_BUCKETS = 5


def staging_events(df: DataFrame) -> DataFrame:
    """The nine event columns; unknown categories and brands labelled, no keyless events."""
    known = {c: F.coalesce(F.col(c), F.lit("unknown")) for c in ("category_code", "brand")}
    kept = df.where(F.col("user_session").isNotNull())
    return kept.select(*[known[c].alias(c) if c in known else F.col(c) for c in EVENT_COLUMNS])


def on_day(df: DataFrame, day: date | str, ts: str = "event_time") -> DataFrame:
    """Events of one UTC day, as a range on the raw column so that file statistics prune."""
    first = datetime.fromisoformat(str(day))
    kind = df.schema[ts].dataType.simpleString()

    def bound(value: datetime) -> Column:
        return F.lit(value.isoformat(sep=" ")).cast(kind)

    return df.where((F.col(ts) >= bound(first)) & (F.col(ts) < bound(first + timedelta(days=1))))


def distinct_sessions_by_type(df: DataFrame, day: date | str | None = None) -> DataFrame:
    """Distinct sessions per event type, optionally for one day.

    The usual event types become bits of one number per session, so a single aggregate by
    session serves them all and moves far less than distinct (type, session) pairs would.
    Sessions with other types add a row per such type to the same aggregate.
    """
    rows = df if day is None else on_day(df, day)
    kind = F.col("event_type")
    usual = F.coalesce(kind.isin(SUPPORTED_EVENT_TYPES), F.lit(False))
    bit = F.lit(0)
    for place, name in enumerate(SUPPORTED_EVENT_TYPES):
        bit = F.when(kind == name, F.lit(1 << place)).otherwise(bit)
    seen = rows.groupBy(
        "user_session", usual.alias("usual"), F.when(~usual, kind).alias("other")
    ).agg(F.bit_or(bit).alias("bits"))

    def entry(name: Column, has: Column) -> Column:
        return F.struct(
            name.alias("event_type"),
            F.count_if(has & F.col("user_session").isNotNull()).alias("session_count"),
            F.bool_or(has).alias("occurs"),
        )

    entries = [
        entry(F.lit(name), F.col("bits").bitwiseAND(F.lit(1 << place)) != 0)
        for place, name in enumerate(SUPPORTED_EVENT_TYPES)
    ]
    entries.append(entry(F.col("other"), ~F.col("usual")))
    counts = seen.groupBy("usual", "other").agg(F.array(*entries).alias("entries"))
    return counts.select(F.inline("entries")).where("occurs").drop("occurs")


def routing_label(event_type: Column) -> Column:
    label = F.lit(UNKNOWN_PRODUCER)
    for kind, name in PRODUCER_NAMES.items():
        label = F.when(event_type == kind, F.lit(name)).otherwise(label)
    return label


def session_features(events: DataFrame) -> DataFrame:
    """One row per session. Partial aggregates run before the only shuffle of events, so a session
    of any size arrives as one row per task.

    Brands and categories take part as order-preserving numbers: minima of fixed width stay in
    hash aggregates, where minima of strings would have all events sorted.
    """
    kind, time = F.col("event_type"), F.col("event_time")
    strings = ["brand", "category_code"]
    numbers = ordered_numbers(events, strings)
    events = with_numbers(events, numbers, strings)

    def count_of(name: str) -> Column:
        return F.count_if(kind == name)

    def first_of(name: str) -> Column:
        return F.min(F.when(kind == name, time))

    sessions = events.groupBy("user_session").agg(
        F.min("user_id").alias("user_id"),
        F.min("brand").alias("brand"),
        F.min("category_code").alias("category_code"),
        F.count(F.lit(1)).alias("total_activity_count"),
        count_of("view").alias("view_count"),
        count_of("cart").alias("cart_add_count"),
        count_of("purchase").alias("purchase_count"),
        F.min(time).alias("session_start_time"),
        F.max(time).alias("session_end_time"),
        first_of("view").alias("first_view_time"),
        first_of("cart").alias("first_cart_time"),
    )

    def seconds(column: str) -> Column:
        return F.unix_timestamp(F.col(column).cast("timestamp"))

    start = F.col("session_start_time")
    return with_strings(sessions, numbers, strings).select(
        "user_session",
        "user_id",
        "brand",
        "category_code",
        "total_activity_count",
        "view_count",
        "cart_add_count",
        "purchase_count",
        (F.col("purchase_count") > 0).cast("int").alias("converted"),
        "session_start_time",
        "session_end_time",
        (seconds("session_end_time") - seconds("session_start_time")).alias(
            "session_duration_seconds"
        ),
        (F.dayofweek(start) - 1).alias("day_of_week"),
        F.hour(start).alias("hour_of_day"),
        "first_view_time",
        "first_cart_time",
        (seconds("first_cart_time") - seconds("first_view_time")).alias("seconds_to_first_cart"),
    )


def activity_percentile(sessions: DataFrame, fraction: float = 0.999) -> DataFrame:
    """One-row percentile of events per session.

    Sessions are first counted by size. With N events there are at most sqrt(2 N) different
    sizes, so the exact aggregate over them stays small at any scale.
    """
    sizes = sessions.groupBy("total_activity_count").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.percentile("total_activity_count", fraction, F.col("n")).alias("maximum_activity_count")
    )


def with_activity_threshold(sessions: DataFrame, fraction: float = 0.999) -> DataFrame:
    """Every session next to the one-value activity percentile."""
    threshold = activity_percentile(sessions, fraction)
    return sessions.withColumn("maximum_activity_count", threshold.scalar())


def activity_outlier_filter(sessions: DataFrame, fraction: float = 0.999) -> DataFrame:
    """Sessions at or below the activity percentile. ``sessions`` is read twice: store it."""
    threshold = activity_percentile(sessions, fraction)
    return sessions.where(F.col("total_activity_count") <= threshold.scalar())


def feature_frame(sessions: DataFrame, views_only: bool = True) -> DataFrame:
    """Model features and target; by default only sessions that viewed something."""
    rows = sessions.where(F.col("view_count") > 0) if views_only else sessions
    return rows.select(*FEATURE_COLUMNS, "converted")


def share_of_total(counts: DataFrame, count: str, out: str) -> DataFrame:
    """Each row's part of the column total. For aggregated frames of few rows."""
    total = F.sum(count).over(Window.partitionBy())
    return counts.withColumn(out, F.col(count).cast("double") / total)


def target_distribution(features: DataFrame) -> DataFrame:
    counts = features.groupBy("converted").agg(F.count(F.lit(1)).alias("session_count"))
    return share_of_total(counts, "session_count", "proportion")


def split_bucket(columns: Sequence[str] = (*FEATURE_COLUMNS, "converted")) -> Column:
    """0..4, fixed by the row's values; bucket 0 is the test set."""
    return hash_bucket(columns, SPLIT_BUCKETS)


def train_test_split(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    bucketed = features.withColumn("_split", split_bucket())
    train = bucketed.where(F.col("_split") != 0).drop("_split")
    return train, bucketed.where(F.col("_split") == 0).drop("_split")


def split_counts(features: DataFrame) -> DataFrame:
    """Rows in each part, from one pass; an empty part shows as 0."""
    counted = features.select(split_bucket().alias("b")).agg(
        F.count_if(F.col("b") != 0).alias("train"), F.count_if(F.col("b") == 0).alias("test")
    )
    return counted.unpivot([], ["train", "test"], "split", "row_count")


def category_vocabulary(features: DataFrame, columns: Sequence[str] = CATEGORY_COLUMNS) -> DataFrame:
    """Distinct known values of each categorical column, sorted."""
    long = features.select(*columns).unpivot([], list(columns), "column_name", "category")
    return long.where(F.col("category").isNotNull()).distinct().orderBy("column_name", "category")


def union_all_counts(frames: dict[str, DataFrame], label: str = "name") -> DataFrame:
    """Labelled row counts of several frames."""
    parts = [
        frame.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias(label), "row_count")
        for name, frame in frames.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def min_max_summary(df: DataFrame, column: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(column).alias("min_value"),
        F.max(column).alias("max_value"),
    )


def session_drilldown(events: DataFrame, session: str) -> DataFrame:
    """One session's events with the time since the one before. The session filter reaches
    the scan; the window only ever sees that session."""
    rows = events.where(F.col("user_session") == session)
    ms = F.unix_millis(F.col("event_time").cast("timestamp"))
    by_time = Window.partitionBy("user_session").orderBy("event_time")
    return rows.select(
        "user_session", "event_time", "event_type", "brand", (ms - F.lag(ms).over(by_time)).alias("interval_ms")
    )
