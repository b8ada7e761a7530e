"""Dashboard queries over the score, metric and evaluation tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.schema import SCORE_BUCKET_LABELS

TOP_SESSIONS = 25
MIN_SESSIONS = 100
AVERAGED_BUCKETS = 12
STRETCH = 4096  # buckets that one task lays out and averages


def latest_bot_rate(metrics: DataFrame) -> DataFrame:
    """Newest window's bot rate, 0.0 without windows."""
    newest = F.max_by("bot_rate", "window_end")
    return metrics.agg(F.coalesce(newest, F.lit(0.0)).alias("bot_rate"))


def active_sessions(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("session_status") == "active").agg(
        F.count(F.lit(1)).alias("active_sessions")
    )


def max_score(scores: DataFrame) -> DataFrame:
    return scores.agg(F.coalesce(F.max("bot_score"), F.lit(0.0)).alias("max_bot_score"))


def _bucket_start(time: Column, minutes: int) -> Column:
    return F.window(time, f"{minutes} minutes")["start"]


def bot_rate_series(
    metrics: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    minutes: int = 5,
    min_sessions: int = MIN_SESSIONS,
) -> DataFrame:
    """Bot rate per bucket over an unbroken time range.

    Buckets without data read 0.0, buckets with too few sessions are null. The spine has one
    row per bucket of the shown range; without a range it spans the data.
    """
    ends = metrics.select(F.col("window_end").cast("timestamp").alias("window_end"))
    low = F.lit(start).cast("timestamp") if start else F.min("window_end")
    high = F.lit(end).cast("timestamp") if end else F.max("window_end")
    bounds = ends.agg(low.alias("low"), high.alias("high")) if not (start and end) else (
        metrics.sparkSession.range(1).select(low.alias("low"), high.alias("high"))
    )
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    floor = bounds.select(
        _bucket_start(F.col("low"), minutes).alias("low"), F.col("high")
    ).where(F.col("low").isNotNull())
    stretch = F.expr(f"INTERVAL {minutes * STRETCH} MINUTES")  # a long range is laid out by many rows
    starts = floor.select("high", F.explode(F.sequence("low", "high", stretch)).alias("from"))
    upto = F.least("high", F.col("from") + F.expr(f"INTERVAL {minutes * (STRETCH - 1)} MINUTES"))
    spine = starts.select(F.explode(F.sequence("from", upto, step)).alias("time"))

    shown = metrics.withColumn("window_end", F.col("window_end").cast("timestamp"))
    if start:
        shown = shown.where(F.col("window_end") >= F.lit(start).cast("timestamp"))
    if end:
        shown = shown.where(F.col("window_end") <= F.lit(end).cast("timestamp"))
    counted = shown.groupBy(_bucket_start(F.col("window_end"), minutes).alias("time")).agg(
        F.sum("active_sessions").alias("sessions"), F.sum("bot_sessions").alias("bots")
    )
    rate = F.when(F.col("sessions").isNull(), F.lit(0.0)).when(
        F.col("sessions") >= min_sessions, F.col("bots").cast("double") / F.col("sessions")
    )
    return spine.join(counted, "time", "left").select("time", rate.alias("bot_rate"))


def bot_rate_moving_average(series: DataFrame, buckets: int = AVERAGED_BUCKETS, minutes: int = 5) -> DataFrame:
    """Mean of up to the last ``buckets`` non-null rates of an unbroken series.

    The series is cut into stretches of time. Each also receives a halo, the last ``buckets`` - 1
    rows of the stretch before it, so every window lies in one stretch.
    """
    position = F.floor(F.unix_seconds(F.col("time").cast("timestamp")) / (60 * minutes))
    rows = series.select("time", "bot_rate", position.alias("_at"))
    own = F.floor(F.col("_at") / STRETCH)
    after = F.floor((F.col("_at") + (buckets - 1)) / STRETCH)
    spread = rows.withColumn("_stretch", F.explode(F.sequence(own, after)))
    recent = Window.partitionBy("_stretch").orderBy("_at").rowsBetween(-(buckets - 1), 0)
    averaged = spread.withColumn("bot_rate_moving_avg", F.avg("bot_rate").over(recent))
    return averaged.where(F.col("_stretch") == own).select("time", "bot_rate_moving_avg")


def top_sessions(scores: DataFrame, rows: int = TOP_SESSIONS) -> DataFrame:
    """Highest scores first, then the most recently updated."""
    ranked = scores.orderBy(F.desc("bot_score"), F.desc("updated_at"), "user_session").limit(rows)
    return ranked.select(
        "user_session",
        "session_status",
        "event_count",
        "interval_count",
        F.round("bot_score", 3).alias("bot_score"),
        "is_bot",
        "last_event_time",
        "closed_at",
        "updated_at",
    )


def latest_histogram(metrics: DataFrame) -> DataFrame:
    """The newest window's histogram text as five rows; unreadable or absent counts are 0."""
    newest = metrics.agg(F.max_by("score_histogram", "window_end").alias("text"))
    pairs = newest.where(F.col("text").isNotNull()).select(
        F.str_to_map("text", F.lit(","), F.lit("=")).alias("pairs")
    )
    labels = F.explode(F.array(*[F.lit(label) for label in SCORE_BUCKET_LABELS]))
    rows = pairs.select("pairs", labels.alias("bucket"))
    count = F.coalesce(F.col("pairs")[F.col("bucket")].try_cast("int"), F.lit(0))
    return rows.select("bucket", count.alias("sessions"))


def confusion_heatmap(matrix: DataFrame) -> DataFrame:
    totals = matrix.groupBy("predicted", "actual").agg(F.sum("count").alias("observations"))
    return totals.orderBy("predicted", "actual")


def importance_bar(importance: DataFrame) -> DataFrame:
    highest = importance.groupBy("feature").agg(F.max("importance").alias("importance"))
    return highest.orderBy("importance", "feature")


def roc_line(curve: DataFrame) -> DataFrame:
    highest = curve.groupBy("fpr").agg(F.max("tpr").alias("true_positive_rate"))
    return highest.orderBy("fpr")


def model_table(comparison: DataFrame) -> DataFrame:
    return comparison.select(
        "model", "accuracy", "balanced_accuracy", "true_class_f1", "roc_auc", "pr_auc"
    )
