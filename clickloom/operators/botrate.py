"""Tumbling-window bot metrics over scored-session updates, for batch and streaming frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.scoring import histogram_text, is_bot, score_bucket
from clickloom.schema import BOT_SCORE_THRESHOLD, SCORE_BUCKET_LABELS


def status_filter(updates: DataFrame, status: str) -> DataFrame:
    return updates.where(F.col("session_status") == status)


def latest_per_window(
    updates: DataFrame,
    size: str,
    key: str = "user_session",
    ts: str = "last_event_time",
    order_cols: Sequence[str] = ("last_event_time", "event_count"),
) -> DataFrame:
    """Each key's newest row in every tumbling window, with the window's bounds."""
    rows = F.struct(*[c for c in updates.columns if c != key])
    order = F.struct(*order_cols) if len(order_cols) > 1 else F.col(order_cols[0])
    latest = updates.groupBy(F.window(ts, size).alias("w"), key).agg(
        F.max_by(rows, order).alias("r")
    )
    return latest.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "r.*"
    )


def bot_rate_accumulator(groups, threshold: float = BOT_SCORE_THRESHOLD) -> DataFrame:
    """Mergeable counts and sums of ``bot_score`` over grouped rows."""
    score = F.col("bot_score")
    buckets = [
        F.count_if(score_bucket(score) == i).alias(f"bucket_{i}")
        for i in range(len(SCORE_BUCKET_LABELS))
    ]
    return groups.agg(
        F.count(F.lit(1)).alias("active_sessions"),
        F.count_if(is_bot(score, threshold)).alias("bot_sessions"),
        F.sum(score).alias("score_sum"),
        *buckets,
    )


def bot_rate_result(accumulated: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Rate, average and histogram text; 0.0 where nothing was counted."""
    sessions = F.col("active_sessions")
    counts = [F.col(f"bucket_{i}") for i in range(len(SCORE_BUCKET_LABELS))]

    def share(total):
        return F.when(sessions == 0, F.lit(0.0)).otherwise(total / sessions)

    return accumulated.select(
        *keep,
        "active_sessions",
        "bot_sessions",
        share(F.col("bot_sessions")).alias("bot_rate"),
        share(F.col("score_sum")).alias("avg_bot_score"),
        histogram_text(counts).alias("score_histogram"),
    )


def bot_rate_windows(
    updates: DataFrame,
    size: str = "5 minutes",
    threshold: float = BOT_SCORE_THRESHOLD,
    key: str = "user_session",
    ts: str = "last_event_time",
) -> DataFrame:
    """Bot metrics per tumbling window, each session counted once with its newest score.

    The first aggregation keeps one score per session and window; the second is global per
    window, so only one small row per task and window travels to it. Works on streams whose
    event-time column carries a watermark.
    """
    active = status_filter(updates, "active")
    latest = active.groupBy(F.window(ts, size).alias("w1"), key).agg(
        F.max_by("bot_score", ts).alias("bot_score")
    )
    if updates.isStreaming:
        grouped = latest.groupBy(F.window(F.window_time("w1"), size).alias("w"))
    else:
        grouped = latest.groupBy(F.col("w1").alias("w"))
    bounds = [F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end")]
    return bot_rate_result(bot_rate_accumulator(grouped, threshold), bounds)
