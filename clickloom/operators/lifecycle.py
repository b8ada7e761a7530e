"""Sessions cut by inactivity, with running and final bot scores.

Batch twin of the session-scoring stream. Times count in whole milliseconds and an event that
repeats the previous time adds nothing.

Events shuffle once, by key, and form pieces without a long gap: its sessions. A very busy key is
cut into spans; its pieces, far fewer than events, then join up to sessions per key.
"""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.scoring import bot_score, is_bot, mean_of, sample_sd, square
from clickloom.functions.times import epoch_millis, millis_to_time
from clickloom.functions.keys import named_session
from clickloom.operators.spans import SPAN, cut_points, in_spans
from clickloom.schema import BOT_SCORE_THRESHOLD, SCORED_STATISTICS, SESSION_TIMEOUT_MS

TIME = "_t"
SEQ = "session_seq"
PIECE = "_piece"
GAP = "_gap"


def _times(df: DataFrame, key: str, ts: str) -> DataFrame:
    return df.where(named_session(key) & F.col(ts).isNotNull()).select(
        key, epoch_millis(F.col(ts)).alias(TIME)
    )


def _in_pieces(spanned: DataFrame, key: str, timeout_ms: int) -> DataFrame:
    """One row per distinct time: its piece within the span and the gap inside that piece."""
    times = spanned.distinct()
    by_time = Window.partitionBy(key, SPAN).orderBy(TIME)
    upto = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gapped = times.withColumn(GAP, F.col(TIME) - F.lag(TIME).over(by_time))
    breaks = F.coalesce(F.col(GAP) > timeout_ms, F.lit(False))
    numbered = gapped.withColumn(PIECE, F.sum(breaks.cast("bigint")).over(upto))
    return numbered.withColumn(GAP, F.when(~breaks, F.col(GAP)))


def _joined_up(rows: DataFrame, key: str, timeout_ms: int) -> DataFrame:
    """One row per piece with its session and ``_cross``, the gap to that session's last piece."""
    pieces = rows.groupBy(key, SPAN, PIECE).agg(
        F.min(TIME).alias("_first"),
        F.max(TIME).alias("_last"),
        F.count(F.lit(1)).alias("event_count"),
        F.sum(GAP).alias("_total"),
        F.sum(square(F.col(GAP))).alias("_squares"),
        F.min(GAP).alias("_low"),
    )
    by_time = Window.partitionBy(key).orderBy("_first")
    upto = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gapped = pieces.withColumn("_cross", F.col("_first") - F.lag("_last").over(by_time))
    starts = F.coalesce(F.col("_cross") > timeout_ms, F.lit(True))
    numbered = gapped.withColumn(SEQ, F.sum(starts.cast("bigint")).over(upto))
    return numbered.withColumn("_cross", F.when(~starts, F.col("_cross")))


def _plus(*parts) -> Column:
    """Sum of counts or moments, absent ones as 0."""
    return reduce(operator.add, [F.coalesce(part, F.lit(0)) for part in parts])


def _carries(pieces: DataFrame, key: str) -> DataFrame:
    """What each span's first piece continues: moments of its session up to that piece."""
    session = Window.partitionBy(key, SEQ).orderBy("_first")
    earlier = session.rowsBetween(Window.unboundedPreceding, -1)
    upto = session.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cross = F.col("_cross")
    carried = pieces.select(
        key,
        SPAN,
        PIECE,
        F.col(SEQ).alias("_first_seq"),
        F.sum("event_count").over(earlier).alias("_c_events"),
        _plus(F.sum("_total").over(earlier), F.sum(cross).over(upto)).alias("_c_total"),
        _plus(F.sum("_squares").over(earlier), F.sum(square(cross)).over(upto)).alias("_c_squares"),
        F.least(F.min("_low").over(earlier), F.min(cross).over(upto)).alias("_c_low"),
    )
    return carried.where(F.col(PIECE) == 0).drop(PIECE)


def _carried_on(inside: DataFrame, carries: DataFrame, key: str) -> DataFrame:
    """Add to each span's first piece what its session brings from the spans before."""
    first = F.col(PIECE) == 0

    def carried(column: str) -> Column:
        return F.when(first, F.col(column))

    joined = inside.join(F.broadcast(carries), [key, SPAN], "left")  # a row per cut
    return joined.select(
        key,
        (F.coalesce("_first_seq", F.lit(1)) + F.col(PIECE)).alias(SEQ),
        TIME,
        _plus(F.col("event_count"), carried("_c_events")).alias("event_count"),
        _plus(F.col("_total"), carried("_c_total")).alias("_total"),
        _plus(F.col("_squares"), carried("_c_squares")).cast("decimal(38,0)").alias("_squares"),
        F.least(F.col("_low"), carried("_c_low")).alias("_low"),
    )


def _scored(
    df: DataFrame,
    key: str,
    table: Mapping[str, Sequence[float]],
    threshold: float,
    status,
    closed_at,
) -> DataFrame:
    intervals = F.col("event_count") - 1
    rows = df.select(
        key,
        SEQ,
        TIME,
        "event_count",
        intervals.alias("interval_count"),
        mean_of(F.col("_total"), intervals).alias("mean_click_interval_ms"),
        F.col("_low").cast("double").alias("min_click_interval_ms"),
        sample_sd(intervals, F.col("_total"), F.col("_squares")).alias("sd_click_interval_ms"),
    )
    score = bot_score(*SCORED_STATISTICS, table)
    return rows.withColumn("bot_score", score).select(
        key,
        SEQ,
        millis_to_time(F.col(TIME)).alias("last_event_time"),
        "event_count",
        "interval_count",
        "mean_click_interval_ms",
        "min_click_interval_ms",
        "sd_click_interval_ms",
        "bot_score",
        is_bot(F.col("bot_score"), threshold).alias("is_bot"),
        status.alias("session_status"),
        closed_at.alias("closed_at"),
    )


def running_session_score(
    df: DataFrame,
    table: Mapping[str, Sequence[float]],
    timeout_ms: int = SESSION_TIMEOUT_MS,
    key: str = "user_session",
    ts: str = "event_time",
    threshold: float = BOT_SCORE_THRESHOLD,
) -> DataFrame:
    """The ``active`` rows of the stream: a session's state after each of its events."""
    times = _times(df, key, ts)
    cuts = cut_points(times, key, TIME)
    rows = _in_pieces(in_spans(times, key, TIME, cuts), key, timeout_ms)
    upto = (
        Window.partitionBy(key, SPAN, PIECE)
        .orderBy(TIME)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inside = rows.select(
        key,
        SPAN,
        PIECE,
        TIME,
        F.count(F.lit(1)).over(upto).alias("event_count"),
        F.sum(GAP).over(upto).alias("_total"),
        F.sum(square(F.col(GAP))).over(upto).alias("_squares"),
        F.min(GAP).over(upto).alias("_low"),
    )
    if cuts is None:
        rows = inside.withColumn(SEQ, F.col(PIECE) + 1)
    else:
        pieces = _in_pieces(in_spans(times, key, TIME, cuts, only_cut=True), key, timeout_ms)
        rows = _carried_on(inside, _carries(_joined_up(pieces, key, timeout_ms), key), key)
    return _scored(
        rows, key, table, threshold, F.lit("active"), F.lit(None).cast("timestamp_ntz")
    )


def batch_session_lifecycle(
    df: DataFrame,
    table: Mapping[str, Sequence[float]],
    timeout_ms: int = SESSION_TIMEOUT_MS,
    key: str = "user_session",
    ts: str = "event_time",
    threshold: float = BOT_SCORE_THRESHOLD,
    as_of_ms: int | None = None,
) -> DataFrame:
    """One final row per session, numbered by ``session_seq`` within a re-used key.

    A session ends when the gap to the next event exceeds the timeout. With ``as_of_ms``,
    sessions whose timeout lies after it are still ``active``.
    """

    times = _times(df, key, ts)
    spanned = in_spans(times, key, TIME, cut_points(times, key, TIME))
    pieces = _joined_up(_in_pieces(spanned, key, timeout_ms), key, timeout_ms)
    cross = F.col("_cross")
    rows = pieces.groupBy(key, SEQ).agg(
        F.max("_last").alias(TIME),
        F.sum("event_count").alias("event_count"),
        _plus(F.sum("_total"), F.sum(cross)).alias("_total"),
        _plus(F.sum("_squares"), F.sum(square(cross))).cast("decimal(38,0)").alias("_squares"),
        F.least(F.min("_low"), F.min(cross)).alias("_low"),
    )
    close_ms = F.col(TIME) + timeout_ms
    if as_of_ms is None:
        status, closed_at = F.lit("closed"), millis_to_time(close_ms)
    else:
        over = close_ms <= as_of_ms
        status = F.when(over, F.lit("closed")).otherwise(F.lit("active"))
        closed_at = F.when(over, millis_to_time(close_ms))
    return _scored(rows, key, table, threshold, status, closed_at)


def current_scores(lifecycle: DataFrame, key: str = "user_session") -> DataFrame:
    """Latest session of each key: what a table upserted by key would hold."""
    columns = [c for c in lifecycle.columns if c != key]
    latest = lifecycle.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(SEQ)).alias("r"))
    return latest.select(key, "r.*")
