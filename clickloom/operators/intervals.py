"""Click intervals, per-session interval statistics and the percentile reference table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.scoring import mean_of, sample_sd, square
from clickloom.functions.times import epoch_micros
from clickloom.operators.percentiles import exact_percentiles
from clickloom.operators.spans import SPAN, cut_points, in_spans
from clickloom.schema import INTERVAL_STATISTICS, SCORED_STATISTICS

GAP = "_gap_us"
TIME = "_time_us"


def _timed(df: DataFrame, key: str, ts: str) -> DataFrame:
    return df.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn(TIME, epoch_micros(F.col(ts)))


def click_intervals(
    df: DataFrame, key: str = "user_session", ts: str = "event_time", tiebreak: str | None = None
) -> DataFrame:
    """Add ``click_interval_ms``: time since the previous event of the same key, null first.

    Events with equal times are 0 ms apart; of these the one with the lowest ``tiebreak``
    carries the gap to the time before. Events shuffle once, by key; of a key that is cut into
    spans, the first event of a span looks back to the span before it.
    """
    timed = _timed(df, key, ts)
    cuts = cut_points(timed, key, TIME)
    order = [F.col(TIME), *([F.col(tiebreak).asc_nulls_last()] if tiebreak else [])]
    previous = F.lag(TIME).over(Window.partitionBy(key, SPAN).orderBy(*order))
    rows = in_spans(timed, key, TIME, cuts).withColumn("_previous", previous)
    before = F.col("_previous")
    if cuts is not None:
        ends = in_spans(timed.select(key, TIME), key, TIME, cuts, only_cut=True)
        ends = ends.groupBy(key, SPAN).agg(F.max(TIME).alias("_end"))
        carried = F.lag("_end").over(Window.partitionBy(key).orderBy(SPAN)).alias("_carried")
        rows = rows.join(F.broadcast(ends.select(key, SPAN, carried)), [key, SPAN], "left")  # a row per cut
        before = F.coalesce("_previous", "_carried")
    return rows.select(*df.columns, ((F.col(TIME) - before) / F.lit(1000.0)).alias("click_interval_ms"))


def require_interval(df: DataFrame, column: str = "click_interval_ms") -> DataFrame:
    """Keep events that have a previous event and do not run backwards."""
    return df.where(F.col(column).isNotNull() & (F.col(column) >= 0))


def session_interval_stats(
    df: DataFrame, key: str = "user_session", ts: str = "event_time"
) -> DataFrame:
    """Count, mean, min, max and sample deviation of click intervals per session.

    Events shuffle once, by key: repeated times fold into counts, and a key into one row of
    moments in whole microseconds. A key that is cut into spans gives a row per span; those meet
    by key, where the gaps between spans join in. All but the first of several events at one
    time are 0 ms intervals.
    """
    timed = _timed(df.select(key, ts), key, ts).select(key, TIME)
    times = in_spans(timed, key, TIME, cut_points(timed, key, TIME)).groupBy(key, SPAN, TIME)
    times = times.agg(F.count(F.lit(1)).alias("_copies"))
    before = F.lag(TIME).over(Window.partitionBy(key, SPAN).orderBy(TIME))
    gap = F.col(GAP)
    spans = times.withColumn(GAP, F.col(TIME) - before).groupBy(key, SPAN).agg(
        F.min(TIME).alias("_first"),
        F.max(TIME).alias("_last"),
        F.sum("_copies").alias("_events"),
        F.sum(gap).alias("_total"),
        F.sum(square(gap)).alias("_squares"),
        F.min(F.when(F.col("_copies") > 1, F.lit(0)).otherwise(gap)).alias("_low"),
        F.max(gap).alias("_high"),
    )
    crossing = F.col("_first") - F.lag("_last").over(Window.partitionBy(key).orderBy(SPAN))
    cross = F.col("_cross")

    def added(inside: str, between) -> Column:
        return F.coalesce(F.sum(inside), F.lit(0)) + F.coalesce(F.sum(between), F.lit(0))

    moments = spans.withColumn("_cross", crossing).groupBy(key).agg(
        (F.sum("_events") - 1).alias("interval_count"),
        added("_total", cross).alias("_total"),
        added("_squares", square(cross)).cast("decimal(38,0)").alias("_squares"),
        F.least(F.min("_low"), F.min(cross)).alias("_low"),
        F.greatest(F.max("_high"), F.max(cross), F.lit(0)).alias("_high"),
    )
    n, total = F.col("interval_count"), F.col("_total")
    thousand = F.lit(1000.0)
    return moments.where(n > 0).select(
        key,
        "interval_count",
        (mean_of(total, n) / thousand).alias("mean_click_interval_ms"),
        (F.col("_low") / thousand).alias("min_click_interval_ms"),
        (F.col("_high") / thousand).alias("max_click_interval_ms"),
        (sample_sd(n, total, F.col("_squares")) / thousand).alias("sd_click_interval_ms"),
    )


def interval_percentiles(stats: DataFrame) -> DataFrame:
    """One row of four arrays: percentiles 0..100 of each statistic."""
    found = exact_percentiles(stats, INTERVAL_STATISTICS, [p / 100 for p in range(101)])
    return found.groupBy().agg(
        *[
            F.first(F.when(F.col("statistic") == name, F.col("percentiles")), ignorenulls=True).alias(
                f"{name}_values"
            )
            for name in INTERVAL_STATISTICS
        ]
    )


def percentile_unpivot(row: DataFrame) -> DataFrame:
    """The reference table: one row per percentile with its four thresholds.

    A statistic that no session has is a column of nulls; without sessions there is no row.
    """
    values = {name: F.col(f"{name}_values") for name in INTERVAL_STATISTICS}
    longest = F.greatest(*(F.coalesce(F.size(v), F.lit(0)) for v in values.values()))
    places = F.when(longest > 0, F.sequence(F.lit(0), longest - 1))
    exploded = row.select(F.explode(places).alias("percentile"), *values.values())
    return exploded.select(
        "percentile",
        (F.col("percentile") / F.lit(100.0)).alias("percentile_fraction"),
        *[F.get(values[name], F.col("percentile")).alias(name) for name in INTERVAL_STATISTICS],
    )


def inactivity_timeout(stats: DataFrame, fraction: float = 0.99) -> DataFrame:
    """Whole milliseconds after which a session counts as over."""
    found = exact_percentiles(stats, ["max_click_interval_ms"], [fraction])
    return found.select(
        F.ceil(F.element_at("percentiles", 1)).cast("bigint").alias("session_inactivity_timeout_ms")
    )


def session_count(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count(F.lit(1)).alias("session_count"))


def thresholds_of(table: DataFrame) -> dict[str, list[float]]:
    """The 101-row reference table as driver-side lists for the scoring expressions.

    Scores against missing thresholds would call every session a bot, so these are refused.
    """
    rows = table.orderBy("percentile").collect()
    found = {name: [row[name] for row in rows] for name in INTERVAL_STATISTICS}
    empty = [name for name in SCORED_STATISTICS if not rows or None in found[name]]
    if empty:
        raise ValueError(f"no thresholds for {', '.join(empty)}")
    return found
