"""Event-time session scoring as a stream over a versioned table of session state.

Each micro-batch joins its events with the state the batch before left behind and writes one new
version: updates, open sessions and waiting events together. The whole step is one DataFrame plan:
a single shuffle by session, window functions, no Python per row or key.

Per session: events at or before the watermark are dropped as late, newer ones wait as rows of the
state until the watermark passes them, then update constant-size statistics in event-time order
and yield an ``active`` row each. A session whose inactivity timeout lies at or before the
watermark yields one ``closed`` row and leaves the state.

Layout of the table: ``batch=N/kind=update|open|waiting``. A version is written aside and appears by
one rename, so updates and state agree after any crash and a repeated batch changes nothing. The
watermark is the name of an empty file in it. State older than the version before is deleted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from clickloom.functions.keys import named_session
from clickloom.functions.scoring import bot_score, is_bot, mean_of, sample_sd, square
from clickloom.functions.times import epoch_millis
from clickloom.operators.botrate import bot_rate_windows, latest_per_window, status_filter
from clickloom.schema import (
    BOT_SCORE_THRESHOLD,
    OUT_OF_ORDERNESS_MS,
    SCORED_STATISTICS,
    SESSION_TIMEOUT_MS,
    SESSION_UPDATE_SCHEMA,
)
from clickloom.sources.store import mark, move, names_in, remove
from clickloom.sources.upserts import read_upserts, upsert_sink
from clickloom.streaming.routes import triggered

KEY = "user_session"
STATE_SCHEMA = T.StructType(
    [
        T.StructField(KEY, T.StringType()),
        T.StructField("event_ms", T.LongType()),  # of the newest event, or of the waiting one
        T.StructField("events", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("squares", T.DecimalType(38, 0)),
        T.StructField("low", T.LongType()),
    ]
)
SCORE_KEYS = [KEY]
# A row with later events wins; at equal events the closing row does.
SCORE_ORDER = ["last_event_time", "event_count", "session_status"]
UPDATE_COLUMNS = SESSION_UPDATE_SCHEMA.fieldNames()
NEVER = -(1 << 62)  # the watermark before the first event
WATERMARK = "_watermark="
STAGED = "_staged"
COMPILED_BYTES = "8000"  # the JVM only interprets larger methods, as a whole step in one method would be


def _version(batch_id: int) -> str:
    return f"batch={batch_id:012d}"


def _versions(spark: SparkSession, path: str) -> list[str]:
    return [name for name in names_in(spark, path) if name.startswith("batch=")]


def _watermark(spark: SparkSession, path: str, version: str | None) -> int:
    """The watermark a version was written with."""
    if version is None:
        return NEVER
    marks = [n for n in names_in(spark, f"{path}/{version}") if n.startswith(WATERMARK)]
    return int(marks[0].removeprefix(WATERMARK))


def _state(spark: SparkSession, path: str, version: str | None, kind: str) -> DataFrame:
    """Open sessions or waiting events of a version."""
    if version is None or f"kind={kind}" not in names_in(spark, f"{path}/{version}"):
        return spark.createDataFrame([], STATE_SCHEMA)
    return spark.read.schema(STATE_SCHEMA).parquet(f"{path}/{version}/kind={kind}")


def advance_sessions(
    events: DataFrame,
    sessions: DataFrame,
    waiting: DataFrame,
    before_ms: int,
    watermark_ms: int,
    table: Mapping[str, Sequence[float]],
    timeout_ms: int = SESSION_TIMEOUT_MS,
    threshold: float = BOT_SCORE_THRESHOLD,
) -> DataFrame:
    """One step of the stream: rows of kind ``update``, ``open`` and ``waiting``.

    ``events`` holds (user_session, event_ms); those at or before ``before_ms``, the watermark of
    the step before, are late and only counted. An open session takes part as a row at its newest
    event that brings its statistics along. Gaps and squares add up as whole numbers, so any
    division into steps gives the same sums.
    """

    def state_rows(df: DataFrame, is_open: bool) -> DataFrame:
        return df.select(*STATE_SCHEMA.fieldNames(), F.lit(is_open).alias("_open"))

    one = [F.lit(1).cast("long").alias("events"), F.lit(0).cast("long").alias("total"),
           F.lit(0).cast("decimal(38,0)").alias("squares"), F.lit(None).cast("long").alias("low")]
    plain = waiting.select(KEY, "event_ms").union(events.where(F.col("event_ms") > before_ms).select(KEY, "event_ms"))
    rows = state_rows(sessions, True).union(state_rows(plain.select(KEY, "event_ms", *one), False))
    rows = rows.repartition(KEY)

    by_time = Window.partitionBy(KEY).orderBy("event_ms")
    upto = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    due = F.col("event_ms") <= watermark_ms
    gap = F.col("event_ms") - F.lag("event_ms").over(by_time)
    rows = rows.withColumn("_gap", gap).where("_gap IS NULL OR _gap > 0")  # a repeated time counts once
    starts = F.coalesce(F.col("_gap") > timeout_ms, F.lit(True))
    rows = rows.select("*", due.alias("_due"), starts.alias("_starts")).select(
        "*",
        F.sum(F.col("_starts").cast("long")).over(upto).alias("_piece"),
        F.lead("_starts").over(by_time).alias("_next_starts"),
        F.coalesce(F.lead("_due").over(by_time), F.lit(False)).alias("_next_due"),
    )
    inner = F.when(~F.col("_starts"), F.col("_gap"))
    piece = Window.partitionBy(KEY, "_piece").orderBy("event_ms")
    piece = piece.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(
        KEY, "event_ms", "_open", "_due", "_next_starts", "_next_due",
        F.sum("events").over(piece).alias("events"),
        F.sum(F.col("total") + F.coalesce(inner, F.lit(0))).over(piece).alias("total"),
        F.sum(F.col("squares") + F.coalesce(square(inner), F.lit(0))).over(piece).cast("decimal(38,0)").alias("squares"),
        F.least(F.min("low").over(piece), F.min(inner).over(piece)).alias("low"),
    )
    over = F.when(F.col("_next_due"), F.col("_next_starts")).otherwise(F.col("event_ms") + timeout_ms <= watermark_ms)
    stays = ~F.col("_next_due") & ~over

    def part(kind: str, status: str | None, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(status).cast("string").alias("session_status")))

    parts = F.array_compact(F.array(
        part("update", "active", F.col("_due") & ~F.col("_open")),
        part("update", "closed", F.col("_due") & over),
        part("open", None, F.col("_due") & stays),
        part("waiting", None, ~F.col("_due")),
    ))
    late = events.where(F.col("event_ms") <= before_ms).groupBy(KEY).agg(
        F.max("event_ms").alias("event_ms"), F.count(F.lit(1)).alias("_late")
    )
    late = late.select(
        KEY, "event_ms", F.lit(1).cast("long").alias("events"), *one[1:], F.lit("update").alias("kind"),
        F.lit("late").alias("session_status"), "_late",
    )
    moved = rows.withColumn("_part", F.explode(parts)).select(
        *STATE_SCHEMA.fieldNames(), "_part.*", F.lit(None).cast("long").alias("_late")
    )
    return _with_scores(moved.unionByName(late), table, timeout_ms, threshold)


def _with_scores(rows: DataFrame, table: Mapping[str, Sequence[float]], timeout_ms: int, threshold: float) -> DataFrame:
    """The columns of an update beside those of the state."""
    n = F.col("events") - 1
    scored = rows.select(
        "*",
        F.timestamp_millis("event_ms").alias("last_event_time"),
        F.coalesce("_late", "events").alias("event_count"),
        n.alias("interval_count"),
        mean_of(F.col("total"), n).alias("mean_click_interval_ms"),
        F.col("low").cast("double").alias("min_click_interval_ms"),
        sample_sd(n, F.col("total"), F.col("squares")).alias("sd_click_interval_ms"),
    ).withColumn("bot_score", bot_score(*SCORED_STATISTICS, table))
    closed_at = F.timestamp_millis(F.col("event_ms") + timeout_ms)
    return scored.select(
        "kind", *STATE_SCHEMA.fieldNames(), "last_event_time", "event_count", "interval_count", *SCORED_STATISTICS,
        "bot_score", is_bot(F.col("bot_score"), threshold).alias("is_bot"), "session_status",
        F.when(F.col("session_status") == "closed", closed_at).alias("closed_at"),
    )


def score_batch(
    batch: DataFrame,
    batch_id: int,
    path: str,
    table: Mapping[str, Sequence[float]],
    timeout_ms: int = SESSION_TIMEOUT_MS,
    out_of_orderness_ms: int = OUT_OF_ORDERNESS_MS,
    threshold: float = BOT_SCORE_THRESHOLD,
) -> None:
    """Write version ``batch_id`` of the table from the version before and a batch of events.

    A version that is there already stays as it is.
    """
    spark = batch.sparkSession
    version = _version(batch_id)
    earlier = _versions(spark, path)
    if version in earlier:
        return
    before = max((v for v in earlier if v < version), default=None)
    before_ms = _watermark(spark, path, before)
    newest = batch.agg(F.max("event_ms")).first()[0]
    watermark_ms = before_ms if newest is None else max(before_ms, newest - out_of_orderness_ms)
    rows = advance_sessions(
        batch, _state(spark, path, before, "open"), _state(spark, path, before, "waiting"),
        before_ms, watermark_ms, table, timeout_ms, threshold,
    )
    staged = f"{path}/{STAGED}/{version}"
    rows.write.mode("overwrite").partitionBy("kind").parquet(staged)
    mark(spark, f"{staged}/{WATERMARK}{watermark_ms}")
    move(spark, staged, f"{path}/{version}")
    for old in [v for v in earlier if before and v < before][-2:]:
        for kind in ("open", "waiting"):
            remove(spark, f"{path}/{old}/kind={kind}")


def score_sessions_stream(
    events: DataFrame,
    table: Mapping[str, Sequence[float]],
    path: str,
    checkpoint: str,
    timeout_ms: int = SESSION_TIMEOUT_MS,
    out_of_orderness_ms: int = OUT_OF_ORDERNESS_MS,
    threshold: float = BOT_SCORE_THRESHOLD,
    key: str = KEY,
    ts: str = "event_time",
    available_now: bool = False,
) -> StreamingQuery:
    """Score a stream of events into the table at ``path``.

    Updates have status ``active``, ``closed`` or ``late``; a ``late`` row says how many events of a
    session a batch dropped, exactly. Events without a session name or time are ignored.
    """
    narrow = events.where(named_session(key) & F.col(ts).isNotNull()).select(
        F.col(key).alias(KEY), epoch_millis(F.col(ts)).alias("event_ms")
    )

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")  # streams turn it off
        batch.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED_BYTES)
        score_batch(batch, batch_id, path, table, timeout_ms, out_of_orderness_ms, threshold)

    writer = narrow.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return triggered(writer, available_now).start()


def read_session_updates(spark: SparkSession, path: str) -> DataFrame:
    """Stream over the stored updates. Each batch of the writer arrives complete."""
    return spark.readStream.schema(SESSION_UPDATE_SCHEMA).parquet(f"{path}/batch=*/kind=update")


def stored_updates(spark: SparkSession, path: str) -> DataFrame:
    """All updates so far, as a table."""
    names = [v for v in _versions(spark, path) if "kind=update" in names_in(spark, f"{path}/{v}")]
    if not names:
        return spark.createDataFrame([], SESSION_UPDATE_SCHEMA)
    return spark.read.schema(SESSION_UPDATE_SCHEMA).parquet(*[f"{path}/{v}/kind=update" for v in names])


def session_state(spark: SparkSession, path: str) -> DataFrame:
    """What the newest version holds: a row per open session and per waiting event."""
    newest = max(_versions(spark, path), default=None)
    kinds = [_state(spark, path, newest, kind).withColumn("kind", F.lit(kind)) for kind in ("open", "waiting")]
    return kinds[0].unionByName(kinds[1])


def session_gauges(spark: SparkSession, path: str) -> DataFrame:
    """One row: sessions in state, events that wait for the watermark, late events so far."""
    held = session_state(spark, path).agg(
        F.count_distinct(KEY).alias("active_sessions"),
        F.count_if(F.col("kind") == "waiting").alias("retained_events"),
    )
    late = status_filter(stored_updates(spark, path), "late").agg(
        F.coalesce(F.sum("event_count"), F.lit(0)).alias("late_events")
    )
    return held.join(F.broadcast(late))  # one row each


def bot_rate_stream(updates: DataFrame, size: str = "5 minutes", threshold: float = BOT_SCORE_THRESHOLD) -> DataFrame:
    """Bot metrics per window from the update stream, one row when a window is complete."""
    active = status_filter(updates, "active").withWatermark("last_event_time", "0 seconds")
    return bot_rate_windows(active, size, threshold)


def score_writes_stream(updates: DataFrame, size: str = "1 minute") -> DataFrame:
    """What the score table receives: each session's newest active row per minute, and every
    closed row as it comes."""
    active = status_filter(updates, "active").withWatermark("last_event_time", "0 seconds")
    latest = latest_per_window(active, size).select(*UPDATE_COLUMNS)
    closed = status_filter(updates, "closed").select(*UPDATE_COLUMNS)
    return latest.union(closed)


def upsert_session_scores(
    writes: DataFrame, target: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Keep the score table, one current row per session, read by read_session_scores."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        stamped = batch.withColumn("updated_at", F.current_timestamp())
        upsert_sink(stamped, batch_id, target, SCORE_KEYS, SCORE_ORDER)

    writer = writes.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return triggered(writer, available_now).start()


def read_session_scores(spark, target: str) -> DataFrame:
    return read_upserts(spark, target, SCORE_KEYS, SCORE_ORDER)


METRIC_KEYS = ["window_start", "window_end"]


def upsert_bot_metrics(
    metrics: DataFrame, target: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Keep the metrics table, one current row per window, read by read_bot_metrics."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        upsert_sink(batch.withColumn("updated_at", F.current_timestamp()), batch_id, target, METRIC_KEYS, [])

    writer = metrics.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return triggered(writer, available_now).start()


def read_bot_metrics(spark: SparkSession, target: str) -> DataFrame:
    return read_upserts(spark, target, METRIC_KEYS)
