"""Offline build of the scoring reference: percentile table, timeout and config."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.operators.intervals import (
    inactivity_timeout,
    interval_percentiles,
    percentile_unpivot,
    session_count,
    session_interval_stats,
    thresholds_of,
)
from clickloom.operators.quality import expect_column_subset, expect_row_count
from clickloom.schema import BOT_SCORE_THRESHOLD, REQUIRED_REFERENCE_COLUMNS
from clickloom.session import materialize
from clickloom.sources.sinks import write_reference_csv


@dataclass
class BotConfig:
    session_inactivity_timeout_ms: int
    session_count: int
    source_row_count: int
    generated_at_utc: str
    bot_score_threshold: float = BOT_SCORE_THRESHOLD
    session_inactivity_timeout_source: dict = field(
        default_factory=lambda: {"metric": "max_click_interval_ms", "percentile": 99}
    )


def percentile_table(events: DataFrame) -> DataFrame:
    """The 101-row threshold table of an event history."""
    stats = materialize(session_interval_stats(events), "interval-stats")
    return percentile_unpivot(interval_percentiles(stats))


def scoring_thresholds(events: DataFrame) -> dict[str, list[float]]:
    return thresholds_of(percentile_table(events))


def build_reference(events: DataFrame, base: str) -> BotConfig:
    """Write ``percentiles`` (Parquet and CSV) and ``bot_config`` under ``base``.

    Interval statistics are computed once and stored; percentiles, the session count and the
    timeout all come from that table.
    """
    expect_column_subset(events, REQUIRED_REFERENCE_COLUMNS)
    source_rows = expect_row_count(events)
    stats = materialize(session_interval_stats(events), "interval-stats")
    table = percentile_unpivot(interval_percentiles(stats))
    table.write.mode("overwrite").parquet(f"{base}/percentiles")
    stored = events.sparkSession.read.parquet(f"{base}/percentiles")
    write_reference_csv(stored, f"{base}/percentiles_csv")
    config = BotConfig(
        session_inactivity_timeout_ms=inactivity_timeout(stats).first()[0],
        session_count=session_count(stats).first()[0],
        source_row_count=source_rows,
        generated_at_utc=datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"),
    )
    text = events.sparkSession.createDataFrame([(json.dumps(asdict(config), sort_keys=True),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{base}/bot_config")
    return config


def load_reference(spark: SparkSession, base: str) -> tuple[dict[str, list[float]], BotConfig]:
    """Thresholds and config as driver-side values: 101 rows and one line of JSON."""
    thresholds = thresholds_of(spark.read.parquet(f"{base}/percentiles"))
    if not thresholds["mean_click_interval_ms"]:
        raise ValueError(f"no percentile rows under {base}")
    line = spark.read.text(f"{base}/bot_config").where(F.col("value") != "").first()["value"]
    return thresholds, BotConfig(**json.loads(line))
