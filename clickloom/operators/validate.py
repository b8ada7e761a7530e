"""Parsing of raw JSON events, ordered validation rules and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.times import event_date, iso_instant, parse_event_time
from clickloom.operators.sessions import share_of_total
from clickloom.schema import EVENT_COLUMNS, SUPPORTED_EVENT_TYPES


def parse_event_json(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Nine text columns from one JSON parse; a broken payload gives nulls.

    Unquoted numbers are read as text. The parse is a generator, so filters on its columns
    stay above it instead of repeating it.
    """
    fields = F.json_tuple(payload, *EVENT_COLUMNS).alias(*EVENT_COLUMNS)
    return df.select(*df.columns, fields)


def typed_parse(df: DataFrame) -> DataFrame:
    """Add ``event_timestamp`` and ``price_value``, null where the text does not convert."""
    return df.withColumns(
        {
            "event_timestamp": parse_event_time(F.col("event_time")),
            "price_value": F.col("price").try_cast("double"),
        }
    )


def _missing(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column) == "")


def failure_reason() -> Column:
    """The first rule a parsed record breaks, or null. Needs the columns of typed_parse."""
    bad_price = ~_missing("price") & F.col("price_value").isNull()
    return (
        F.when(_missing("event_time"), "missing event_time")
        .when(F.col("event_timestamp").isNull(), "invalid event_time")
        .when(_missing("event_type"), "missing event_type")
        .when(~F.col("event_type").isin(SUPPORTED_EVENT_TYPES), "unsupported event_type")
        .when(_missing("product_id"), "missing product_id")
        .when(_missing("user_id"), "missing user_id")
        .when(_missing("user_session"), "missing user_session")
        .when(bad_price, "invalid price")
    )


def validated(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Payload, the nine text columns and ``failure_reason``."""
    typed = typed_parse(parse_event_json(raw, payload))
    return typed.withColumn("failure_reason", failure_reason()).drop(
        "event_timestamp", "price_value"
    )


def route_clean(checked: DataFrame) -> DataFrame:
    """Valid records with the unchanged source columns."""
    return checked.where(F.col("failure_reason").isNull()).select(*EVENT_COLUMNS)


def route_dlq(checked: DataFrame, payload: str = "payload") -> DataFrame:
    """Rejected records: the payload as received, the reason and the processing time."""
    return checked.where(F.col("failure_reason").isNotNull()).select(
        F.col(payload).alias("original_payload"),
        "failure_reason",
        iso_instant(F.current_timestamp()).alias("processing_timestamp"),
    )


def route(raw: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    checked = validated(raw, payload)
    return route_clean(checked), route_dlq(checked, payload)


def validation_metrics(checked: DataFrame) -> DataFrame:
    """One row per outcome (``valid`` or the reason) with its count and share."""
    outcome = F.coalesce(F.col("failure_reason"), F.lit("valid"))
    counts = checked.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("records"))
    return share_of_total(counts, "records", "share")


def validation_summary(checked: DataFrame) -> DataFrame:
    """Valid and invalid record counts and the dead-letter rate."""
    valid = F.count_if(F.col("failure_reason").isNull())
    invalid = F.count_if(F.col("failure_reason").isNotNull())
    total = F.count(F.lit(1))
    rate = F.when(total > 0, invalid.cast("double") / total).otherwise(F.lit(0.0))
    return checked.agg(
        valid.alias("valid_records"), invalid.alias("invalid_records"), rate.alias("dlq_rate")
    )


def with_event_date(clean: DataFrame) -> DataFrame:
    """Archive layout: the clean record plus its partition date."""
    return clean.withColumn("event_date", event_date(parse_event_time(F.col("event_time"))))


def as_payload(events: DataFrame) -> DataFrame:
    """Typed events as raw JSON text, the way a producer publishes them."""
    texts = [
        F.concat(F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")).alias("event_time")
        if c == "event_time"
        else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
        for c in EVENT_COLUMNS
    ]
    return events.select(F.to_json(F.struct(*texts)).alias("payload"))


def text_events(events: DataFrame, keep: list[str]) -> DataFrame:
    """Typed events as the nine text columns of a raw record, plus the kept columns."""
    texts = {
        c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in EVENT_COLUMNS if c != "event_time"
    }
    texts["event_time"] = F.concat(
        F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")
    )
    return events.select(*keep, *[texts[c].alias(c) for c in EVENT_COLUMNS])
