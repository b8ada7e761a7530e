"""Replay rules as column transforms: delays, corruption, ticks and dispatch order.

All draws are hashes of a seed and a row id, so they do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.hashing import hash_uniform
from clickloom.functions.times import epoch_micros
from clickloom.operators.ordering import CHUNK, row_positions, row_slice, running_in_order, with_chunks
from clickloom.schema import CORRUPTIONS


def perturb_delay(
    df: DataFrame,
    probability: float,
    mean_seconds: float,
    seed: str = "delay",
    row_id: str = "event_id",
    ts: str = "event_time",
) -> DataFrame:
    """Add ``send_time`` and ``delayed``: a chosen share of rows is sent late by an
    exponentially distributed time."""
    kind = df.schema[ts].dataType.simpleString()
    if probability == 0 or mean_seconds == 0:
        return df.withColumns({"send_time": F.col(ts), "delayed": F.lit(False)})
    draw = hash_uniform(f"{seed}-size", F.col(row_id))
    chosen = hash_uniform(f"{seed}-pick", F.col(row_id)) < F.lit(float(probability))
    micros = F.round(-F.log(1 - draw) * F.lit(mean_seconds * 1e6)).cast("bigint")
    late = F.timestamp_micros(epoch_micros(F.col(ts)) + micros).cast(kind)
    return df.withColumn("delayed", chosen).withColumn(
        "send_time", F.when(F.col("delayed"), late).otherwise(F.col(ts))
    )


def perturb_corrupt(
    df: DataFrame, probability: float, seed: str = "corrupt", row_id: str = "event_id"
) -> DataFrame:
    """Overwrite one field in a chosen share of rows and add ``corruption_reason``.

    Expects the text columns of a raw record.
    """
    draw = hash_uniform(f"{seed}-kind", F.col(row_id)) * len(CORRUPTIONS)
    chosen = hash_uniform(f"{seed}-pick", F.col(row_id)) < F.lit(float(probability))
    drawn = df.withColumn("_kind", F.when(chosen, F.floor(draw).cast("int")))
    changed = {"corruption_reason": F.lit(None).cast("string")}
    for number, (name, field, value) in enumerate(CORRUPTIONS):
        hit = F.coalesce(F.col("_kind") == number, F.lit(False))
        changed["corruption_reason"] = F.when(hit, F.lit(name)).otherwise(changed["corruption_reason"])
        changed[field] = F.when(hit, F.lit(value)).otherwise(F.col(field))
    return drawn.withColumns(changed).drop("_kind")


def replay_tick(
    df: DataFrame, speed: float, loop_seconds: float, ts: str = "event_time", send: str = "send_time"
) -> DataFrame:
    """Add ``tick``: the first replay step whose clock has reached the send time.

    The clock starts at the first event and advances ``speed * loop_seconds`` per tick.
    """
    step = round(speed * loop_seconds * 1_000_000)
    start = df.agg(F.min(epoch_micros(F.col(ts)))).scalar()
    elapsed = epoch_micros(F.col(send)) - start
    steps = F.call_function("div", elapsed + F.lit(step - 1), F.lit(step))
    return df.withColumn("tick", 1 + F.greatest(steps, F.lit(0)))


def ordered_dispatch(
    df: DataFrame, send: str = "send_time", row_id: str = "event_id", chunks: int | None = None
) -> DataFrame:
    """Add ``dispatch_position``: the row's place in the order (send time, row id).

    Ticks never decrease with send time, so this is also the order within and across ticks.
    """
    timed = df.withColumn("_send_us", epoch_micros(F.col(send)))
    return row_positions(timed, ["_send_us", row_id], "dispatch_position", chunks).drop("_send_us")


def out_of_order_flag(
    df: DataFrame,
    ts: str = "event_time",
    send: str = "send_time",
    row_id: str = "event_id",
    chunks: int | None = None,
) -> DataFrame:
    """Add ``out_of_order``: an event with a later time was already sent."""
    timed = df.withColumns(
        {"_send_us": epoch_micros(F.col(send)), "_time_us": epoch_micros(F.col(ts))}
    )
    order = ["_send_us", row_id]
    highest = running_in_order(
        with_chunks(timed, order, chunks), [], order, {"_highest": ("max", "_time_us")}
    )
    flag = F.col("_time_us") < F.col("_highest")
    return highest.withColumn("out_of_order", flag).drop(CHUNK, "_send_us", "_time_us", "_highest")


def bounded_sample(df: DataFrame, rows: int, row_id: str = "event_id") -> DataFrame:
    """The first ``rows`` rows in file order; raises when there are fewer."""
    if df.select(row_id).count() < rows:
        raise ValueError(f"the source holds fewer than {rows} rows")
    return row_slice(df, [row_id], 0, rows)
