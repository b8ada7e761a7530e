"""View of the shared ``events`` test table as a clickstream.

Event types, products, brands and sessions are derived from the columns of ``events``; see
FIXTURES.md section 3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.schema import EVENT_COLUMNS
from clickloom.session import pin_utc

# How the test table's event types map onto the clickstream's.
EVENT_TYPE_MAP = {"click": "cart", "signup": "remove_from_cart"}


def clickstream(spark: SparkSession, sf_dir: str, sessions: str = "daily") -> DataFrame:
    """Clickstream events plus their ``event_id``.

    ``daily`` sessions are one user's events of one day; ``lifetime`` sessions are all events
    of a user.
    """
    pin_utc(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    product = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("event_type")
    for source, target in EVENT_TYPE_MAP.items():
        kind = F.when(F.col("event_type") == source, target).otherwise(kind)
    user = F.col("user_id").cast("string")
    session = {
        "daily": F.concat(user, F.lit("-"), F.to_date("ts").cast("string")),
        "lifetime": user,
    }[sessions]
    group = F.call_function("div", F.col("product_id"), F.lit(10))
    return (
        events.withColumn("product_id", product)
        .select(
            "event_id",
            F.col("ts").alias("event_time"),
            kind.alias("event_type"),
            "product_id",
            group.alias("category_id"),
            F.when(F.col("product_id") % 5 != 0, F.concat(F.lit("cat_"), group.cast("string"))).alias(
                "category_code"
            ),
            F.when(
                F.col("product_id") % 7 != 0,
                F.concat(F.lit("brand_"), (F.col("product_id") % 7).cast("string")),
            ).alias("brand"),
            F.col("value").cast("decimal(12,2)").alias("price"),
            "user_id",
            session.alias("user_session"),
        )
        .select("event_id", *EVENT_COLUMNS)
    )


SENTINEL = "~end-of-replay"


def replay_pieces(events: DataFrame, cuts: list[str], arrival: str = "event_time") -> list[DataFrame]:
    """Events as they arrive: one piece per range of ``arrival``, then two ends of replay.

    The ends are far-future events of a key of their own; they let the watermark pass every real
    event and every session timeout.
    """
    spark = events.sparkSession
    bounds = [None, *cuts, None]
    pieces = []
    for low, high in zip(bounds, bounds[1:]):
        piece = events
        if low:
            piece = piece.where(F.col(arrival) >= F.lit(low).cast("timestamp_ntz"))
        if high:
            piece = piece.where(F.col(arrival) < F.lit(high).cast("timestamp_ntz"))
        pieces.append(piece.select("user_session", F.col("event_time").cast("timestamp").alias("event_time")))
    ends = [f"SELECT '{SENTINEL}' AS user_session, timestamp'{end} 00:00:00' AS event_time" for end in ("2100-01-01", "2100-01-02")]
    return pieces + [spark.sql(end) for end in ends]
