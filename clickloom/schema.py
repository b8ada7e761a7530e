"""Record layouts and fixed values of the clickstream data model."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_time", T.TimestampType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("product_id", T.LongType(), False),
        T.StructField("category_id", T.LongType(), False),
        T.StructField("category_code", T.StringType(), True),
        T.StructField("brand", T.StringType(), True),
        T.StructField("price", T.DecimalType(12, 2), False),
        T.StructField("user_id", T.LongType(), False),
        T.StructField("user_session", T.StringType(), True),
    ]
)
EVENT_COLUMNS = EVENT_SCHEMA.fieldNames()
EVENT_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss 'UTC'"

RAW_SCHEMA = T.StructType([T.StructField("payload", T.StringType(), True)])
CLEAN_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in EVENT_COLUMNS])
DLQ_COLUMNS = ["original_payload", "failure_reason", "processing_timestamp"]

# They define what a valid record is and how results are labelled.
SUPPORTED_EVENT_TYPES = ["view", "cart", "purchase", "remove_from_cart"]
PRODUCER_NAMES = {
    "view": "ViewProducer",
    "cart": "CartProducer",
    "purchase": "PurchaseProducer",
    "remove_from_cart": "RemoveFromCartProducer",
}
UNKNOWN_PRODUCER = "UnknownProducer"
CORRUPTIONS = [
    ("null user_session", "user_session", ""),
    ("invalid timestamp", "event_time", "not-a-timestamp"),
    ("unknown event_type", "event_type", "unknown_event"),
    ("missing product_id", "product_id", ""),
]
REQUIRED_REFERENCE_COLUMNS = ["event_time", "event_type", "product_id", "user_id", "user_session"]
CATEGORY_COLUMNS = ["brand", "category_code"]
FEATURE_COLUMNS = [
    "brand",
    "category_code",
    "day_of_week",
    "hour_of_day",
    "view_count",
    "cart_add_count",
]
BOT_SCORE_THRESHOLD = 0.95
SESSION_TIMEOUT_MS = 5_220_000
OUT_OF_ORDERNESS_MS = 5_000
SCORE_BUCKET_LABELS = ["0.0-0.2", "0.2-0.4", "0.4-0.6", "0.6-0.8", "0.8-1.0"]
INTERVAL_STATISTICS = [
    "mean_click_interval_ms",
    "min_click_interval_ms",
    "max_click_interval_ms",
    "sd_click_interval_ms",
]
SCORED_STATISTICS = [
    "mean_click_interval_ms",
    "min_click_interval_ms",
    "sd_click_interval_ms",
]

# Row layout of the scored-session stream and of its batch twin.
SESSION_UPDATE_SCHEMA = T.StructType(
    [
        T.StructField("user_session", T.StringType()),
        T.StructField("last_event_time", T.TimestampType()),
        T.StructField("event_count", T.LongType()),
        T.StructField("interval_count", T.LongType()),
        T.StructField("mean_click_interval_ms", T.DoubleType()),
        T.StructField("min_click_interval_ms", T.DoubleType()),
        T.StructField("sd_click_interval_ms", T.DoubleType()),
        T.StructField("bot_score", T.DoubleType()),
        T.StructField("is_bot", T.BooleanType()),
        T.StructField("session_status", T.StringType()),
        T.StructField("closed_at", T.TimestampType()),
    ]
)
