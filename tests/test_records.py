"""Validation rules, replay rules and quality gates on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from clickloom.functions.times import parse_replay_time
from clickloom.operators import perturb, quality, sessions, validate
from clickloom.schema import DLQ_COLUMNS, EVENT_COLUMNS

GOOD = {
    "event_time": "2019-10-01 00:00:01 UTC",
    "event_type": "view",
    "product_id": "1",
    "category_id": "2",
    "category_code": "a.b",
    "brand": "x",
    "price": "10.5",
    "user_id": "3",
    "user_session": "s",
}


def changed(**fields) -> str:
    return json.dumps({**GOOD, **fields})


RULES = [
    (changed(), None),
    (changed(price=""), None),
    (changed(category_code=None, brand=""), None),
    (changed(product_id=1, user_id=3, price=10.5), None),
    (changed(event_time="2019-10-01 00:00:01.250 UTC"), None),
    (changed(event_time="2019-10-01T00:00:01Z"), None),
    (changed(event_time=""), "missing event_time"),
    (changed(event_time=None), "missing event_time"),
    ("not json", "missing event_time"),
    ("", "missing event_time"),
    (changed(event_time="not-a-timestamp"), "invalid event_time"),
    (changed(event_time="2019-02-30 00:00:00 UTC"), "invalid event_time"),
    (changed(event_time="2019-10-01 25:00:00 UTC"), "invalid event_time"),
    (changed(event_time="now"), "invalid event_time"),
    (changed(event_type=""), "missing event_type"),
    (changed(event_type="click"), "unsupported event_type"),
    (changed(product_id=""), "missing product_id"),
    (changed(user_id=None), "missing user_id"),
    (changed(user_session=""), "missing user_session"),
    (changed(price="abc"), "invalid price"),
    (changed(price="abc", user_session=""), "missing user_session"),
    (changed(event_type="click", product_id=""), "unsupported event_type"),
]


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(i, payload) for i, (payload, _) in enumerate(RULES)]
    return spark.createDataFrame(rows, "i int, payload string")


def test_first_broken_rule_wins(raw):
    found = validate.validated(raw).orderBy("i").collect()
    assert [row["failure_reason"] for row in found] == [reason for _, reason in RULES]


def test_every_record_goes_one_way(raw):
    clean, dlq = validate.route(raw)
    assert clean.columns == EVENT_COLUMNS and dlq.columns == DLQ_COLUMNS
    assert clean.count() == 6
    assert sorted(r["original_payload"] for r in dlq.collect()) == sorted(
        payload for payload, reason in RULES if reason
    )
    assert quality.reconcile(raw, clean, dlq).first()["balanced"]
    assert not quality.reconcile(raw, clean, clean).first()["balanced"]


def test_summary_of_nothing(raw):
    row = validate.validation_summary(validate.validated(raw.limit(0))).first()
    assert (row["valid_records"], row["invalid_records"], row["dlq_rate"]) == (0, 0, 0.0)


def test_round_trip_of_payloads(spark, sf_dir):
    from clickloom.sources.fixtures import clickstream

    events = clickstream(spark, sf_dir)
    back = validate.parse_event_json(validate.as_payload(events)).drop("payload")
    texts = validate.text_events(events, [])
    assert back.exceptAll(texts).isEmpty() and back.count() == events.count()


def test_replay_time_layouts(spark):
    texts = ["2019-10-01 00:00:01 UTC", " 2019-10-01T00:00:01+00:00", "2019-10-01T02:00:01+02:00", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in df.select(F.unix_seconds(parse_replay_time(F.col("t")))).collect()]
    assert found == [1569888001] * 3 + [None]


def test_out_of_order_and_ticks(spark):
    rows = [(0, 0, 0), (1, 10, 50), (2, 20, 20), (3, 30, 30), (4, 60, 60), (5, 60, 60)]
    df = spark.createDataFrame(rows, "event_id bigint, e bigint, s bigint").select(
        "event_id",
        F.timestamp_seconds("e").alias("event_time"),
        F.timestamp_seconds("s").alias("send_time"),
    )
    for chunks in (None, 3):
        flagged = perturb.out_of_order_flag(df, chunks=chunks).orderBy("event_id").collect()
        assert [r["out_of_order"] for r in flagged] == [False, True, False, False, False, False]
        order = perturb.ordered_dispatch(df, chunks=chunks).orderBy("dispatch_position").collect()
        assert [r["event_id"] for r in order] == [0, 2, 3, 1, 4, 5]
    ticks = perturb.replay_tick(df, 10.0, 1.0).orderBy("event_id").collect()
    assert [r["tick"] for r in ticks] == [1, 6, 3, 4, 7, 7]


def test_no_delay_without_probability(spark, sf_dir):
    from clickloom.sources.fixtures import clickstream

    rows = perturb.perturb_delay(clickstream(spark, sf_dir), 0.0, 5.0)
    assert rows.where("delayed OR send_time <> event_time").isEmpty()


def test_bounded_sample_needs_enough_rows(spark):
    df = spark.range(10).withColumnRenamed("id", "event_id")
    assert perturb.bounded_sample(df, 10).count() == 10
    with pytest.raises(ValueError):
        perturb.bounded_sample(df, 11)


def test_gates(spark):
    df = spark.createDataFrame([(1, "a"), (1, None)], "x int, y string")
    assert quality.expect_row_count(df, 2) == 2
    quality.expect_columns(df, ["x", "y"])
    for check in (
        lambda: quality.expect_row_count(df, 3),
        lambda: quality.expect_row_count(df.limit(0)),
        lambda: quality.expect_columns(df, ["y", "x"]),
        lambda: quality.expect_column_subset(df, ["x", "z"]),
        lambda: quality.expect_artifacts({"ok": df, "none": df.limit(0)}),
    ):
        with pytest.raises(quality.QualityError):
            check()
    assert [tuple(r) for r in quality.unique_violations(df, ["x"]).collect()] == [(1, 2)]
    nulls = {r["column_name"]: r["null_count"] for r in quality.null_violations(df, ["x", "y"]).collect()}
    assert nulls == {"x": 0, "y": 1}
    described = [tuple(r) for r in quality.describe_table(df).collect()]
    assert described == [("x", "int", True), ("y", "string", True)]


def test_empty_split_is_refused(spark):
    counts = spark.createDataFrame([("train", 5), ("test", 0)], "split string, row_count bigint")
    with pytest.raises(quality.QualityError):
        quality.expect_split_nonempty(counts)


def test_session_features_by_hand(spark):
    rows = [
        ("2024-01-07 10:00:00", "view", 5, "b", None, "s"),
        ("2024-01-07 10:00:40", "cart", 5, "a", "c", "s"),
        ("2024-01-07 10:01:00", "purchase", 5, None, "c", "s"),
        ("2024-01-08 09:00:00", "cart", 6, None, None, "t"),
        ("2024-01-08 09:00:00", "view", 7, None, None, None),
    ]
    df = spark.createDataFrame(
        rows, "t string, event_type string, user_id bigint, brand string, category_code string, user_session string"
    ).withColumns(
        {
            "event_time": F.col("t").cast("timestamp"),
            "product_id": F.lit(1),
            "category_id": F.lit(1),
            "price": F.lit(1),
        }
    )
    found = {r["user_session"]: r for r in sessions.session_features(sessions.staging_events(df)).collect()}
    assert set(found) == {"s", "t"}
    s, t = found["s"], found["t"]
    assert (s.brand, s.category_code, s.converted, s.day_of_week, s.hour_of_day) == ("a", "c", 1, 0, 10)
    assert (s.session_duration_seconds, s.seconds_to_first_cart) == (60, 40)
    assert (t.brand, t.converted, t.seconds_to_first_cart, t.view_count) == ("unknown", 0, None, 0)


def test_distinct_sessions_with_unusual_and_missing_values(spark):
    rows = [("view", "a"), ("view", "a"), ("view", "b"), ("cart", None), ("odd", "a"), ("odd", "c"), (None, "a")]
    df = spark.createDataFrame(rows, "event_type string, user_session string")
    found = {r["event_type"]: r["session_count"] for r in sessions.distinct_sessions_by_type(df).collect()}
    assert found == {"view": 2, "cart": 0, "odd": 2, None: 1}
