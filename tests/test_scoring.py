"""The worked session, lookup and histogram edges, evaluation and dashboards."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.functions.scoring import bot_score, percentile_rank_lookup, sample_sd, score_bucket, square
from clickloom.operators import botrate, evaluate, intervals, lifecycle
from clickloom.plans import dashboards
from clickloom.schema import INTERVAL_STATISTICS, SESSION_TIMEOUT_MS

GOLDEN = [9, 16, 23, 29, 32, 36, 47, 49, 54, 58]
LINEAR = {name: [float(100 * p) for p in range(101)] for name in INTERVAL_STATISTICS}


def events_at(spark, millis, session="s"):
    df = spark.createDataFrame([(session, int(ms)) for ms in millis], "user_session string, ms bigint")
    return df.withColumn("event_time", F.timestamp_millis("ms"))


@pytest.fixture(scope="module")
def golden(spark):
    start = datetime(2019, 10, 18, 20, 14)
    rows = [("s", (start + timedelta(seconds=s)).isoformat(sep=" ")) for s in GOLDEN]
    df = spark.createDataFrame(rows, "user_session string, t string")
    return df.withColumn("event_time", F.col("t").cast("timestamp"))


def test_golden_intervals(golden):
    found = intervals.click_intervals(golden).orderBy("event_time").collect()
    expected = [None, 7000, 7000, 6000, 3000, 4000, 11000, 2000, 5000, 4000]
    assert [r["click_interval_ms"] for r in found] == expected


def test_golden_session(golden):
    row = lifecycle.batch_session_lifecycle(golden, LINEAR).first()
    assert (row["event_count"], row["interval_count"]) == (10, 9)
    assert round(row["mean_click_interval_ms"], 1) == 5444.4
    assert row["min_click_interval_ms"] == 2000
    assert round(row["sd_click_interval_ms"]) == 2698
    assert row["closed_at"] == datetime(2019, 10, 18, 21, 41, 58)


def test_golden_running_state(golden):
    rows = lifecycle.running_session_score(golden, LINEAR).orderBy("event_count").collect()
    assert [r["event_count"] for r in rows] == list(range(1, 11))
    assert (rows[0]["mean_click_interval_ms"], rows[0]["bot_score"]) == (None, 0.0)
    assert (rows[1]["mean_click_interval_ms"], rows[1]["sd_click_interval_ms"]) == (7000.0, None)
    third = rows[2]
    assert (third["mean_click_interval_ms"], third["sd_click_interval_ms"]) == (7000.0, 0.0)
    assert third["bot_score"] == pytest.approx((0.30 + 0.30 + 1.0) / 3)


@pytest.mark.parametrize("extra, sessions", [(0, 1), (1, 2)])
def test_gap_at_the_timeout(spark, extra, sessions):
    times = [0, SESSION_TIMEOUT_MS + extra]
    rows = lifecycle.batch_session_lifecycle(events_at(spark, times), LINEAR).collect()
    assert len(rows) == sessions


def test_repeated_times_do_not_count(spark):
    rows = lifecycle.batch_session_lifecycle(events_at(spark, [0, 5, 5, 5, 9]), LINEAR).collect()
    assert [(r["event_count"], r["min_click_interval_ms"]) for r in rows] == [(3, 4.0)]
    offline = intervals.session_interval_stats(events_at(spark, [0, 5, 5, 5, 9])).first()
    assert (offline["interval_count"], offline["min_click_interval_ms"]) == (4, 0.0)


def test_current_scores_keep_the_reopened_session(spark):
    times = [0, 10, SESSION_TIMEOUT_MS * 3]
    as_of = SESSION_TIMEOUT_MS * 3 + 1
    cycle = lifecycle.batch_session_lifecycle(events_at(spark, times), LINEAR, as_of_ms=as_of)
    row = lifecycle.current_scores(cycle).first()
    assert (row["session_seq"], row["session_status"], row["closed_at"]) == (2, "active", None)


def test_rank_lookup_edges(spark):
    thresholds = [10.0, 20.0, 20.0, 30.0]
    values = [5.0, 10.0, 19.9, 20.0, 30.0, 99.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = [r[0] for r in df.select(percentile_rank_lookup("v", thresholds)).collect()]
    assert found == [0, 0, 0, 2, 3, 3]


def test_score_needs_all_statistics(spark):
    df = spark.createDataFrame([(1.0, 1.0, None), (0.0, 0.0, 0.0), (1e9, 1e9, 1e9)], "a double, b double, c double")
    found = [r[0] for r in df.select(bot_score("a", "b", "c", LINEAR)).collect()]
    assert found == [0.0, 1.0, 0.0]


def test_score_buckets(spark):
    scores = [0.0, 0.2, 0.6, 0.8, 1.0, -1.0, 0.19]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    found = [r[0] for r in df.select(score_bucket(F.col("s"))).collect()]
    assert found == [min(4, max(0, math.floor(s / 0.2))) for s in scores]


def test_exact_deviation(spark):
    base = 10**12
    values = [base, base + 1, base + 5]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").agg(
        F.count("v").alias("n"), F.sum("v").alias("t"), F.sum(square(F.col("v"))).alias("s")
    )
    found = df.select(sample_sd(F.col("n"), F.col("t"), F.col("s"))).first()[0]
    assert found == pytest.approx(np.std([0, 1, 5], ddof=1), rel=1e-12)


def test_empty_rates(spark):
    empty = spark.createDataFrame([], "bot_score double")
    row = botrate.bot_rate_result(botrate.bot_rate_accumulator(empty.groupBy())).first()
    assert (row["active_sessions"], row["bot_rate"], row["avg_bot_score"]) == (0, 0.0, 0.0)
    assert row["score_histogram"] == "0.0-0.2=0,0.2-0.4=0,0.4-0.6=0,0.6-0.8=0,0.8-1.0=0"


def brute_auc(labels, scores):
    pairs = [(a > b) + 0.5 * (a == b) for a, x in zip(scores, labels) if x for b, y in zip(scores, labels) if not y]
    return sum(pairs) / len(pairs)


@pytest.mark.parametrize("chunks", [None, 6])
def test_curve_metrics(spark, chunks):
    rng = np.random.default_rng(8)
    labels = (rng.random(400) < 0.3).astype(int)
    scores = np.round(rng.random(400) * 0.6 + labels * 0.3, 2)
    rows = [(int(a), float(b)) for a, b in zip(labels, scores)]
    df = spark.createDataFrame(rows, "converted int, score double")
    steps = evaluate.score_steps(df, chunks=chunks)
    assert evaluate.roc_auc(steps).first()[0] == pytest.approx(brute_auc(labels, scores), rel=1e-12)
    curve = evaluate.roc_curve(steps)
    assert curve.count() == len(set(scores)) + 1
    small = evaluate.downsample_curve(curve, 10, chunks=chunks).orderBy("fpr", "tpr").collect()
    assert len(small) == 10
    assert (small[0]["fpr"], small[-1]["fpr"], small[-1]["tpr"]) == (0.0, 1.0, 1.0)
    order = sorted(set(scores), reverse=True)
    gained, area = 0, 0.0
    for cut in order:
        hit = int(labels[scores >= cut].sum())
        area += (hit - gained) / labels.sum() * hit / int((scores >= cut).sum())
        gained = hit
    assert evaluate.average_precision(steps).first()[0] == pytest.approx(area, rel=1e-12)


def test_constant_and_one_sided_scores(spark):
    constant = spark.createDataFrame([(1, 0.0), (0, 0.0), (0, 0.0)], "converted int, score double")
    steps = evaluate.score_steps(constant)
    assert evaluate.roc_auc(steps).first()[0] == 0.5
    assert evaluate.average_precision(steps).first()[0] == pytest.approx(1 / 3)
    one_class = spark.createDataFrame([(1, 0.2), (1, 0.4)], "converted int, score double")
    steps = evaluate.score_steps(one_class)
    assert evaluate.roc_auc(steps).first()[0] is None
    guessed = one_class.withColumn("prediction", F.lit(False))
    metrics = {r["metric"]: r["value"] for r in evaluate.classification_metrics(evaluate.confusion_matrix(guessed)).collect()}
    assert metrics["accuracy"] == 0.0 and metrics["precision_true"] == 0.0
    assert metrics["balanced_accuracy"] == 0.0


def test_dashboards_without_rows(spark):
    metrics = spark.createDataFrame(
        [], "window_end timestamp, bot_rate double, active_sessions bigint, bot_sessions bigint, score_histogram string"
    )
    assert dashboards.latest_bot_rate(metrics).first()[0] == 0.0
    assert dashboards.latest_histogram(metrics).isEmpty()
    assert dashboards.bot_rate_series(metrics).isEmpty()
    scores = spark.createDataFrame([], "session_status string, bot_score double")
    assert dashboards.active_sessions(scores).first()[0] == 0
    assert dashboards.max_score(scores).first()[0] == 0.0


def test_rate_series_gaps_and_small_buckets(spark):
    rows = [
        ("2024-01-01 00:05:00", 200, 50),
        ("2024-01-01 00:15:00", 99, 99),
        ("2024-01-01 00:20:00", 100, 10),
    ]
    metrics = spark.createDataFrame(rows, "t string, active_sessions bigint, bot_sessions bigint").withColumn(
        "window_end", F.col("t").cast("timestamp")
    )
    series = dashboards.bot_rate_series(
        metrics, datetime(2024, 1, 1, 0, 2), datetime(2024, 1, 1, 0, 23)
    )
    rates = [r["bot_rate"] for r in series.orderBy("time").collect()]
    assert rates == [0.0, 0.25, 0.0, None, 0.1]
    averages = [r[1] for r in dashboards.bot_rate_moving_average(series, 3).orderBy("time").collect()]
    assert averages == pytest.approx([0.0, 0.125, 0.25 / 3, 0.125, 0.05])


@pytest.mark.parametrize("stretch", [3, 7, 4096])
def test_moving_average_across_stretches(spark, monkeypatch, stretch):
    """A halo wider than a stretch included; the spine is laid out in stretches too."""
    monkeypatch.setattr(dashboards, "STRETCH", stretch)
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=5 * k), 200, k * 7 % 200) for k in range(0, 60, 2)]
    metrics = spark.createDataFrame(rows, "window_end timestamp, active_sessions bigint, bot_sessions bigint")
    series = dashboards.bot_rate_series(metrics)
    rates = [r["bot_rate"] for r in series.orderBy("time").collect()]
    assert rates == [k * 7 % 200 / 200 if k % 2 == 0 else 0.0 for k in range(59)]
    averaged = dashboards.bot_rate_moving_average(series).orderBy("time")
    got = [r[1] for r in averaged.collect()]
    assert got == pytest.approx([sum(rates[max(0, k - 11) : k + 1]) / min(k + 1, 12) for k in range(59)])
    plan = averaged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") == 1  # the bounds of the range


def test_histogram_with_missing_parts(spark):
    rows = [(1, "0.0-0.2=1"), (2, "0.0-0.2=7,0.2-0.4=,0.4-0.6=x,0.8-1.0=3")]
    metrics = spark.createDataFrame(rows, "window_end int, score_histogram string")
    found = {r["bucket"]: r["sessions"] for r in dashboards.latest_histogram(metrics).collect()}
    assert found == {"0.0-0.2": 7, "0.2-0.4": 0, "0.4-0.6": 0, "0.6-0.8": 0, "0.8-1.0": 3}


def test_scoring_refuses_missing_thresholds(spark):
    from clickloom.operators.intervals import percentile_unpivot, thresholds_of
    from clickloom.schema import INTERVAL_STATISTICS

    columns = ", ".join(f"{name}_values array<double>" for name in INTERVAL_STATISTICS)
    row = spark.createDataFrame([([1.0] * 101, [2.0] * 101, [3.0] * 101, None)], columns)
    table = percentile_unpivot(row)
    assert table.count() == 101 and table.where("sd_click_interval_ms is null").count() == 101
    for missing in (table, percentile_unpivot(row.limit(0))):
        with pytest.raises(ValueError, match="sd_click_interval_ms"):
            thresholds_of(missing)


def test_equal_times_follow_the_tiebreak(spark):
    from clickloom.operators.intervals import click_intervals

    rows = [("a", 0, 9), ("a", 5, 3), ("a", 5, 1), ("a", 5, 2), ("a", 7, None), ("a", 7, 4)]
    events = spark.createDataFrame(rows, "user_session string, s long, n long").selectExpr(
        "user_session", "timestamp_seconds(s) AS event_time", "n"
    )
    found = {(r.n, r.click_interval_ms) for r in click_intervals(events, tiebreak="n").collect()}
    assert found == {(9, None), (1, 5000.0), (2, 0.0), (3, 0.0), (4, 2000.0), (None, 0.0)}


def test_blank_sessions_are_none_for_the_batch_twin(spark):
    from clickloom.functions.keys import named_session

    keys = spark.createDataFrame([("a",), ("",), (" \t",), (None,)], "k string")
    assert [r.k for r in keys.where(named_session("k")).collect()] == ["a"]
