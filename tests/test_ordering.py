"""Ranged sequence operators and keys of any size against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clickloom.functions.search import count_at_or_below
from clickloom.operators import intervals, lifecycle, ordering, spans
from clickloom.operators import percentiles
from clickloom.operators.percentiles import exact_percentiles
from clickloom.schema import INTERVAL_STATISTICS


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one key, one key of copies of a single time, and many small."""
    rng = np.random.default_rng(5)
    n = 6_000
    key = np.where(
        rng.random(n) < 0.34, "hot", np.where(rng.random(n) < 0.2, "copies", rng.integers(0, 300, n).astype(str))
    )
    ms = rng.integers(0, 40_000_000, n)
    ms[key == "copies"] = 12_345
    frame = pd.DataFrame({"id": np.arange(n), "user_session": key, "ms": 1_700_000_000_000 + ms})
    df = spark.createDataFrame(frame)
    return frame, df.withColumn("event_time", F.timestamp_millis("ms")).repartition(6)


def test_lookup_tree(spark):
    bounds = [-1.5, 0.0, 0.0, 2.0, float("inf")]
    values = [-2.0, -1.5, 0.0, 1.0, 2.0, 1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = [r[0] for r in df.select(count_at_or_below("v", bounds)).collect()]
    assert found == [sum(b <= v for b in bounds) for v in values]


def test_lookup_tree_on_pairs(spark):
    bounds = [("a", 3), ("b", 1), ("it's", 0)]
    values = [("a", 2), ("a", 3), ("b", 0), ("it's", 5)]
    df = spark.createDataFrame(values, "k string, n bigint")
    found = [r[0] for r in df.select(count_at_or_below("struct(k, n)", bounds)).collect()]
    assert found == [0, 1, 1, 3]


def test_positions_and_slices(spark, skewed):
    frame, df = skewed
    placed = ordering.row_positions(df, ["ms", "id"], "position", chunks=7).select("id", "position")
    order = frame.sort_values(["ms", "id"]).reset_index(drop=True)
    assert dict(map(tuple, placed.collect())) == {row.id: i for i, row in order.iterrows()}
    for start, rows in [(0, 10), (1_234, 2_000), (5_990, 100), (0, None)]:
        part = ordering.row_slice(df, ["ms", "id"], start, rows)
        stop = None if rows is None else start + rows
        assert sorted(r.id for r in part.collect()) == sorted(order["id"][start:stop])


def test_slices_are_pushed_down(spark, tmp_path):
    values = [-(2**62), -5, -4, 0, 7, 2**40, 2**62, *range(100, 5000, 3)]
    spark.createDataFrame([(v,) for v in values], "id long").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for start, rows in [(0, 3), (2, 4), (len(values) - 2, 9), (50, 1000), (9999, 5)]:
        part = ordering.row_slice(df, ["id"], start, rows)
        assert sorted(r.id for r in part.collect()) == sorted(values)[start : start + rows]
    plan = ordering.row_slice(df, ["id"], 50, 1000)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id" in plan and "LessThanOrEqual(id" in plan and "Exchange" not in plan


def test_running_operations(spark, skewed):
    frame, df = skewed
    chunked = ordering.with_chunks(df, ["user_session", "ms", "id"], chunks=9)
    found = ordering.running_in_order(
        chunked, ["user_session"], ["ms", "id"],
        {"total": ("sum", "id"), "low": ("min", "id"), "high": ("max", "id")},
    ).toPandas().sort_values("id")
    ordered = frame.sort_values(["ms", "id"])
    groups = ordered.groupby("user_session")["id"]
    ordered = ordered.assign(total=groups.cumsum(), low=groups.cummin(), high=groups.cummax())
    ordered = ordered.sort_values("id")
    for name in ("total", "low", "high"):
        assert found[name].tolist() == ordered[name].tolist()


@pytest.mark.parametrize("rows", [1, 500, 1 << 16])
def test_intervals_of_any_key(spark, skewed, monkeypatch, rows):
    monkeypatch.setattr(spans, "RANGE_ROWS", rows)
    frame, df = skewed
    ordered = frame.sort_values(["user_session", "ms"])
    expected = sorted(ordered.groupby("user_session")["ms"].diff().dropna().tolist())
    for tiebreak in ("id", None):
        found = intervals.click_intervals(df, tiebreak=tiebreak)
        assert found.count() == len(frame)
        got = sorted(r[0] for r in found.select("click_interval_ms").dropna().collect())
        assert got == expected


def test_statistics_of_any_key(spark, skewed, monkeypatch):
    frame, df = skewed
    gaps = frame.sort_values(["user_session", "ms"]).assign(
        gap=lambda f: f.groupby("user_session")["ms"].diff()
    ).dropna()
    expected = gaps.groupby("user_session")["gap"].agg(["count", "mean", "min", "max", "std"])
    expected = expected.sort_index().astype("float64")
    results = []
    for rows in (1, 600, 1 << 16):
        monkeypatch.setattr(spans, "RANGE_ROWS", rows)
        found = intervals.session_interval_stats(df).toPandas()
        results.append(found.set_index("user_session").sort_index())
    for found in results:
        pd.testing.assert_frame_equal(results[0], found, check_exact=True)
    np.testing.assert_allclose(
        results[0].astype("float64").to_numpy(), expected.to_numpy(), rtol=1e-9
    )


def _plain_sessions(frame, timeout):
    """Every session as ``(key, number, [times])``, from one pass over each key's times."""
    found = []
    for key, times in frame.groupby("user_session")["ms"]:
        number, current = 0, []
        for time in sorted(set(times.tolist())):
            if not current or time - current[-1] > timeout:
                number, current = number + 1, []
                found.append((key, number, current))
            current.append(time)
    return found


def test_busy_key_splits_inside_one_hour(spark, monkeypatch):
    """Half of all events in one key and one hour: several spans of like size; other keys stay whole."""
    monkeypatch.setattr(spans, "RANGE_ROWS", 1_000)
    rng = np.random.default_rng(2)
    key = np.where(rng.random(16_000) < 0.5, "m", rng.integers(0, 900, 16_000).astype(str))
    df = spark.createDataFrame(pd.DataFrame({"k": key, "t": rng.integers(0, 3_600_000, 16_000)}))
    cuts = spans.cut_points(df, "k", "t")
    assert [row["k"] for row in cuts.collect()] == ["m"]
    sizes = spans.in_spans(df, "k", "t", cuts).groupBy("k", spans.SPAN).count().toPandas()
    own = sizes[sizes["k"] == "m"]["count"]
    assert len(own) >= 3 and own.max() < 4_500 and set(sizes[sizes["k"] != "m"][spans.SPAN]) == {0}
    assert spans.cut_points(df.where("k <> 'm'"), "k", "t") is None


@pytest.mark.parametrize("range_rows", [1, 1 << 16])
@pytest.mark.parametrize("timeout", [60_000, 2_000_000])
def test_scores_of_any_key(spark, skewed, monkeypatch, timeout, range_rows):
    monkeypatch.setattr(spans, "RANGE_ROWS", range_rows)
    frame, df = skewed
    table = {name: [float(v) for v in range(0, 2_020_000, 20_000)] for name in INTERVAL_STATISTICS}
    expected, running = {}, {}
    for key, number, times in _plain_sessions(frame, timeout):
        for upto in range(1, len(times) + 1):
            gaps = np.diff(times[:upto])
            running[key, number, upto] = (
                times[upto - 1],
                gaps.mean() if upto > 1 else None,
                gaps.min() if upto > 1 else None,
                gaps.std(ddof=1) if upto > 2 else None,
            )
        expected[key, number] = (len(times), running[key, number, len(times)])

    def values(row):
        time = int(pd.Timestamp(row.last_event_time).value // 1_000_000)
        return time, row.mean_click_interval_ms, row.min_click_interval_ms, row.sd_click_interval_ms

    def same(found, wanted):
        return all(
            (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9))
            for a, b in zip(found, wanted, strict=True)
        )

    rows = lifecycle.running_session_score(df, table, timeout).collect()
    assert len(rows) == len(running)
    for r in rows:
        assert same(values(r), running[r.user_session, r.session_seq, r.event_count])
    rows = lifecycle.batch_session_lifecycle(df, table, timeout).collect()
    assert len(rows) == len(expected)
    for r in rows:
        count, wanted = expected[r.user_session, r.session_seq]
        assert r.event_count == count and r.interval_count == count - 1 and same(values(r), wanted)


@pytest.mark.parametrize("function", [intervals.session_interval_stats, intervals.click_intervals])
def test_empty_tables(spark, function):
    empty = spark.createDataFrame([], "user_session string, event_time timestamp")
    assert function(empty).count() == 0


def test_percentiles(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"a": rng.exponential(5, 3_001), "b": np.repeat([1.0, 2.0, 7.0], [1000, 2000, 1])})
    frame.loc[::10, "a"] = np.nan
    df = spark.createDataFrame(frame).select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("a", "b")],
        F.lit(None).cast("double").alias("c"),
    )
    fractions = [p / 100 for p in range(101)]
    found = exact_percentiles(df, ["a", "b", "c"], fractions)
    result = {r["statistic"]: r["percentiles"] for r in found.collect()}
    for name in ("a", "b"):
        expected = np.quantile(frame[name].dropna(), fractions)
        np.testing.assert_allclose(result[name], expected, rtol=1e-12)
    assert result["c"] is None


@pytest.mark.parametrize("small", [1 << 16, 0])
def test_percentiles_of_odd_values(spark, monkeypatch, small):
    """Negative and tiny values, powers of two and their neighbours, ties, infinities; every step of bits."""
    monkeypatch.setattr(percentiles, "SMALL", small)
    rng = np.random.default_rng(5)
    near = [np.nextafter(2.0**k, d) for k in range(-30, 40, 7) for d in (0, np.inf)] + [2.0**k for k in range(-30, 40, 7)]
    values = np.concatenate([near, -np.array(near), [0.0] * 40, [5e-324, -5e-324, 1.7e308, np.inf, -np.inf],
                             1 + rng.random(3000) * 1e-9, rng.normal(0, 1e6, 500), [3.25] * 700])
    df = spark.createDataFrame(pd.DataFrame({"a": values})).repartition(5)
    ranks = set(range(0, len(values), 13)) | {0, len(values) - 1}
    n, found = percentiles.select_ranks(df, ["a"], lambda n: ranks)["a"]
    assert n == len(values)
    assert found == {rank: np.sort(values)[rank] for rank in ranks}


def test_percentiles_with_nan(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": [1.0, 2.0, 3.0]})).union(spark.sql("SELECT double('NaN') a FROM range(3)"))
    _, found = percentiles.select_ranks(df, ["a"], lambda n: {0, 2, 3, 5})["a"]
    assert (found[0], found[2]) == (1.0, 3.0) and np.isnan(found[3]) and np.isnan(found[5])


def test_percentiles_fold_before_the_shuffle(spark):
    """One small aggregate a pass: no sort, no range exchange."""
    df = spark.range(1000).select(F.sqrt("id").alias("value"), F.lit("a").alias("statistic"))
    df = df.withColumn("key", percentiles.ordered_long(F.col("value")))
    counted = df.groupBy("statistic", F.shiftright("key", 45).alias("part")).agg(F.count(F.lit(1)), F.min("value"), F.max("value"))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan and "rangepartitioning" not in plan
