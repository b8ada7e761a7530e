"""Streams against their batch twins: order, lateness, closing, restart and routing."""

import random
import re
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clickloom.operators import botrate, lifecycle, quality, validate
from clickloom.schema import EVENT_COLUMNS, INTERVAL_STATISTICS
from clickloom.session import fresh_path
from clickloom.sources.fixtures import SENTINEL, clickstream
from clickloom.sources import store, upserts
from clickloom.sources.upserts import compact_upserts, read_upserts, upsert_sink
from clickloom.streaming import routes
from clickloom.streaming import sessions as stream

TABLE = {name: [float(50 * p) for p in range(101)] for name in INTERVAL_STATISTICS}
TIMEOUT_MS = 60_000
START = datetime(2024, 1, 1)
COLUMNS = stream.UPDATE_COLUMNS


def add_file(spark, folder, rows):
    """One more file of (session, seconds) events, in the order given."""
    frame = pd.DataFrame(
        [(key, START + timedelta(seconds=s)) for key, s in rows], columns=["user_session", "event_time"]
    )
    schema = "user_session string, event_time timestamp"
    spark.createDataFrame(frame, schema).coalesce(1).write.mode("append").parquet(folder)


def end(spark, folder):
    for day in (36_500, 36_501):
        add_file(spark, folder, [(SENTINEL, day * 86_400)])


def scored(spark, folder, out, checkpoint):
    events = (
        spark.readStream.schema("user_session string, event_time timestamp")
        .option("maxFilesPerTrigger", 1)
        .parquet(folder)
    )
    query = stream.score_sessions_stream(events, TABLE, out, checkpoint, TIMEOUT_MS, available_now=True)
    query.awaitTermination()
    return query


def gauges(spark, out):
    return stream.session_gauges(spark, out).first().asDict()


def rows_of(spark, out, status):
    found = stream.stored_updates(spark, out).where(F.col("session_status") == status)
    return found.where(F.col("user_session") != SENTINEL).select(*COLUMNS)


def twin(spark, rows, function):
    add = fresh_path(spark, "twin")
    add_file(spark, add, rows)
    found = function(spark.read.parquet(add), TABLE, TIMEOUT_MS)
    times = {c: F.col(c).cast("timestamp") for c in ("last_event_time", "closed_at")}
    return found.withColumns(times).select(*COLUMNS)


def same(left, right):
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


@pytest.fixture(scope="module")
def shuffled():
    """In-bound disorder: every arrival is at most 4 s behind the newest one before it."""
    rng = random.Random(4)
    events = [(f"k{rng.randrange(12)}", s + rng.random()) for s in range(0, 1_800, 3)]
    arrivals = sorted(events, key=lambda event: event[1] + rng.random() * 4)
    return [arrivals[i : i + 120] for i in range(0, len(arrivals), 120)]


def test_disorder_and_restart(spark, shuffled):
    """Stop after three files and resume from the checkpoint: same rows as the batch twin."""
    folder, out, checkpoint = (fresh_path(spark, n) for n in ("in", "out", "checkpoint"))
    for rows in shuffled[:3]:
        add_file(spark, folder, rows)
    scored(spark, folder, out, checkpoint)
    held = gauges(spark, out)
    assert held["active_sessions"] > 0 and held["retained_events"] > 0 and held["late_events"] == 0
    for rows in shuffled[3:]:
        add_file(spark, folder, rows)
    end(spark, folder)
    scored(spark, folder, out, checkpoint)
    everything = [row for rows in shuffled for row in rows]
    assert same(rows_of(spark, out, "active"), twin(spark, everything, lifecycle.running_session_score))
    assert same(rows_of(spark, out, "closed"), twin(spark, everything, lifecycle.batch_session_lifecycle))
    assert rows_of(spark, out, "late").isEmpty()

    updates = stream.read_session_updates(spark, out)
    target = fresh_path(spark, "metrics")
    writer = stream.bot_rate_stream(updates, "1 minute").writeStream.format("parquet")
    writer = writer.option("path", target).option("checkpointLocation", fresh_path(spark, "c"))
    routes.triggered(writer, available_now=True).start().awaitTermination()
    expected = botrate.bot_rate_windows(rows_of(spark, out, "active"), "1 minute")
    found = spark.read.parquet(target).where(F.year("window_start") == 2024)
    average = {"avg_bot_score": F.round("avg_bot_score", 9)}
    assert same(found.select(*expected.columns).withColumns(average), expected.withColumns(average))


def test_late_events_are_dropped_and_counted(spark):
    folder, out, checkpoint = (fresh_path(spark, n) for n in ("in", "out", "checkpoint"))
    add_file(spark, folder, [("a", 23), ("a", 32), ("a", 29)])
    add_file(spark, folder, [("b", 50)])
    add_file(spark, folder, [("a", 20), ("a", 30), ("a", 31), ("b", 51)])
    end(spark, folder)
    scored(spark, folder, out, checkpoint)
    kept = [("a", 23), ("a", 29), ("a", 32), ("b", 50), ("b", 51)]
    assert same(rows_of(spark, out, "active"), twin(spark, kept, lifecycle.running_session_score))
    late = rows_of(spark, out, "late").collect()
    assert [(r["user_session"], r["event_count"]) for r in late] == [("a", 3)]
    assert gauges(spark, out)["late_events"] == 3


def test_steps_of_any_size_and_repeats(spark, shuffled):
    """The same updates however the events are cut into batches; a batch that comes again changes nothing."""
    events = [row for rows in shuffled for row in rows]
    schema = "user_session string, event_ms long"
    frame = [(key, int(s * 1000)) for key, s in sorted(events, key=lambda e: e[1])]
    results = []
    for size in (7, 150, len(frame)):
        out = fresh_path(spark, "steps")
        parts = [frame[k : k + size] for k in range(0, len(frame), size)] if size > 7 else [frame[:7], frame[7:]]
        for number, part in enumerate([*parts, [("z", 10**10)]]):
            batch = spark.createDataFrame(part, schema)
            stream.score_batch(batch, number, out, TABLE, TIMEOUT_MS)
            if number == 1:
                stream.score_batch(batch.limit(1), number, out, TABLE, TIMEOUT_MS)
        results.append(stream.stored_updates(spark, out).where("user_session <> 'z'"))
        assert gauges(spark, out) == {"active_sessions": 1, "retained_events": 1, "late_events": 0}
    assert results[0].count() > len(frame)
    assert same(results[0], results[1]) and same(results[0], results[2])


def test_a_step_runs_without_python_and_shuffles_once(spark):
    events = spark.range(10).selectExpr("cast(id as string) user_session", "id event_ms")
    none = spark.createDataFrame([], stream.STATE_SCHEMA)
    rows = stream.advance_sessions(events.where("event_ms > 0"), none, none, 0, 5, TABLE)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert plan.count("Exchange hashpartitioning(user_session") <= 2  # the second one counts late events


def test_old_state_is_deleted(spark):
    import os

    out = fresh_path(spark, "versions")
    for number in range(5):
        batch = spark.createDataFrame([("a", number * 1000), ("b", number * 1000 + 1)], "user_session string, event_ms long")
        stream.score_batch(batch, number, out, TABLE, TIMEOUT_MS)
    left = {v: sorted(n for n in os.listdir(f"{out}/{v}") if n.startswith("kind=")) for v in os.listdir(out) if v.startswith("batch=")}
    assert [v for v, kinds in sorted(left.items()) if "kind=waiting" in kinds] == [f"batch={n:012d}" for n in (3, 4)]


def test_session_edges(spark):
    """Gap at the timeout, just over it, repeated times and a key used again after closing."""
    folder, out, checkpoint = (fresh_path(spark, n) for n in ("in", "out", "checkpoint"))
    first = [("edge", 0), ("edge", 60), ("over", 0), ("over", 60.001), ("same", 5), ("same", 5), ("again", 0)]
    second = [("again", 500), ("again", 510)]
    add_file(spark, folder, first)
    add_file(spark, folder, [("tick", 400)])
    add_file(spark, folder, second)
    end(spark, folder)
    scored(spark, folder, out, checkpoint)
    everything = [*first, ("tick", 400), *second]
    assert same(rows_of(spark, out, "active"), twin(spark, everything, lifecycle.running_session_score))
    closed = rows_of(spark, out, "closed")
    assert same(closed, twin(spark, everything, lifecycle.batch_session_lifecycle))
    counts = {r["user_session"]: r["count"] for r in closed.groupBy("user_session").count().collect()}
    assert counts == {"edge": 1, "over": 2, "same": 1, "again": 2, "tick": 1}


def test_upserts_survive_retries_and_compaction(spark):
    target = fresh_path(spark, "upserts")

    def batch(rows):
        return spark.createDataFrame(rows, "k string, v int, note string")

    upsert_sink(batch([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")]), 0, target, ["k"], ["v"])
    upsert_sink(batch([("b", 9, "lost")]), 1, target, ["k"], ["v"])
    upsert_sink(batch([("b", 5, "kept"), ("c", 1, "n")]), 1, target, ["k"], ["v"])

    def current(df):
        return sorted(tuple(r) for r in df.collect())

    expected = [("a", 2, "y"), ("b", 5, "kept"), ("c", 1, "n")]
    assert current(read_upserts(spark, target, ["k"])) == expected
    assert current(compact_upserts(spark, target, ["k"])) == expected
    upsert_sink(batch([("b", 7, "again")]), 1, target, ["k"], ["v"])  # merged already, so it counts as done
    upsert_sink(batch([("a", 0, "newest")]), 2, target, ["k"], ["v"])
    assert current(read_upserts(spark, target, ["k"])) == [("a", 0, "newest"), *expected[1:]]


def test_readers_keep_their_generation_while_runs_merge(spark):
    target = fresh_path(spark, "runs")
    for n in range(9):
        rows = [(f"k{n % 4}", n), ("same", n)]
        upsert_sink(spark.createDataFrame(rows, "k string, v int"), n, target, ["k"], ["v"])
        if n == 6:
            pinned = upserts.current_generation(spark, target)
            opened = read_upserts(spark, target, ["k"], ["v"], at=pinned)
            before = sorted(map(tuple, opened.collect()))
    assert sorted(map(tuple, read_upserts(spark, target, ["k"], ["v"]).collect())) == [
        ("k0", 8), ("k1", 5), ("k2", 6), ("k3", 7), ("same", 8)
    ]
    now = upserts.current_generation(spark, target)
    assert sorted(run.level for run in now.runs) == [0, 1, 1] and now.last_batch == 8
    assert before == [("k0", 4), ("k1", 5), ("k2", 6), ("k3", 3), ("same", 6)]
    upserts.reclaim(spark, target, kept=1)
    assert set(store.names_in(spark, f"{target}/_runs")) == {run.name for run in now.runs}


def test_writers_that_meet_both_win(spark):
    """A commit between reading and writing a manifest makes the later one start again."""
    target = fresh_path(spark, "meet")
    upsert_sink(spark.createDataFrame([("a", 1)], "k string, v int"), 0, target, ["k"], ["v"])
    tries = []

    def change(now):
        tries.append(now.generation)
        if len(tries) == 1:
            upsert_sink(spark.createDataFrame([("b", 2)], "k string, v int"), 1, target, ["k"], ["v"])
        return upserts.Manifest(0, now.last_batch, now.runs)

    done = upserts._commit(spark, target, change)
    assert len(tries) == 2 and done.generation == tries[1] + 1
    assert sorted(map(tuple, read_upserts(spark, target, ["k"], ["v"]).collect())) == [("a", 1), ("b", 2)]


def test_validation_routes_each_record_once_across_restarts(spark, sf_dir):
    folder, checkpoint = fresh_path(spark, "raw"), fresh_path(spark, "checkpoint")
    clean, dlq = fresh_path(spark, "clean"), fresh_path(spark, "dlq")
    raw = validate.as_payload(clickstream(spark, sf_dir))
    for part in raw.randomSplit([0.5, 0.5], seed=2):
        part.coalesce(1).write.mode("append").text(folder)
        source = routes.stream_source_json(spark, "text", {"path": folder})
        query = routes.validation_stream(
            source, routes.batch_folder_writer(clean), routes.batch_folder_writer(dlq), checkpoint,
            available_now=True,
        )
        query.awaitTermination()
    accepted, rejected = spark.read.parquet(clean), spark.read.parquet(dlq)
    assert quality.reconcile(raw, accepted, rejected).first()["balanced"]
    assert {r[0] for r in rejected.select("failure_reason").distinct().collect()} == {"unsupported event_type"}
    assert same(accepted.select(*EVENT_COLUMNS), validate.route(raw)[0])


def test_archive_layout(spark, sf_dir):
    folder, path = fresh_path(spark, "clean"), fresh_path(spark, "archive")
    clean = validate.route(validate.as_payload(clickstream(spark, sf_dir)))[0]
    clean.write.parquet(folder)
    source = spark.readStream.schema(clean.schema).parquet(folder)
    routes.archive_stream(source, path, fresh_path(spark, "c"), available_now=True).awaitTermination()
    (batch,) = [name for name in store.names_in(spark, path) if name.startswith("batch=")]
    dates = [name for name in store.names_in(spark, f"{path}/{batch}") if name.startswith("event_date=")]
    assert dates[0] == "event_date=2024-01-01" and len(dates) == 30
    whole = routes.read_archive(spark, path)
    day = whole.where("event_date = '2024-01-03'")
    assert "PartitionFilters: [" in day._jdf.queryExecution().executedPlan().toString()
    assert whole.count() == clean.count()
    marks = {r["event_date"]: r["closed_by"] for r in routes.closed_dates(spark, path).collect()}
    assert len(marks) == 28 and set(marks.values()) == {0}


def test_archive_packs_by_bytes_and_once(spark):
    """One file for a small date, several for a large one; a repeated batch adds nothing."""
    path = fresh_path(spark, "archive")

    def rows(day, n):
        return [(f"2024-01-{day:02} 00:00:00 UTC", "view", str(k), "1", None, None, "1.0", "2", "s") for k in range(n)]

    batch = spark.createDataFrame(rows(1, 2000) + rows(5, 3), ", ".join(f"{c} string" for c in EVENT_COLUMNS)).repartition(8)
    for _ in range(2):
        routes.archive_batch(batch, 0, path, 20_000, 1)
    files = {day: len([f for f in store.names_in(spark, f"{path}/batch={0:012d}/event_date=2024-01-{day}") if f.endswith(".parquet")])
             for day in ("01", "05")}
    assert 2 <= files["01"] <= 5 and files["05"] == 1 and routes.read_archive(spark, path).count() == 2003
    assert [r["event_date"] for r in routes.closed_dates(spark, path).collect()] == ["2024-01-01"]
    routes.archive_batch(spark.createDataFrame(rows(1, 1), batch.schema), 1, path, 20_000, 1)
    assert routes.read_archive(spark, path).count() == 2004 and routes.closed_dates(spark, path).count() == 1


def test_failing_stream_restarts_from_its_checkpoint(spark):
    from pyspark.errors import StreamingQueryException

    from clickloom.streaming.supervise import run_with_restarts

    folder, checkpoint, out = (fresh_path(spark, n) for n in ("in", "checkpoint", "out"))
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).coalesce(1).write.mode("append").parquet(folder)
    failures = []

    def start(always=False):
        def write(batch, batch_id):
            if batch_id == 1 and (always or len(failures) < 2):
                failures.append(batch_id)
                raise RuntimeError("lost")
            batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

        source = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(folder)
        writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()

    with pytest.raises(StreamingQueryException):
        run_with_restarts(lambda: start(always=True), attempts=1)
    run_with_restarts(start, attempts=3, delay_seconds=0.1)
    assert len(failures) == 2
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(30))


def test_repeated_times_need_no_aggregate(spark):
    """They are found by the windows; only late events are aggregated."""
    events = spark.createDataFrame([("a", 0), ("a", 0), ("a", 1000), ("a", 1000), ("b", 7)], "user_session string, event_ms long")
    none = spark.createDataFrame([], stream.STATE_SCHEMA)
    step = stream.advance_sessions(events, none, none, stream.NEVER, 5000, TABLE, TIMEOUT_MS)
    plan = step._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Aggregate\(keys=\[user_session#\d+L?, event_ms#", plan)
    found = step.where("session_status = 'active'").select("user_session", "event_ms", "event_count", "interval_count")
    assert sorted(map(tuple, found.collect())) == [("a", 0, 1, 0), ("a", 1000, 2, 1), ("b", 7, 1, 0)]
