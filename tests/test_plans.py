"""Sources, sinks and whole jobs."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from clickloom.operators import evaluate, model, quality, sessions
from clickloom.plans.conversion import build_features, train_and_evaluate
from clickloom.plans.reference_tables import build_reference, load_reference
from clickloom.schema import EVENT_COLUMNS, EVENT_SCHEMA, FEATURE_COLUMNS
from clickloom.session import fresh_path, materialize, work_dir
from clickloom.sources import files, sinks
from clickloom.sources.fixtures import clickstream


def part_files(path):
    return [n for n in os.listdir(path) if n.startswith("part-")]


def test_csv_schema_and_header(spark):
    path = fresh_path(spark, "csv")
    os.makedirs(path)
    with open(f"{path}/a.csv", "w") as file:
        file.write(",".join(EVENT_COLUMNS) + "\n")
        file.write("2019-10-01 00:00:00 UTC,view,1,2,,,3.5,4,s\n")
    files.check_csv_header(spark, path)
    row = files.read_events_csv(spark, path, partitions=2).first()
    assert (row["category_code"], str(row["price"]), row["user_session"]) == (None, "3.50", "s")
    with open(f"{path}/a.csv", "w") as file:
        file.write("event_time,event_type\n2019-10-01 00:00:00 UTC,view\n")
    with pytest.raises(quality.QualityError):
        files.check_csv_header(spark, path)


def test_merge_sizes(spark):
    source, small, large = (fresh_path(spark, n) for n in ("parts", "one", "many"))
    spark.range(50_000).repartition(6).write.parquet(source)
    assert sinks.merge_parquet_files(spark, source, small).count() == 50_000
    assert len(part_files(small)) == 1
    size = files.folder_bytes(spark, source)
    sinks.merge_parquet_files(spark, source, large, target_bytes=size // 3 + 1)
    assert len(part_files(large)) == 3


def test_merge_without_a_shuffle(spark, monkeypatch):
    """A task reads its share of the compressed parts, not of the rows laid out for a shuffle."""
    source, target = (fresh_path(spark, n) for n in ("parts", "merged"))
    spark.range(200_000).selectExpr("id", "id % 3 AS kind").repartition(24).write.parquet(source)
    size = files.folder_bytes(spark, source)
    monkeypatch.setattr(sinks, "folder_bytes", lambda *_: size)
    spark.sparkContext.setJobGroup("merge", "merge")
    merged = sinks.merge_parquet_files(spark, source, target, target_bytes=size // 4 + 1)
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(job) for job in tracker.getJobIdsForGroup("merge")]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs and all(len(job.stageIds) == 1 for job in jobs)
    assert len(part_files(target)) == 4 and merged.count() == 200_000 == merged.distinct().count()
    assert max(os.path.getsize(f"{target}/{name}") for name in part_files(target)) < size / 2


def test_row_groups(spark):
    import pyarrow.parquet as pq

    csv, target = fresh_path(spark, "csv"), fresh_path(spark, "parquet")
    events = spark.range(2_500).select(
        F.lit("2019-10-01 00:00:00 UTC").alias("event_time"), F.lit("view").alias("event_type"),
        *[F.col("id").alias(c) for c in ("product_id", "category_id")],
        F.lit("c").alias("category_code"), F.lit("b").alias("brand"), F.lit("1.00").alias("price"),
        F.col("id").alias("user_id"), F.lit("s").alias("user_session"),
    )
    events.coalesce(1).write.option("header", True).csv(csv)
    sinks.csv_to_parquet(spark, csv, target, rows_per_group=1_000)
    metadata = pq.ParquetFile(f"{target}/{part_files(target)[0]}").metadata
    assert [metadata.row_group(i).num_rows for i in range(metadata.num_row_groups)] == [1_000, 1_000, 500]


def test_artifacts_must_not_be_empty(spark):
    with pytest.raises(quality.QualityError):
        sinks.publish_artifacts({"nothing": spark.range(0)}, fresh_path(spark, "artifacts"))


def test_reference_round_trip(spark, sf_dir):
    events = clickstream(spark, sf_dir, "lifetime")
    base = fresh_path(spark, "reference")
    config = build_reference(events, base)
    thresholds, loaded = load_reference(spark, base)
    assert loaded == config
    assert config.source_row_count == events.count() and config.session_count == 15
    assert all(len(v) == 101 and v == sorted(v) for v in thresholds.values())
    with pytest.raises(quality.QualityError):
        build_reference(events.drop("user_id"), base)


def test_conversion_job(spark, sf_dir):
    base = fresh_path(spark, "conversion")
    events = clickstream(spark, sf_dir).select(*EVENT_COLUMNS)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS shop LOCATION '{base}/shop'")
    tables = {"events": "shop.events", "sessions": "shop.sessions", "features": f"{base}/features"}
    features = build_features(events, tables, expected_rows=events.count())
    assert features.columns == [*FEATURE_COLUMNS, "converted"]
    fitted = train_and_evaluate(features, f"{base}/ml", rounds=5)
    stored = {n: spark.read.parquet(f"{base}/ml/{n}") for n in (
        "metrics", "model_comparison", "confusion_matrix", "feature_importance", "roc_curve")}
    metrics = {r["metric"]: r["value"] for r in stored["metrics"].collect()}
    assert 0 <= metrics["roc_auc"] <= 1 and 0 <= metrics["accuracy"] <= 1
    assert stored["confusion_matrix"].count() == 4
    assert stored["model_comparison"].columns[0] == "model"
    shares = [r["importance"] for r in model.feature_importance(fitted).collect()]
    assert sum(shares) == pytest.approx(1.0) and shares == sorted(shares, reverse=True)
    _, test = sessions.train_test_split(features)
    scored = model.predict_sessions(fitted, test)
    assert scored.where("score < 0 OR score > 1").isEmpty()
    assert scored.count() == stored["confusion_matrix"].agg(F.sum("count")).first()[0]
    with pytest.raises(quality.QualityError):
        build_features(events, tables, expected_rows=1)


def test_equal_rows_train_as_weighted_ones(spark, monkeypatch):
    """Training rows grow with the combinations of features, not with the sessions; no row is lost."""
    stored = {}

    def keep(df, label):
        stored[label] = materialize(df, label)
        return stored[label]

    monkeypatch.setattr(model, "materialize", keep)
    kinds = spark.range(40).selectExpr(
        "concat('b', id % 4) AS brand", "IF(id % 5 = 0, NULL, concat('c', id % 5)) AS category_code",
        "CAST(id % 7 AS INT) AS day_of_week", "CAST(id % 24 AS INT) AS hour_of_day", "id AS view_count",
        "id % 3 AS cart_add_count", "CAST(id % 4 = 1 AS INT) AS converted", "100 * (id % 10) + 50 AS copies",
    )
    train = kinds.selectExpr("* EXCEPT (copies)", "explode(sequence(1, copies)) AS copy").drop("copy")
    fitted = model.train_conversion_model(train, rounds=2, units=100)
    rows = stored["training-rows"]
    assert 40 < rows.count() <= 40 + 100 and train.count() == 20_000
    weights = rows.agg(F.sum("_weight"), F.sum(F.col("label") * F.col("_weight")), F.max("_weight")).first()
    assert tuple(weights) == pytest.approx((20_000, train.agg(F.sum("converted")).first()[0], 190))
    assert fitted.prior == train.agg(F.avg("converted")).first()[0]
    plain = train.groupBy("brand").agg(((F.sum("converted") + 20 * fitted.prior) / (F.count("*") + 20)).alias("rate"))
    learned = {r["brand"]: r["brand_code"] for r in fitted.rates["brand"].collect()}
    assert learned == pytest.approx({r["brand"]: r["rate"] for r in plain.collect()})


def test_unseen_categories_share_a_code(spark):
    known = spark.createDataFrame([("b", "x"), ("a", "y")], "brand string, category_code string")
    other = spark.createDataFrame([("a", "q"), ("z", None)], "brand string, category_code string")
    coded = model.encode_categories(other, known).select("brand_code", "category_code_code")
    assert [tuple(r) for r in coded.collect()] == [(0.0, 2.0), (2.0, 2.0)]


def test_any_vocabulary_trains(spark):
    rows = spark.range(12_000).select(
        F.when(F.col("id") % 50 != 0, F.col("id").cast("string")).alias("brand"),
        (F.col("id") % 7).cast("string").alias("category_code"),
        *[(F.col("id") % k).cast("int").alias(name) for k, name in enumerate(FEATURE_COLUMNS[2:], 3)],
        (F.col("id") % 2).cast("int").alias("converted"),
    )
    fitted = model.train_conversion_model(rows, rounds=2)
    unseen = rows.limit(5).withColumn("brand", F.lit("new"))
    scored = model.predict_sessions(fitted, rows.unionByName(unseen))
    assert scored.count() == 12_005
    assert scored.where("score IS NULL OR score < 0 OR score > 1").isEmpty()


def fake_session(master, shared=None):
    conf = SimpleNamespace(get=lambda key, default: shared)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="x"))


def test_shared_folder_rules(spark):
    assert fresh_path(spark, "x").startswith(work_dir(spark))
    assert work_dir(fake_session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(ValueError):
        work_dir(fake_session("yarn"))


def test_comparison_rows(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (0, 0.6)], "converted int, score double")
    rows = {r["model"]: r for r in evaluate.model_comparison(df).collect()}
    assert rows["Always predict False"]["balanced_accuracy"] == 0.5
    assert rows["Boosted trees"]["roc_auc"] == 1.0


def test_bad_csv_rows_cost_one_row_each(spark, tmp_path):
    header = ",".join(EVENT_SCHEMA.fieldNames())
    good = "2024-01-01 00:00:0{} UTC,view,1,2,a,b,1.50,7,s"
    bad = ["2024-01-01 00:00:09 UTC,view,x,2,a,b,1.50,7,s", "yesterday,view,1,2,a,b,1.50,7,s", "2024-01-01 00:00:08 UTC,view"]
    lines = [header, good.format(1), *bad, good.format(2)]
    (tmp_path / "in.csv").write_text("\n".join(lines))
    events = files.read_events_csv(spark, str(tmp_path / "in.csv"))
    assert events.count() == 2 and events.select("user_session").count() == 2
    stored, dead = files.load_events_csv(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"))
    assert stored.count() == 2 and stored.columns == EVENT_SCHEMA.fieldNames()
    assert sorted(r[0] for r in dead.collect()) == sorted(bad)


def test_failed_replacement_leaves_the_old_table(spark, tmp_path):
    from pyspark.errors import PySparkException

    for path in (None, str(tmp_path / "table")):
        sinks.create_or_replace_table(spark.range(3), "kept_table", path)
        broken = spark.range(2).select(F.raise_error(F.lit("no")).alias("id"))
        with pytest.raises(PySparkException):
            sinks.create_or_replace_table(broken, "kept_table", path)
        assert spark.table("kept_table").count() == 3
        assert sinks.create_or_replace_table(spark.range(4), "kept_table", path).count() == 4
    assert len([p for p in (tmp_path / "table").iterdir() if p.name.startswith("version-")]) == 1
    spark.sql("DROP TABLE kept_table")

