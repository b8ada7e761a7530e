"""Batch writers."""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.operators.quality import expect_artifacts
from clickloom.operators.sessions import feature_frame, union_all_counts
from clickloom.schema import INTERVAL_STATISTICS
from clickloom.sources.files import folder_bytes, read_events_csv
from clickloom.sources.store import names_in, remove
from clickloom.sources.upserts import latest_by_key

ROW_GROUP_ROWS = 100_000
TARGET_FILE_BYTES = 256 * 1024 * 1024
SESSION_CATALOG = "spark_catalog"


def csv_to_parquet(spark: SparkSession, source: str, target: str, rows_per_group: int = ROW_GROUP_ROWS,
                   partitions: int | None = None) -> DataFrame:
    """Columnar copy of event CSV files in row groups of a fixed number of rows."""
    events = read_events_csv(spark, source, partitions=partitions)
    writer = events.write.mode("overwrite").option("parquet.block.row.count.limit", rows_per_group)
    writer.parquet(target)
    return spark.read.parquet(target)


def create_or_replace_table(df: DataFrame, table: str, path: str | None = None) -> DataFrame:
    """Replace a table's content and schema; its namespace is created when missing.

    Catalogs beyond the session's own get an atomic replace. In the session catalog the new content
    is written aside first and the name then points to it: a write that fails leaves the old table
    as it was. ``path`` says where files go, a folder per version; older versions are deleted after
    the switch.
    """
    spark = df.sparkSession
    *namespace, name = table.split(".")
    if namespace:
        spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {'.'.join(namespace)}")
    if len(namespace) > 1 and namespace[0] != SESSION_CATALOG:
        df.writeTo(table).createOrReplace()
        return spark.table(table)
    staged = ".".join([*namespace, f"{name}__{uuid.uuid4().hex}"])
    writer = df.write.format("parquet")
    version = f"version-{uuid.uuid4().hex}"
    if path:
        writer = writer.option("path", f"{path}/{version}")
    writer.saveAsTable(staged)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(f"ALTER TABLE {staged} RENAME TO {table}")
    for old in names_in(spark, path) if path else []:
        if old.startswith("version-") and old != version:
            remove(spark, f"{path}/{old}")
    return spark.table(table)


def export_features(sessions: DataFrame, path: str, views_only: bool = True) -> DataFrame:
    """Model features and target as zstd Parquet."""
    feature_frame(sessions, views_only).write.mode("overwrite").option("compression", "zstd").parquet(
        path
    )
    return sessions.sparkSession.read.parquet(path)


def merge_parquet_files(
    spark: SparkSession, source: str, target: str, target_bytes: int = TARGET_FILE_BYTES
) -> DataFrame:
    """Rewrite many part files as few zstd files; one file when the data fit its target size.

    A task writes a file and reads its share of the compressed parts, about the target size, without
    a shuffle. Rows are only dealt out where the parts' splits are larger than a file.
    """
    files = max(1, math.ceil(folder_bytes(spark, source) / target_bytes))
    rows = spark.read.parquet(source)
    shared = rows.coalesce(files) if rows.rdd.getNumPartitions() >= files else rows.repartition(files)
    shared.write.mode("overwrite").option("compression", "zstd").parquet(target)
    return spark.read.parquet(target)


def write_reference_csv(table: DataFrame, path: str) -> None:
    """The percentile table (101 rows) as one sorted CSV file with a header."""
    columns = ["percentile", "percentile_fraction", *INTERVAL_STATISTICS]
    ordered = table.select(*columns).coalesce(1).sortWithinPartitions("percentile")
    ordered.write.mode("overwrite").option("header", True).csv(path)


def publish_artifacts(frames: Mapping[str, DataFrame], base: str) -> dict[str, DataFrame]:
    """Write each frame under ``base`` and raise when one turns out empty."""
    stored = {}
    for name, frame in frames.items():
        path = f"{base}/{name}"
        frame.write.mode("overwrite").parquet(path)
        stored[name] = frame.sparkSession.read.schema(frame.schema).parquet(path)
    expect_artifacts(stored)
    return stored


def register_views(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """One view per stored artifact, and a report of their row counts."""
    for name, path in paths.items():
        spark.read.parquet(path).createOrReplaceTempView(name)
    return union_all_counts({name: spark.table(name) for name in paths}, "view_name")


def merge_into_table(batch: DataFrame, table: str, keys: Sequence[str], order_cols: Sequence[str]) -> None:
    """Upsert into a table whose format supports MERGE."""
    match = " AND ".join(f"t.{key} = s.{key}" for key in keys)
    latest_by_key(batch, keys, order_cols).createOrReplaceTempView("_upsert_rows")
    batch.sparkSession.sql(
        f"MERGE INTO {table} t USING _upsert_rows s ON {match} "
        "WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *"
    )
