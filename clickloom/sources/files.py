"""File readers with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.operators.quality import expect_columns
from clickloom.schema import EVENT_COLUMNS, EVENT_SCHEMA, EVENT_TIME_FORMAT
from clickloom.session import pin_utc


CORRUPT = "corrupt_record"


def _parsed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows; one that does not fit the schema stands whole in ``corrupt_record``."""
    pin_utc(spark)
    reader = spark.read.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]))
    reader = reader.option("header", True).option("enforceSchema", False).option("timestampFormat", EVENT_TIME_FORMAT)
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path)


def read_events_csv(
    spark: SparkSession, path: str, schema: T.StructType = EVENT_SCHEMA, partitions: int | None = None
) -> DataFrame:
    """Events from CSV or CSV.GZ files with a header row; a row that does not fit the schema is left out.

    The test for that reads all columns, so rows are parsed whole and every query sees the same rows.
    ``load_events_csv`` keeps the bad ones. A gzip file cannot be split, so give ``partitions`` to
    spread one huge file right after it is read.
    """
    parsed = _parsed_csv(spark, path, schema)
    names = schema.fieldNames()
    fits = F.concat(F.col(CORRUPT), F.xxhash64(*names).cast("string")).isNull()  # a hash is never null
    events = parsed.where(fits).select(*names)
    return events.repartition(partitions) if partitions else events


def load_events_csv(
    spark: SparkSession, path: str, target: str, schema: T.StructType = EVENT_SCHEMA
) -> tuple[DataFrame, DataFrame]:
    """Store events as Parquet and, from the same scan, the rows that do not fit as dead letters.

    Returns the events and the dead letters, which have the row as it came in ``corrupt_record``.
    """
    rows = _parsed_csv(spark, path, schema)
    route = F.when(F.col(CORRUPT).isNull(), "event").otherwise("dead_letter")
    rows.withColumn("route", route).write.mode("overwrite").partitionBy("route").parquet(target)
    stored = spark.read.option("basePath", target).parquet(target)
    events = stored.where("route = 'event'").drop("route", CORRUPT)
    return events, stored.where("route = 'dead_letter'").select(CORRUPT)


def check_csv_header(spark: SparkSession, path: str) -> None:
    """The header holds exactly the event columns, in order."""
    header = spark.read.option("header", True).option("inferSchema", False).csv(path)
    expect_columns(header, EVENT_COLUMNS)


def read_parquet_dir(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Total size of the data files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
