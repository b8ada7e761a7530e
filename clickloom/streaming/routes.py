"""Stream sources and sinks, validation routing and the event archive."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date, timedelta

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clickloom.operators.validate import route_clean, route_dlq, validated, with_event_date
from clickloom.schema import EVENT_COLUMNS, RAW_SCHEMA
from clickloom.sources.store import mark, move, names_in

ARCHIVE_FILE_BYTES = 64 << 20
CLOSED = "_closed"
BatchWriter = Callable[[DataFrame, int], None]


def stream_source_json(spark: SparkSession, fmt: str, options: Mapping[str, str]) -> DataFrame:
    """Raw payload stream with one ``payload`` text column.

    ``kafka`` resumes from the checkpoint and otherwise starts at the earliest offset;
    ``text`` and ``parquet`` follow a folder.
    """
    reader = spark.readStream.format(fmt).options(**options)
    if fmt == "kafka":
        if "startingOffsets" not in options:
            reader = reader.option("startingOffsets", "earliest")
        return reader.load().select(F.col("value").cast("string").alias("payload"))
    if fmt == "text":
        return reader.load().select(F.col("value").alias("payload"))
    return reader.schema(RAW_SCHEMA).load()


def keyed_records(clean: DataFrame) -> DataFrame:
    """Clean records as message key and JSON value; the session is the key."""
    value = F.to_json(F.struct(*EVENT_COLUMNS), {"ignoreNullFields": "false"})
    return clean.select(F.col("user_session").alias("key"), value.alias("value"))


def dlq_records(dlq: DataFrame) -> DataFrame:
    """Dead-letter records as unkeyed JSON values."""
    return dlq.select(F.to_json(F.struct(*dlq.columns)).alias("value"))


def keyed_stream_sink(
    clean: DataFrame, fmt: str, options: Mapping[str, str], checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    return _start(keyed_records(clean), fmt, options, checkpoint, available_now)


def dlq_sink(
    dlq: DataFrame, fmt: str, options: Mapping[str, str], checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    return _start(dlq_records(dlq), fmt, options, checkpoint, available_now)


def _start(
    records: DataFrame, fmt: str, options: Mapping[str, str], checkpoint: str, available_now: bool
) -> StreamingQuery:
    writer = records.writeStream.format(fmt).options(**options)
    return triggered(writer.option("checkpointLocation", checkpoint), available_now).start()


def triggered(writer, available_now: bool, every: str = "60 seconds"):
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)


def batch_folder_writer(base: str) -> BatchWriter:
    """Writes each batch to its own folder, so a retried batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch_id={batch_id}")

    return write


def validation_stream(
    raw: DataFrame,
    write_clean: BatchWriter,
    write_dlq: BatchWriter,
    checkpoint: str,
    available_now: bool = False,
    every: str = "10 seconds",
) -> StreamingQuery:
    """Check every raw record once and send it to exactly one of the two outputs.

    Both outputs come from one stored copy of the checked batch: the source is read and
    parsed once per batch. Counts of both outcomes appear in the query's progress.
    """
    checked = validated(raw).observe(
        "validation",
        F.count_if(F.col("failure_reason").isNull()).alias("valid_records"),
        F.count_if(F.col("failure_reason").isNotNull()).alias("invalid_records"),
    )

    def split(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            write_clean(route_clean(kept), batch_id)
            write_dlq(route_dlq(kept), batch_id)
        finally:
            kept.unpersist()

    writer = checked.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
    return triggered(writer, available_now, every).start()


def _packed_by_date(batch: DataFrame, target_bytes: int) -> DataFrame:
    """The batch with its dates dealt to as many tasks as their bytes fill files.

    Bytes are the lengths of the record's texts; a date has at least one file. The counts are one
    row per date of the batch.
    """
    width = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in EVENT_COLUMNS), F.lit(0))
    dated = with_event_date(batch)
    sizes = dated.groupBy("event_date").agg(F.sum(width).alias("_bytes"))
    files = {row["event_date"]: max(1, -(-row["_bytes"] // target_bytes)) for row in sizes.collect()}
    if not files:
        return dated
    pieces = [(date, part) for date, n in files.items() for part in range(n)]
    table = batch.sparkSession.createDataFrame(list(files.items()), "event_date string, _files long")
    spread = F.pmod(F.xxhash64(*EVENT_COLUMNS), F.col("_files"))
    joined = dated.join(F.broadcast(table), "event_date", "left").withColumn("_part", spread)
    return joined.repartition(len(pieces), "event_date", "_part").drop("_part", "_files")


def archive_batch(batch: DataFrame, batch_id: int, path: str, target_bytes: int, open_days: int) -> None:
    """Add one batch as a whole and mark the dates that it closes; a batch already there is left alone."""
    spark = batch.sparkSession
    name = f"batch={batch_id:012d}"
    if name not in names_in(spark, path):
        staged = f"{path}/_staged/{name}"
        _packed_by_date(batch, target_bytes).write.mode("overwrite").partitionBy("event_date").parquet(staged)
        move(spark, staged, f"{path}/{name}")
    dates = {entry for b in names_in(spark, path) if b.startswith("batch=") for entry in names_in(spark, f"{path}/{b}")}
    dates = sorted(d.removeprefix("event_date=") for d in dates if d.startswith("event_date=") and "__" not in d)  # not the null date
    if not dates:
        return
    limit = (date.fromisoformat(dates[-1]) - timedelta(days=open_days)).isoformat()
    closed = set(names_in(spark, f"{path}/{CLOSED}"))
    for day in dates:
        if day < limit and not any(name.startswith(f"{day}.") for name in closed):
            mark(spark, f"{path}/{CLOSED}/{day}.{batch_id}")


def archive_stream(
    clean: DataFrame,
    path: str,
    checkpoint: str,
    available_now: bool = False,
    every: str = "60 seconds",
    target_bytes: int = ARCHIVE_FILE_BYTES,
    open_days: int = 1,
) -> StreamingQuery:
    """Archive clean records as Parquet by ``event_date``.

    A batch's records are dealt by bytes, so each date gets files of about ``target_bytes``: few
    for a small batch, many for a large one. A batch appears by one rename. A date is marked as
    closed once a date more than ``open_days`` later has arrived; records that come for it after
    that are archived all the same.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        archive_batch(batch, batch_id, path, target_bytes, open_days)

    writer = clean.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return triggered(writer, available_now, every).start()


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """All archived records; filters on ``event_date`` prune folders."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")
    return rows.withColumn("event_date", F.col("event_date").cast("string"))


def closed_dates(spark: SparkSession, path: str) -> DataFrame:
    """One row per closed date with the batch that closed it."""
    marks = [name.rsplit(".", 1) for name in names_in(spark, f"{path}/{CLOSED}")]
    return spark.createDataFrame([(day, int(batch)) for day, batch in marks], "event_date string, closed_by long")
