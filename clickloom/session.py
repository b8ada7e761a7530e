"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

STATE_STORE_KEY = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)
_LOCAL_WORK_DIRS: dict[str, str] = {}


def build_session(app_name: str = "clickloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings every job here relies on: UTC and adaptive plans."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(STATE_STORE_KEY, ROCKSDB_PROVIDER)
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> None:
    """Event times are UTC wall-clock values; keep casts independent of the host."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is only used by a local master that names none.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    app = context.applicationId
    if app not in _LOCAL_WORK_DIRS:
        _LOCAL_WORK_DIRS[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_WORK_DIRS[app]


def ensure_checkpoints(spark: SparkSession) -> None:
    """Let long-running training cut its lineage in the shared folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{work_dir(spark)}/checkpoints")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return f"{work_dir(spark)}/clickloom-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result feeds several passes: lineage is cut in a place that outlives any
    executor, and later passes still prune columns and push filters into Parquet.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
