"""A table of current rows by key: sorted runs, merged level by level under a numbered manifest.

Every batch adds a run, the newest row of each of its keys, sorted by key. ``FANOUT`` runs of one
level are merged into a run of the next, so a read meets a few runs per level and a row is rewritten
once per level. Which runs make up the table is said by a manifest. A new state of the table is a new
manifest with the next number, moved into place by one rename: writers that meet start again from
the newer one. A reader stays with the generation it opened; files that the newest generations do
not list are deleted later.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.sources.store import move_new, names_in, read_text, remove, write_text

FANOUT = 4  # runs of a level that are merged
KEPT = 3  # generations whose files stay for readers
BATCH = "_batch"
MANIFESTS = "_generations"
RUNS = "_runs"


@dataclass
class Run:
    name: str
    level: int
    batches: list[int]


@dataclass
class Manifest:
    generation: int = 0
    last_batch: int = -1
    runs: list[Run] = field(default_factory=list)

    def text(self) -> str:
        return json.dumps(asdict(self))


def _name(generation: int) -> str:
    return f"{generation:012d}.json"


def _load(spark: SparkSession, target: str, name: str) -> Manifest:
    stored = json.loads(read_text(spark, f"{target}/{MANIFESTS}/{name}"))
    return Manifest(stored["generation"], stored["last_batch"], [Run(**run) for run in stored["runs"]])


def current_generation(spark: SparkSession, target: str) -> Manifest:
    """The newest manifest; an empty one for a table that does not exist yet."""
    names = [n for n in names_in(spark, f"{target}/{MANIFESTS}") if n.endswith(".json")]
    return _load(spark, target, names[-1]) if names else Manifest()


def _commit(spark: SparkSession, target: str, change) -> Manifest:
    """Apply ``change`` to the newest manifest until no other writer comes in between.

    ``change`` returns the new manifest, or None if nothing is left to do.
    """
    while True:
        now = current_generation(spark, target)
        changed = change(now)
        if changed is None:
            return now
        changed.generation = now.generation + 1
        draft = f"{target}/{MANIFESTS}/_{uuid.uuid4().hex}"
        write_text(spark, draft, changed.text())
        if move_new(spark, draft, f"{target}/{MANIFESTS}/{_name(changed.generation)}"):
            return changed
        remove(spark, draft)


def latest_by_key(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """The row with the highest order columns for each key."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order_cols)).alias("_row"))
    return newest.select(*keys, "_row.*").select(*df.columns)


def _write_run(rows: DataFrame, target: str, keys: Sequence[str]) -> str:
    name = uuid.uuid4().hex
    rows.repartition(*keys).sortWithinPartitions(*keys).write.parquet(f"{target}/{RUNS}/{name}")
    return name


def _rows_of(spark: SparkSession, target: str, runs: Sequence[Run]) -> DataFrame:
    return spark.read.parquet(*[f"{target}/{RUNS}/{run.name}" for run in runs])


def upsert_sink(
    batch: DataFrame, batch_id: int, target: str, keys: Sequence[str], order_cols: Sequence[str]
) -> None:
    """Add a batch of upserts and merge the levels that became full.

    A batch that comes again replaces its run as long as that was not merged, and is skipped after that.
    """
    spark = batch.sparkSession
    newest = latest_by_key(batch, keys, order_cols).withColumn(BATCH, F.lit(batch_id).cast("long"))
    name = _write_run(newest, target, keys)

    def add(now: Manifest) -> Manifest | None:
        if any(batch_id in run.batches and run.level > 0 for run in now.runs):
            return None
        others = [run for run in now.runs if run.batches != [batch_id]]
        return Manifest(0, max(now.last_batch, batch_id), [*others, Run(name, 0, [batch_id])])

    _commit(spark, target, add)
    while _merge_full_level(spark, target, keys, order_cols):
        pass
    reclaim(spark, target)


def _merge(spark: SparkSession, target: str, runs: Sequence[Run], level: int, keys, order_cols) -> None:
    """One run in place of several. Other writers may add runs meanwhile; if one of these went, nothing changes."""
    rows = latest_by_key(_rows_of(spark, target, runs), keys, [*order_cols, BATCH])
    name = _write_run(rows, target, keys)
    old = {run.name for run in runs}

    def swap(now: Manifest) -> Manifest | None:
        if not old <= {run.name for run in now.runs}:
            return None
        batches = sorted(b for run in runs for b in run.batches)
        kept = [run for run in now.runs if run.name not in old]
        return Manifest(0, now.last_batch, [*kept, Run(name, level, batches)])

    _commit(spark, target, swap)


def _merge_full_level(spark: SparkSession, target: str, keys, order_cols) -> bool:
    runs = current_generation(spark, target).runs
    for level in sorted({run.level for run in runs}):
        own = [run for run in runs if run.level == level]
        if len(own) >= FANOUT:
            _merge(spark, target, own, level + 1, keys, order_cols)
            return True
    return False


def read_upserts(
    spark: SparkSession, target: str, keys: Sequence[str], order_cols: Sequence[str] = (), at: Manifest | None = None
) -> DataFrame:
    """Current rows of a generation (the newest by default): for every key the highest order
    columns, then the newest batch."""
    manifest = at or current_generation(spark, target)
    if not manifest.runs:
        raise FileNotFoundError(f"no upserts in {target}")
    return latest_by_key(_rows_of(spark, target, manifest.runs), keys, [*order_cols, BATCH]).drop(BATCH)


def compact_upserts(spark: SparkSession, target: str, keys: Sequence[str], order_cols: Sequence[str] = ()) -> DataFrame:
    """Merge all runs into one, in place; streams that write to the table go on."""
    runs = current_generation(spark, target).runs
    if len(runs) > 1:
        _merge(spark, target, runs, max(run.level for run in runs) + 1, keys, order_cols)
        reclaim(spark, target)
    return read_upserts(spark, target, keys, order_cols)


def reclaim(spark: SparkSession, target: str, kept: int = KEPT) -> None:
    """Delete old manifests and the runs that only they list.

    A run that no manifest lists yet belongs to a writer at work and stays.
    """
    names = [n for n in names_in(spark, f"{target}/{MANIFESTS}") if n.endswith(".json")]
    live = {run.name for n in names[-kept:] for run in _load(spark, target, n).runs}
    for n in names[:-kept]:
        for run in _load(spark, target, n).runs:
            if run.name not in live:
                remove(spark, f"{target}/{RUNS}/{run.name}")
        remove(spark, f"{target}/{MANIFESTS}/{n}")
