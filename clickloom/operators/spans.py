"""Cut the events of very busy keys into spans, so that no key is one task's work.

The cuts are quantiles of a sample in the order (key, time), as a range partitioner takes them:
ranges of equal event counts, whatever the clock says. A key that fills a whole range is cut where
ranges end; any other key stays in one span. There are at most as many cuts as ranges, however
many keys there are, so tables of one row per cut may be broadcast. A row's span follows from its
key and time and the cuts alone: retried tasks and separate passes agree, and no result depends on
where the cuts lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = "_span"
CUTS = "_cuts"
RANGE_ROWS = 1 << 16  # events in a range, at least; no key with fewer is cut
SAMPLED = 40  # sampled events per range


def cut_points(df: DataFrame, key: str, time: str) -> DataFrame | None:
    """The cut keys with their sorted cut times, or None if no key fills a range.

    ``time`` is a whole number. There are up to ``spark.sql.shuffle.partitions`` ranges.
    """
    spark = df.sparkSession
    rows = df.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, time)
    n = rows.count()
    ranges = min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // RANGE_ROWS)
    if ranges < 3:  # a whole range needs a cut on either side
        return None
    sample = rows.sample(min(1.0, 1.2 * SAMPLED * ranges / n), seed=17).collect()
    ordered = sorted((row[0], row[1]) for row in sample)
    cuts: dict = {}
    for k in range(1, ranges):
        own, at = ordered[k * len(ordered) // ranges]
        cuts.setdefault(own, []).append(at)
    busy = [(own, sorted(set(times))) for own, times in cuts.items() if len(times) > 1]
    if not busy:
        return None
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField(CUTS, T.ArrayType(T.LongType()))])
    return spark.createDataFrame(busy, schema)


def in_spans(df: DataFrame, key: str, time: str, cuts: DataFrame | None, only_cut: bool = False) -> DataFrame:
    """Add each row's span and gather rows by key and span; without cuts, by key alone.

    Rows without a key or time belong to no span. ``only_cut`` leaves just the keys that are cut.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    if cuts is None:
        return rows.withColumn(SPAN, F.lit(0)).repartition(key)
    joined = rows.join(F.broadcast(cuts), key, "inner" if only_cut else "left")
    passed = F.size(F.filter(CUTS, lambda cut: cut <= F.col(time)))
    span = F.when(F.col(CUTS).isNull(), F.lit(0)).otherwise(passed)
    return joined.select(*df.columns, span.alias(SPAN)).repartition(key, SPAN)
