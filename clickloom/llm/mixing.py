"""Mixing sources to target weights by Pfair scheduling of blocks, in DataFrame functions only.

A source with quota q of Q blocks releases block k at slot floor(k Q / q) and must have it placed
before slot ceil((k + 1) Q / q). Earliest deadline first among released blocks then keeps each
source within one block of its share at every moment. The quotas are whole numbers for the whole
mix: each is its target weight of all blocks, rounded up or down, so the rounding stays under one
block however long the mix is. A mix of more than ``PERIOD`` slots is first cut, by the same rule
for many slots at a time, into parts of ``PERIOD`` slots with whole quotas, which are laid out
independently. That adds less than one block for each level of cuts (one up to a million blocks).
Every document is placed at least once; smaller sources start over (their next epoch).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import materialize
from clickloom.llm.numbering import numbered

BLOCK_ROWS = 32
PERIOD = 1000  # slots of one part, and parts of one cut
TEMPER = 0.9  # default weights: shares of the rows to this power


def quotas(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """One row per source: mix_source, rows, blocks, quota.

    ``weights`` (source, weight) gives target weights for the sources; those it leaves out or
    gives no positive weight are weighted by default like their share, tempered. The quotas add
    up to the slots of the mix, each less than a block from the weight's share of them and no less
    than the source's blocks, so that no document is left out.
    """
    found = docs.groupBy("mix_source").agg(F.count(F.lit(1)).alias("rows"))
    default = F.pow(F.col("rows") / F.sum("rows").over(_all()), F.lit(TEMPER))
    if weights is None:
        found = found.withColumn("weight", default)
    else:
        given = weights.groupBy(_source("source").alias("mix_source")).agg(F.max("weight").alias("given"))
        found = found.withColumn("default", default).join(given, "mix_source", "left")
        found = found.withColumn("weight", F.when(F.col("given") > 0, F.col("given")).otherwise(F.col("default")))
    found = found.select(
        "mix_source", "rows", F.ceil(F.col("rows") / BLOCK_ROWS).alias("blocks"),
        (F.col("weight") / F.sum("weight").over(_all())).alias("share"),
    )
    # The fewest slots (by steps of a thousandth of the way) whose quotas can hold all blocks: from
    # where each source's share rounds up to its blocks, to where it reaches them.
    ends = found.agg(
        F.max(F.floor((F.col("blocks") - 1) / F.col("share")) + 1).alias("low"), F.max(F.ceil(F.col("blocks") / F.col("share"))).alias("high")
    )
    tries = ends.where("low is not null").select(
        F.explode(F.expr("array_distinct(transform(sequence(0, 1000), j -> greatest(low, ceil(low * pow(high / low, j / 1000)))))")).alias("slots")
    )
    base = F.greatest(F.floor(F.col("slots") * F.col("share")), F.col("blocks"))
    slots = found.crossJoin(F.broadcast(tries)).groupBy("slots").agg(F.sum(base).alias("least")).where("least <= slots")
    slots = slots.agg(F.min(F.struct("slots", "least")).alias("m")).select("m.*")
    whole = found.crossJoin(F.broadcast(slots)).withColumn("base", base)
    by_rest = Window.partitionBy("slots").orderBy((F.col("slots") * F.col("share") - F.col("base")).desc(), "mix_source")
    whole = whole.withColumn("more", (F.row_number().over(by_rest) <= F.col("slots") - F.col("least")).cast("long"))
    return whole.select("mix_source", "rows", "blocks", (F.col("base") + F.col("more")).cast("long").alias("quota"))


def _all():
    """A window over the sources; they are as many as the mix has parts, not rows."""
    return Window.partitionBy()


def _source(column: str):
    """A source name that is never null: a null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{column}`").cast("string")), F.lit(""))


def _parts(sources: DataFrame, total: int) -> DataFrame:
    """The mix in parts of at most ``PERIOD`` slots: start, q (slots), s (sources with a quota in it).

    A part gives each source the blocks due by its end, and those with the earliest deadlines more.
    """
    own = F.struct("mix_source", "quota", F.lit(0).cast("long").alias("before"))
    parts = sources.agg(F.sort_array(F.collect_list(own)).alias("s"), F.sum("quota").alias("q"))
    parts = parts.where("q is not null").select(F.lit(0).cast("long").alias("start"), "q", "s")
    size = PERIOD
    while size * PERIOD < total:
        size *= PERIOD
    while size >= PERIOD and size < total:
        end = f"least((p + 1) * {size}L, q)"
        low = f"transform(s, (x, i) -> greatest(acc.done[i], ({end} * x.quota) div q))"
        next_due = f"""array_sort(filter(transform(s, (x, i) -> if(
            b[i] * q < {end} * x.quota,
            struct(((b[i] + 1) * q + x.quota - 1) div x.quota as deadline, i as i), null)), c -> c is not null))"""
        more = f"transform(slice({next_due}, 1, cast({end} - aggregate(b, 0L, (a, v) -> a + v) as int)), c -> c.i)"
        # aggregate over an array of one value gives that value a name
        step = f"""aggregate(array({low}), acc, (a0, b) -> aggregate(array({more}), a0, (a, m) -> struct(
            transform(b, (v, i) -> v + if(array_contains(m, i), 1L, 0L)) as done,
            concat(a.cuts, array(transform(b, (v, i) -> v + if(array_contains(m, i), 1L, 0L)))) as cuts)))"""
        zero = "transform(s, x -> 0L)"
        cuts = f"""aggregate(sequence(0L, (q - 1) div {size}L),
            struct({zero} as done, array({zero}) as cuts), (acc, p) -> {step}, acc -> acc.cuts)"""
        parts = parts.withColumn("cuts", F.expr(cuts)).select(
            "start", "q", "s", "cuts", F.explode(F.expr(f"sequence(0, cast((q - 1) div {size}L as int))")).alias("p")
        )
        parts = parts.select(
            F.expr(f"start + p * {size}L").alias("start"),
            F.expr(f"least({size}L, q - p * {size}L)").alias("q"),
            F.expr("""filter(transform(s, (x, i) -> struct(x.mix_source as mix_source,
                cuts[p + 1][i] - cuts[p][i] as quota, x.before + cuts[p][i] as before)), x -> x.quota > 0)""").alias("s"),
        )
        parts = materialize(parts, "mix-parts")
        tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = parts.repartition(min(tasks, -(-total // size)), "start")
        size //= PERIOD
    return parts


def schedule(sources: DataFrame) -> DataFrame:
    """Each block placed: mix_source, k (0 .. quota-1), mix_slot, mix_release, mix_deadline.

    The fold goes slot by slot through one part; among the released blocks it takes the one with
    the earliest deadline, then the source first in name.
    """
    total = sources.agg(F.sum("quota")).first()[0] or 0
    pick = """array_min(transform(s, (x, i) -> if(
        (acc.done[i] * q) div x.quota <= t,
        struct(((acc.done[i] + 1) * q + x.quota - 1) div x.quota as deadline, cast(i as bigint) as i),
        struct(9223372036854775807L as deadline, cast(i as bigint) as i)))).i"""
    fold = f"""aggregate(
        sequence(0L, q - 1),
        struct(transform(s, x -> 0L) as done, cast(array() as array<bigint>) as turns, -1L as last),
        (acc, t) -> aggregate(array({pick}), acc, (a, p) -> struct(
            transform(a.done, (d, i) -> if(i = p, d + 1, d)) as done,
            concat(a.turns, array(p)) as turns,
            p as last)),
        acc -> acc.turns)"""
    laid = _parts(sources, total).select("start", "q", "s", F.posexplode(F.expr(fold)).alias("at", "i"))
    laid = laid.select("start", "q", F.expr("s[i]").alias("x"), "at").select("start", "q", "x.*", "at")
    own = Window.partitionBy("start", "mix_source").orderBy("at")
    laid = laid.withColumn("turn", (F.row_number().over(own) - 1).cast("long"))
    return laid.select(
        "mix_source",
        F.expr("before + turn").alias("k"),
        F.expr("start + at").alias("mix_slot"),
        F.expr("start + (turn * q) div quota").alias("mix_release"),
        F.expr("start + ((turn + 1) * q + quota - 1) div quota").alias("mix_deadline"),
    )


def mixed(docs: DataFrame, source_col: str = "source", key: list[str] | None = None, weights: DataFrame | None = None) -> DataFrame:
    """``docs`` with its rows placed in the mix: mix_slot, mix_offset, mix_epoch, mix_block,
    mix_release and mix_deadline follow its columns (in place of columns of those names).

    Reading rows by (mix_slot, mix_offset) gives the mixture. A row appears once per epoch of its
    source. ``mix_release`` and ``mix_deadline`` are those of the block in its part of the mix. Rows of a source are dealt to its blocks by a hash of ``key`` (default: all columns);
    the last block of an epoch may be short. A null source is a source of its own; repeated rows
    are rows of their own; an empty table gives an empty result.
    """
    new = ("mix_slot", "mix_offset", "mix_epoch", "mix_block", "mix_release", "mix_deadline")
    own = [c for c in docs.columns if c.lower() not in new]
    packed = F.struct(*(F.col(f"`{c}`") for c in own)).alias("mix_own")  # no name can clash
    rows = docs.select(packed, _source(source_col).alias("mix_source"))
    sources = materialize(quotas(rows, weights), "mix-quotas")
    slots = materialize(schedule(sources), "mix-slots")

    names = key or own
    at_row = numbered(rows, ["mix_source"], [F.col(f"mix_own.`{c}`") for c in names], "mix_row", "mix-offsets")
    dealt = (
        at_row.join(F.broadcast(sources.select("mix_source", "blocks", "quota")), "mix_source")
        .withColumn("mix_block", F.expr(f"mix_row div {BLOCK_ROWS}"))
        .withColumn("mix_epoch", F.explode(F.expr("sequence(0L, (quota - 1 - mix_block) div blocks)")))
        .withColumn("k", F.expr("mix_epoch * blocks + mix_block"))
        .join(slots, ["mix_source", "k"])
    )
    return dealt.select(
        *(F.col(f"mix_own.`{c}`") for c in own),
        "mix_slot",
        F.expr(f"mix_row % {BLOCK_ROWS}").alias("mix_offset"),
        "mix_epoch",
        "mix_block",
        "mix_release",
        "mix_deadline",
    )
