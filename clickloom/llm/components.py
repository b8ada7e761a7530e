"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import materialize, split_join

MAX_ROUNDS = 100  # the steps end after about log(n)**2 rounds; beyond this something is broken


def _settled(edges: DataFrame) -> bool:
    """Whether every node is either a root or has one edge, to a root. Edges run from a down to b."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    loose = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 - root and up > 0")
    return loose.agg(F.count(F.lit(1))).first()[0] == 0


def connected(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (a, b): root is the smallest node reached.

    Nulls and loops join nothing. Each round aggregates a minimum per node before any shuffle of
    its neighbours and stores its edges, so a node with very many neighbours is never gathered.
    The rounds end as soon as the edges are stars around their smallest nodes.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    for _ in range(MAX_ROUNDS):
        if _settled(now):
            break
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            split_join(both, least, ["a"], "inner", "large")
            .where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        large = materialize(large, "large-star")
        down = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "small")
        small = (
            large.join(down, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .union(down)
            .distinct()
        )
        now = materialize(small, "small-star")
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
