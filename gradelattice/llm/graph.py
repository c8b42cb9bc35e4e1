"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelattice.session import stage, stage_observed

MAX_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """``node, component`` for every node of ``edges``; the component is its smallest node.

    With ``rounds``, stops after so many: nodes of one component may then still go by several names, each of them a node
    of it, and nodes that are nobody's name but their own may be left out.

    Alternates two steps until neither changes an edge: every node ties its larger neighbours to its smallest one, then its
    smaller neighbours to the smallest one.  Each step is an aggregation and a join on the node, so a node of very many
    edges is split by Spark's skew handling and never gathered; the number of rounds is about the logarithm of the
    longest path.  Every round is written to the shared folder, which cuts the lineage.  Loops and repeated edges do no
    harm; an empty table has no nodes.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    if rounds is not None:
        for _ in range(rounds):
            now = stage(_tie(_tie(now, larger=True), larger=False).distinct(), "edges")
        return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    now, seen = stage_observed(now, "edges", n=F.count(F.lit(1)), s=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    for _ in range(MAX_ROUNDS):
        before = seen
        if not before["n"]:
            break
        now = _tie(now, larger=True)
        now, seen = stage_observed(_tie(now, larger=False).distinct(), "edges", n=F.count(F.lit(1)), s=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    # Settled: every edge leads from a node straight to the smallest node of its component.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()


def _tie(edges: DataFrame, larger: bool) -> DataFrame:
    """One step over edges ``u > v``: the neighbours above (or below) a node are tied to the smallest of it and them all."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    if larger:
        both = both.union(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
    tied = both.join(least, "x")
    if larger:
        tied = tied.where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        tied = tied.select(F.col("y").alias("u"), F.col("m").alias("v")).union(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
    return tied.where("u > v")
