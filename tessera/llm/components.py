"""Connected components of an edge table, without bringing edges or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, materialise

#: Rounds after which the loop gives up loudly; alternating star steps need about log2 of the longest path.
MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One star step: link each vertex's neighbours (the larger ones, or the smaller ones) to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")).select("a", F.least("a", "low").alias("low"), "n")
    out = join_hot(both, low, "a", "b", "n", 2 * total)
    if large:
        return out.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    return out.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every vertex of ``edges`` (a, b: long); the component is its smallest vertex.

    Large-star and small-star steps alternate until nothing changes; a hub's neighbours stay one row each, so the
    rows never outgrow the edges, and are dealt to several tasks. Each round is written to the shared folder. Loops are
    ignored; no edges, no rows.
    """
    now = materialise(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        # a forest of stars: no vertex is both a leaf and a centre, no leaf has two centres
        centres = now.select(F.col("b").alias("a")).distinct()
        state = now.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
        broken = state.where("low <> high").limit(1).count() or state.join(centres, "a", "left_semi").limit(1).count()
        if not broken:
            leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return leaves.unionByName(centres.select(F.col("a").alias("node"), F.col("a").alias("component")))
        total = now.count()
        before, now = now, materialise(_star(materialise(_star(now, True, total), "edges"), False, total), "edges")
        discard(before)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
