"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import bounded_join, join_hot, materialise, small_enough

#: Links that one partition may hold, of 16 bytes each.
FEW = 200_000


def _settled(edges: DataFrame) -> bool:
    """Whether edges (u > v) are stars about their smallest nodes: no u has two links or is itself a v."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()


def connected_components(edges: DataFrame, rounds: int = 50, keep=materialise) -> DataFrame:
    """(node, component) for every node of `edges` (u, v); a component is called by its smallest node.

    Each node's neighbours are reduced by a partial aggregate and a hub's links are joined by a broadcast, so that it
    is not gathered in one task; every round is cut by a table that `keep` writes into the shared folder. While the
    links are at most `FEW` (a few MB), one partition holds them and no step shuffles. Loops and repeated edges don't
    matter; no edges give an empty result.
    """
    edges = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    few = small_enough(edges, FEW)
    together = (lambda df: df.coalesce(1)) if few else (lambda df: df)
    for _ in range(rounds):
        edges = together(edges)
        if _settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = together(both)
        lowest = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # m <= u < v, so that the links are (larger, smaller) as they come
        up = both.where("v > u")
        met = up.join(lowest, "u") if few else join_hot(up, keep(lowest), ["u"], "n")
        large = together(keep(met.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = keep(together(small).where("u <> v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return together(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


def merge_components(labels: DataFrame, links: DataFrame, keep=materialise) -> DataFrame:
    """labels (node, component) after further links (u, v): only the components that links touch are worked on."""
    ends = keep(links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).distinct())
    known = keep(bounded_join(labels, ends, "node", "left_semi"))
    of = lambda end: known.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    between = bounded_join(bounded_join(links, of("u"), "u", "left"), of("v"), "v", "left").select(F.coalesce("of_u", "u").alias("u"), F.coalesce("of_v", "v").alias("v"))
    merged = keep(connected_components(between, keep=keep))
    renamed = merged.select(F.col("node").alias("component"), F.col("component").alias("now"))
    moved = bounded_join(labels, renamed, "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    return moved.unionByName(bounded_join(merged, known.select(F.col("component").alias("node")).unionByName(known.select("node")).distinct(), "node", "left_anti"))
