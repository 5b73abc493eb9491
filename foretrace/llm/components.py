"""Connected components by alternating star contraction, with each round written as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretrace.llm.common import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every node's larger neighbours to the smallest node of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect every node and its smaller neighbours to the smallest of them; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node of the component of every node in ``pairs``, roots excluded.

    Self-pairs, repeated and mirrored pairs and pairs with a null do no harm. Each round is one write to the shared
    folder, so a lost executor repeats at most a round; rounds grow with the logarithm of the longest chain. Edges at a
    node with very many neighbours are joined with one row for that node, which adaptive execution splits.
    """
    u, v = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    complete = F.col(a).isNotNull() & F.col(b).isNotNull()
    edges = cut_lineage(pairs.where(complete & (F.col(a) != F.col(b))).select(u.alias("u"), v.alias("v")).distinct())
    state = None
    while True:
        edges = cut_lineage(_small_star(_large_star(edges)))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
