"""Pairs of sets, and the links among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from raterkit.llm.components import components
from raterkit.session import discard, materialize


def comparable(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets (cid, n, grams) with 100 * intersection >= percent * union."""
    left = sets.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("grams").alias("g_a"))
    right = sets.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("grams").alias("g_b"))
    both = pairs.join(left, "a").join(right, "b")
    common = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("g_a", "g_b")).alias("c"))
    return common.filter(F.col("c") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("c")) * percent).select("a", "b")


class Links:
    """Links found so far, kept as one edge to its root for every linked node."""

    def __init__(self):
        self.roots: DataFrame | None = None

    def add(self, more: DataFrame) -> None:
        """Join what the links (a, b) connect. Earlier links need not be given again: their
        nodes' edges to the root stand for them."""
        found = materialize(more, "links-found")
        if not found.limit(1).count():
            return
        links = found if self.roots is None else found.unionByName(self.roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = materialize(components(links), "roots")
        discard(found)
        if self.roots is not None:
            discard(self.roots)
        self.roots = roots

    def rooted(self, rows: DataFrame, node: str, name: str) -> DataFrame:
        """``rows`` with the root of ``node``, itself where nothing is linked to it."""
        if self.roots is None:
            return rows.withColumn(name, F.col(node))
        roots = self.roots.select(F.col("node").alias(node), F.col("root").alias(name))
        return rows.join(roots, node, "left").withColumn(name, F.coalesce(name, node))

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, ...) that are not connected yet, with their roots."""
        return self.rooted(self.rooted(pairs, "a", "root_a"), "b", "root_b").filter("root_a <> root_b")
