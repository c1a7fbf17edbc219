"""A Merkle manifest of a table: one tree per group, one root above the groups' roots.

Leaves of a group stand in ascending order of their key; every two consecutive nodes become
their hash, a last one alone becomes its own, until one is left. Trees are cut into
superblocks of 2^BLOCK_LEVELS leaves:

1. upwards, each superblock is reduced to its top node; these are the leaves of the next,
   256 times smaller tier, until every tree has one node, and so for the tree of the groups;
2. downwards, the nodes outside a superblock that its leaves need (the path of its top node)
   and the leaves inside are cogrouped by superblock. One ``applyInPandas`` finishes the
   local reduction, joins the outer path to the local one and folds the presented leaf.

A task holds one superblock at a time, whatever the size of a group. Paths are strings, so
they can be stored and read by anything: steps joined by commas, ``<`` and a digest for a
sibling on the left, ``>`` and a digest for one on the right, empty for a node alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from raterkit.operators.ordering import with_index
from raterkit.operators.skew import salted_join
from raterkit.session import materialize, ship_package

#: Levels of a tree that are reduced inside one superblock.
BLOCK_LEVELS = 8

_NODES = "tree long, pos long, size long, digest string"
_PATHS = "tree long, pos long, path string, subroot string, root string"
_AUDIT = "doc_id string, leaf string, subroot string, root string, path string, folded_root string"


def field(value: Column) -> Column:
    """Length-prefixed text of a value: '-' for null, else UTF-8 bytes, ':', the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields."""
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def _hash(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _levels(digests: list[str], steps: int) -> list[list[str]]:
    """The nodes of a superblock, level by level; the last level is its top node."""
    found = [digests]
    for _ in range(steps):
        below = found[-1]
        found.append([_hash(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return found


def _reduced(rows: pd.DataFrame, height: int) -> tuple[pd.DataFrame, list[list[str]]]:
    """A superblock's nodes in their order, and its levels, of which a small tree has fewer."""
    rows = rows.sort_values("pos")
    steps = min(height, (int(rows["size"].iloc[0]) - 1).bit_length())
    return rows, _levels(rows["digest"].tolist(), steps)


def _local_path(levels: list[list[str]], at: int) -> list[str]:
    path = []
    for nodes in levels[:-1]:
        beside = at ^ 1
        path.append("" if beside >= len(nodes) else f"{'<' if beside < at else '>'}{nodes[beside]}")
        at >>= 1
    return path


def fold(digest: str, path: Sequence[str]) -> str:
    """The node that a digest and the siblings on its path lead to."""
    for step in path:
        if not step:
            digest = _hash(digest)
        elif step[0] == "<":
            digest = _hash(step[1:], digest)
        else:
            digest = _hash(digest, step[1:])
    return digest


def _split(path: str | None) -> list[str]:
    """Steps of a stored path. A path without steps is null."""
    return [] if path is None else path.split(",")


def _joined(path: list[str]) -> str | None:
    return ",".join(path) if path else None


def _top(height: int):
    def top(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """A superblock's top node."""
        rows, levels = _reduced(rows, height)
        size = -(-int(rows["size"].iloc[0]) >> height)
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "size": [size], "digest": [levels[-1][0]]})

    return top


def _finish(rows: pd.DataFrame, outer: pd.DataFrame, height: int) -> tuple[pd.DataFrame, list[list[str]], list[str], str, str]:
    """Sorted nodes, their local paths, and the superblock's outer path, subroot and root."""
    rows, levels = _reduced(rows, height)
    local = [_local_path(levels, i) for i in range(len(rows))]
    if not len(outer):  # the top superblock of the tree of groups
        return rows, local, [], levels[-1][0], levels[-1][0]
    above = outer.iloc[0]
    return rows, local, _split(above["path"]), above["subroot"] or levels[-1][0], above["root"]


def _paths_of(height: int):
    def paths_of(key: tuple, rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        """Paths of the nodes of an upper tier."""
        rows, local, beyond, subroot, root = _finish(rows, outer, height)
        paths = [_joined(p + beyond) for p in local]
        return pd.DataFrame({"tree": rows["tree"], "pos": rows["pos"], "path": paths, "subroot": subroot, "root": root})

    return paths_of


def _audit_of(height: int):
    def audit_of(key: tuple, rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        """Leaves with their whole path, and the root their presented digest leads to."""
        rows, local, beyond, subroot, root = _finish(rows, outer, height)
        reached: dict[str, str] = {}  # most leaves of a superblock lead to the same top node
        folded = []
        for digest, changed, path in zip(rows["digest"], rows["presented"], local):
            top = fold(digest if changed is None else changed, path)
            if top not in reached:
                reached[top] = fold(top, beyond)
            folded.append(reached[top])
        paths = [_joined(p + beyond) for p in local]
        return pd.DataFrame({"doc_id": rows["doc_id"], "leaf": rows["digest"], "subroot": subroot, "root": root, "path": paths, "folded_root": folded})

    return audit_of


class Manifest:
    """Leaves in place, and the tiers of the groups' trees and of the tree above them."""

    def __init__(self, leaves: DataFrame, height: int = BLOCK_LEVELS):
        """``leaves``: tree, pos, size, digest, doc_id, presented, in the shared folder."""
        spark, self.height = leaves.sparkSession, height
        self.groups = self._tiers(leaves, "merkle-tier")
        subroots = self.groups[-1].select("tree", "digest")
        count, zero = F.lit(subroots.count()).cast("long"), F.lit(0).cast("long")
        self.above = self._tiers(subroots.select(zero.alias("tree"), F.col("tree").alias("pos"), count.alias("size"), "digest"), "merkle-top")
        self.none = spark.createDataFrame([], _PATHS)

    def root(self) -> str | None:
        row = self.above[-1].first()
        return row and row["digest"]

    def _blocks(self, nodes: DataFrame):
        return nodes.withColumn("block", F.shiftright("pos", self.height)).groupBy("tree", "block")

    def _tiers(self, nodes: DataFrame, name: str) -> list[DataFrame]:
        """(tree, pos, size, digest) of all tiers; the last has one node for each tree."""
        tiers = [nodes]
        while (tiers[-1].agg(F.max("size")).first()[0] or 0) > 1:
            tops = self._blocks(tiers[-1].select("tree", "pos", "size", "digest")).applyInPandas(_top(self.height), _NODES)
            tiers.append(materialize(tops, name))
        return tiers

    def _below(self, tier: DataFrame, outer: DataFrame, function, schema: str) -> DataFrame:
        """Nodes of a tier, cogrouped by superblock with what they need from outside it."""
        needed = outer.withColumnRenamed("pos", "block").groupBy("tree", "block")
        return self._blocks(tier).cogroup(needed).applyInPandas(function(self.height), schema)

    def _outer(self) -> DataFrame:
        """Paths of the top nodes of the lowest tier's superblocks, up to the root."""
        paths = self.none
        for tier in reversed(self.above):
            paths = materialize(self._below(tier, paths, _paths_of, _PATHS), "merkle-paths")
        # a node of the upper tree is the top node of one group's tree
        outer = paths.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.lit(None).cast("string").alias("subroot"), "root")
        for tier in reversed(self.groups[1:]):
            outer = materialize(self._below(tier, outer, _paths_of, _PATHS), "merkle-paths")
        return outer

    def audit(self) -> DataFrame:
        """doc_id, leaf, subroot, root, path, folded_root, verified of every leaf.

        ``folded_root`` is folded from the presented digest, the leaf itself where none was
        presented, along the manifest's path.
        """
        # as text, a null key does not turn the others into floating point numbers
        leaves = self.groups[0].withColumn("doc_id", F.col("doc_id").cast("string"))
        found = self._below(leaves, self._outer(), _audit_of, _AUDIT)
        return found.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("verified", F.col("folded_root") == F.col("root"))


def place(docs: DataFrame, key: Column, group: Column, digest: Column, presented: Column) -> DataFrame:
    """tree, pos, size, digest, doc_id, presented: the leaves in their places.

    Groups ascend by the bytes of their name, null first; leaves by key, null first, then by
    digest, so rows with one key have a defined order and equal rows any.
    """
    ship_package(docs.sparkSession)
    # a prefix keeps the order and makes null a key that joins
    name = F.coalesce(F.concat(F.lit("="), group), F.lit(""))
    rows = docs.select(
        name.alias("name"), key.alias("doc_id"), digest.alias("digest"), presented.alias("presented"), F.monotonically_increasing_id().alias("row")
    )
    rows = with_index(materialize(rows, "merkle-leaves"), ["name", "doc_id", "digest", "row"])
    sizes = materialize(rows.groupBy("name").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("size")), "merkle-groups")
    trees = with_index(sizes, ["name"], "tree")
    placed = salted_join(rows, trees, ["name"], counts=sizes.select("name", F.col("size").alias("n")))
    return materialize(placed.select("tree", (F.col("idx") - F.col("first")).alias("pos"), "size", "digest", "doc_id", "presented"), "merkle-placed")


def audit(
    docs: DataFrame,
    key: str,
    group: str,
    fields: Sequence[str],
    changed: dict[str, Column] | None = None,
    when: Column | None = None,
    height: int = BLOCK_LEVELS,
) -> DataFrame:
    """Build the manifest of ``docs`` and check every row against it.

    Where ``when`` holds, the presented row has the values of ``changed`` in place of its
    fields; its digest is folded with the siblings of the untouched tree. Null fields, empty
    and long texts have their own encodings; repeated rows are leaves of their own; a null
    group is the first group, a null key sorts first; an empty table has no rows and no root.
    Only the named columns are read, so others may have any name. Texts are hashed once where
    they lie; what is shuffled is as narrow as two digests a row.
    """
    digest = leaf_digest([F.col(f) for f in fields])
    presented = F.lit(None).cast("string")
    if when is not None:
        presented = F.when(when, leaf_digest([(changed or {}).get(f, F.col(f)) for f in fields]))
    return Manifest(place(docs, F.col(key).cast("long"), F.col(group), digest, presented), height).audit()


def proof_digest(path: Column) -> Column:
    """SHA-256 of the siblings of a path, one after the other."""
    return F.sha2(F.translate(F.coalesce(path, F.lit("")), "<>,", ""), 256)
