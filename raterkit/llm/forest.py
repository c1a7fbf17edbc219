"""Near-copies by a MinHash LSH forest.

1. A text's set of shingles is reduced to a signature of ORDERS * DEEPEST min-hashes; texts
   with equal sets become one class.
2. Each order of the signature is one tree of the forest: the classes sorted by DEEPEST
   of the hashes, read as a key. Two sets of similarity s agree on the first d hashes with
   probability s^d. Classes that share the first LEAST hashes of an order with no other one
   are left out of it.
3. Neighbours in a sorted order have the longest common prefixes. They are verified on
   the full sets and joined, first along two orders, then along all of them.
4. What neighbours did not join is compared by region, the classes below one node of a tree.
   A region starts at depth LEAST and is parted one level deeper as long as it is crowded
   and DEEPEST is not reached. Only pairs of different components meet: classes outside a
   region's largest component against all of the region, in tiles, so any size is whole.

Before full sets, parities and signatures are compared. The parity map of a set has one bit
for each remainder of the shingles' hashes, set if an odd number of them has it; two maps
differ in at most as many bits as the sets in shingles, so this rules out no link. Similar
sets agree in fewer than ``agreement`` hashes with a probability of MISSED. A link at the threshold itself is no candidate with a
probability of (1 - s^DEEPEST)^ORDERS at most, below 1e-6 at 0.85, and (1 - s^LEAST)^ORDERS,
about 1e-10, where regions are not crowded; links between copies of copies are found
another way, as components are what counts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from raterkit.llm.common import on_groups
from raterkit.llm.links import Links, comparable, verified
from raterkit.llm.textarrays import buffer_of, groups_of, mix, shingles
from raterkit.operators.skew import salted_join
from raterkit.session import discard, materialize, ship_package

ORDERS = 24
#: Hashes that classes of a region share, at least and at most.
LEAST, DEEPEST = 3, 5
HASHES = ORDERS * DEEPEST
#: Bits of a hash in an order's key; DEEPEST of them fit a long.
KEY_BITS = 12
#: Orders whose neighbours are joined before all others'.
FIRST_ORDERS = 2
#: Classes outside its largest component that make a region crowded, and the side of a tile.
CROWDED = 256
#: Bits of a parity map.
MAP_BITS = 1024
#: Probability that the signatures of two sets at the threshold rule them out.
MISSED = 1e-9

_SEEDS = mix(np.arange(HASHES, dtype=np.uint64) + np.uint64(1 << 33))
_FACTORS = mix(np.arange(HASHES, dtype=np.uint64) + np.uint64(1 << 34)) | np.uint64(1)
_SIGNED = "doc_id long, k1 long, k2 long, n long, digest binary, signature binary, map binary"
_ORDERED = "tree int, path long, cid long"
_BRANCH = f"{_ORDERED}, before long"
_CELL = ("tree", "region", "tile", "column")


def agreement(percent: int) -> int:
    """The least number of equal min-hashes of two sets that are candidates."""
    s, below = percent / 100, 0.0
    for agree in range(HASHES + 1):
        below += math.comb(HASHES, agree) * s**agree * (1 - s) ** (HASHES - agree)
        if below > MISSED:
            return agree
    return HASHES


def least_overlap(total: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection of two sets with ``total`` members together that link."""
    return -(-total * percent // (100 + percent))


def parity_map(values: np.ndarray) -> np.ndarray:
    odd = np.bincount((values % np.uint64(MAP_BITS)).astype(np.int64), minlength=MAP_BITS) & 1
    return np.packbits(odd.astype(np.uint8))


def signatures(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """16 bits of every min-hash of each set; sets without members are left out."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    found = np.zeros((len(starts), HASHES), np.uint64)
    for k in range(HASHES if len(starts) else 0):
        found[:, k] = np.minimum.reduceat((values ^ _SEEDS[k]) * _FACTORS[k], starts)
    return (mix(found) & np.uint64(0xFFFF)).astype("<u2")


def _sign(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, starts = buffer_of(batch.column(3))
        for i, j in groups_of(starts):
            values, counts = shingles(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i], size)
            ends = np.cumsum(counts)
            signed = iter(signatures(values, counts))
            sets = [values[e - c : e] if c else None for e, c in zip(ends, counts)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k)[i:j] for k in range(3)),
                    pa.array(counts, pa.int64()),
                    pa.array([None if s is None else hashlib.sha256(s.tobytes()).digest() for s in sets], pa.binary()),
                    pa.array([None if s is None else next(signed).tobytes() for s in sets], pa.binary()),
                    pa.array([None if s is None else parity_map(s).tobytes() for s in sets], pa.binary()),
                ],
                names=["doc_id", "k1", "k2", "n", "digest", "signature", "map"],
            )


def _as_matrix(column: pa.Array, dtype="<u2", width: int = HASHES) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _as_maps(column: pa.Array) -> np.ndarray:
    return _as_matrix(column, "<u8", MAP_BITS // 64)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A class's place in every order."""
    shifts = np.arange(DEEPEST - 1, -1, -1) * KEY_BITS
    for batch in batches:
        hashes = _as_matrix(batch.column(1)).astype(np.int64) & ((1 << KEY_BITS) - 1)
        paths = (hashes.reshape(-1, ORDERS, DEEPEST) << shifts).sum(2)
        trees = np.tile(np.arange(ORDERS, dtype=np.int32), len(hashes))
        cids = np.repeat(batch.column(0).to_numpy(), ORDERS)
        yield pa.RecordBatch.from_arrays([pa.array(trees), pa.array(paths.ravel()), pa.array(cids)], names=["tree", "path", "cid"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows that share their first hashes with a neighbour, and the class before them.

    The first and the last row of a task may have a neighbour in another one, so they stay.
    """
    shift = KEY_BITS * (DEEPEST - LEAST)
    held = None  # the last row, which waits for its successor
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, path, cid = (batch.column(k).to_numpy() for k in range(3))
        if held is not None:
            tree, path, cid = (np.append(h, x) for h, x in zip(held[0], (tree, path, cid)))
        near = np.zeros(len(tree), bool)  # to the row before
        near[1:] = (tree[1:] == tree[:-1]) & (path[1:] >> shift == path[:-1] >> shift)
        before = np.append(0, cid[:-1])
        kept = near.copy()
        kept[:-1] |= near[1:]
        if held is None:
            kept[0] = True
        else:
            near[0], before[0], kept[0] = held[1], held[2], held[3] or kept[0]
        yield _branches(tree, path, cid, before, near, kept, slice(0, -1))
        held = (tree[-1:], path[-1:], cid[-1:]), near[-1], before[-1], kept[-1]
    if held is not None:
        (tree, path, cid), near, before, _ = held
        yield _branches(tree, path, cid, np.array([before]), np.array([near]), np.array([True]), slice(None))


def _branches(tree, path, cid, before, near, kept, part: slice) -> pa.RecordBatch:
    chosen = np.flatnonzero(kept[part])
    columns = [pa.array(tree[chosen], pa.int32()), pa.array(path[chosen]), pa.array(cid[chosen]), pa.array(before[chosen], mask=~near[chosen])]
    return pa.RecordBatch.from_arrays(columns, names=["tree", "path", "cid", "before"])


def _compare(percent: int, rows: pa.Table) -> pa.Table:
    """Pairs of one tile, of different components, that sizes, parities and signatures allow."""
    cid, root, n, rest = (rows[c].to_numpy(zero_copy_only=False) for c in ("cid", "root", "n", "rest"))
    hashes, maps = _as_matrix(rows["signature"].combine_chunks()), _as_maps(rows["map"].combine_chunks())
    least, found = agreement(percent), set()
    others = np.flatnonzero(rest)
    for i in np.flatnonzero(rows["inner"].to_numpy(zero_copy_only=False)):
        j = others[root[others] != root[i]]
        apart = n[j] + n[i] - 2 * least_overlap(n[j] + n[i], percent)
        j = j[np.bitwise_count(maps[j] ^ maps[i]).sum(1, dtype=np.int64) <= apart]
        agree = (hashes[j] == hashes[i]).sum(1)
        for k, equal in zip(j[agree >= least].tolist(), agree[agree >= least].tolist()):
            found.add((min(cid[i], cid[k]), max(cid[i], cid[k]), equal))
    a, b, agree = zip(*found) if found else ((), (), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "agree": pa.array(agree, pa.int64())})


def _agreeing(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a, b, agree of the pairs that sizes, parities and signatures allow."""
    side = lambda x: classes.select(F.col("cid").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "signature", "map")))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(comparable(F.col("n_a"), F.col("n_b"), percent))
    needed = both.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "signature_a", "signature_b", "map_a", "map_b")
    return needed.mapInArrow(partial(_allowed, percent, agreement(percent)), "a long, b long, agree long")


def _allowed(percent: int, least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total = batch.column(2).to_numpy()
        differ = np.bitwise_count(_as_maps(batch.column(5)) ^ _as_maps(batch.column(6))).sum(1, dtype=np.int64)
        agree = (_as_matrix(batch.column(3)) == _as_matrix(batch.column(4))).sum(1)
        kept = (agree >= least) & (differ <= total - 2 * least_overlap(total, percent))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(agree)], names=["a", "b", "agree"]).filter(pa.array(kept))


def _regions(rows: DataFrame, depth: int) -> DataFrame:
    return rows.withColumn("region", F.shiftright("path", KEY_BITS * (DEEPEST - depth)))


def _tiles(branches: DataFrame, links: Links) -> DataFrame:
    """tree, region, tile, column, cid, root, rest, inner: what is to be compared.

    In a tile, ``rest`` rows (outside the region's largest component) meet ``inner`` rows.
    """
    rows, ready = materialize(links.rooted(branches.select("tree", "path", "cid"), "cid", "root"), "forest-rows"), None
    for depth in range(LEAST, DEEPEST + 1):
        by_root = _regions(rows, depth).groupBy("tree", "region", "root").agg(F.count(F.lit(1)).alias("n"))
        of_region = by_root.groupBy("tree", "region").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("largest"))
        open_regions = materialize(
            of_region.select("tree", "region", "n", F.col("largest.root").alias("main"), (F.col("n") - F.col("largest.n")).alias("n_rest")).filter("n_rest > 0"), "regions"
        )
        counts = open_regions.select("tree", "region", "n")
        there = salted_join(_regions(rows, depth), open_regions.withColumnRenamed("n", "n_all"), ["tree", "region"], counts=counts)
        there = materialize(there, "region-rows")
        small = there if depth == DEEPEST else there.filter(F.col("n_rest") <= CROWDED)
        # equal regions of different depths are different groups
        placed = small.select("tree", F.concat_ws(":", F.lit(depth), "region").alias("region"), "cid", "root", (F.col("root") != F.col("main")).alias("rest"), "n_all", "n_rest")
        ready = placed if ready is None else ready.unionByName(placed)
        if depth == DEEPEST or not there.filter(F.col("n_rest") > CROWDED).limit(1).count():
            break
        rows = there.filter(F.col("n_rest") > CROWDED).select("tree", "path", "cid", "root")
    deal = lambda number, of: F.pmod(F.xxhash64("cid", F.lit(number)), of)
    tiles, columns = F.ceil(F.col("n_all") / CROWDED), F.ceil(F.col("n_rest") / CROWDED)
    ready = ready.withColumn("tiles", tiles).withColumn("columns", columns)
    inner = ready.withColumn("tile", deal(1, F.col("tiles"))).withColumn("column", F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1)))
    rest = ready.filter("rest").withColumn("column", deal(2, F.col("columns"))).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    both = inner.select(*_CELL, "cid", "root", F.lit(False).alias("rest"), F.lit(True).alias("inner")).unionByName(
        rest.select(*_CELL, "cid", "root", F.lit(True).alias("rest"), F.lit(False).alias("inner"))
    )
    return both


def near_copies(docs: DataFrame, words: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Lower-cased (A-Z) words; a set of distinct ``words``-word shingles, or the whole
    sequence of a shorter text. Texts link at 100 * intersection >= percent * union, counted
    on the full sets, and ``component_id`` is the smallest id that links reach; ``kept``
    marks the rows with that id. Null, empty and blank texts have no shingles, no links and
    their own id. Repeated rows and rows with equal or null ids are rows like others; a null
    id is never the smallest unless alone, and then it is kept. Other columns are not read.

    Texts are read twice: for signatures, and, of one member of each class that has a
    neighbour in some order, for its set. Rows that agree in id and text are joined to it
    by one key; of these only one goes on.
    """
    ship_package(docs.sparkSession)
    texts = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.xxhash64(F.col(key), F.col(text)).alias("k1"),
        F.xxhash64(F.lit(1), F.col(text), F.col(key)).alias("k2"),
        F.col(text).alias("text"),
    )
    rows = materialize(texts.mapInArrow(partial(_sign, words), _SIGNED), "forest-texts")
    members = rows.filter("digest IS NOT NULL")
    chosen = members.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min(F.struct("k1", "k2", "n", "signature", "map")).alias("one"))
    classes = materialize(chosen.select(F.monotonically_increasing_id().alias("cid"), "digest", "rep", "one.*"), "forest-classes")

    order = ["tree", "path", "cid"]
    ordered = classes.select("cid", "signature").mapInArrow(_paths, _ORDERED)
    branches = materialize(ordered.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, _BRANCH), "branches")
    live = classes.join(branches.select("cid").distinct(), "cid", "left_semi").select("cid", "k1", "k2")
    found = texts.join(live, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("cid", "text")
    sets = materialize(found.mapInArrow(partial(_sets, words), "cid long, n long, grams array<long>"), "forest-sets")

    links = Links()
    neighbours = branches.filter("before IS NOT NULL").select(F.least("cid", "before").alias("a"), F.greatest("cid", "before").alias("b"), "tree")
    first = neighbours.filter(F.col("tree") < FIRST_ORDERS).select("a", "b").distinct()
    links.add(verified(_agreeing(first, classes, percent).select("a", "b"), sets, percent))
    apart = links.apart(neighbours.select("a", "b").distinct()).select("a", "b")
    _add_candidates(links, _agreeing(apart, classes, percent), sets, percent)
    tiles = _tiles(branches, links).join(classes.select("cid", "n", "signature", "map"), "cid")
    pairs = tiles.groupBy(*_CELL).applyInArrow(on_groups(_compare, percent), "a long, b long, agree long")
    _add_candidates(links, pairs.distinct(), sets, percent)

    of_class = links.rooted(classes.select("cid", "digest", "rep"), "cid", "root")
    of_class = materialize(of_class.select("digest", "rep", "root"), "forest-members")
    least = of_class.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_digest = materialize(of_class.join(least, "root").select("digest", "component_id"), "forest-components")
    grouped = salted_join(members.select("doc_id", F.col("n").alias("n_shingles"), "digest"), of_digest, ["digest"])
    alone = rows.filter("digest IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return grouped.drop("digest").unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _add_candidates(links: Links, pairs: DataFrame, sets: DataFrame, percent: int) -> None:
    """Verify the pairs that agree best for every two components, then what is still apart."""
    pairs = materialize(pairs, "forest-pairs")
    components = (F.least("root_a", "root_b"), F.greatest("root_a", "root_b"))
    best = links.apart(pairs).groupBy(*components).agg(F.max(F.struct("agree", "a", "b")).alias("x"))
    best = materialize(best.select("x.a", "x.b"), "forest-best")
    links.add(verified(best, sets, percent))
    rest = materialize(links.apart(pairs).select("a", "b").join(best, ["a", "b"], "left_anti"), "forest-rest")
    if rest.limit(1).count():
        links.add(verified(rest, sets, percent))
    for table in (pairs, best, rest):
        discard(table)


def _sets(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, starts = buffer_of(batch.column(1))
        for i, j in groups_of(starts):
            values, counts = shingles(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i], size)
            grams = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(counts, pa.int64()), grams], names=["cid", "n", "grams"])
