"""Near-copies by an n-gram Jaccard join with adaptive multi-match prefixes.

1. Only texts with enough shingles that occur elsewhere can have a partner
   (``shared.shared_keys``); equal shingle sets become one class.
2. Shingles are ordered by the number of classes that have them. Two sets of n and m
   shingles with Jaccard >= s share at least l shingles of their prefixes of length
   n - ceil(s n) + l and m - ceil(s m) + l, for every l up to the overlap. Each class
   takes the l with the least estimated cost: a longer prefix reads more lists, but a
   pair must then share l of its shingles before it is verified. A pair is a candidate
   if it shares min(l, l') shingles of the two prefixes, cut to what its sizes ask for.
3. Star rounds link the members of a shingle's list to one pivot, the set with the
   fewest rare shingles, and join what is linked; a large group of near-copies costs one
   pair per member. All candidate pairs that are still in different components are then
   counted and verified, so no link between components is lost. Maps of the shingles'
   parities, which bound how much two sets differ, rule most of these pairs out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from raterkit.llm.common import ROW, packed, unpacked
from raterkit.llm.components import components
from raterkit.llm.shared import shared_keys
from raterkit.llm.store import Store, build
from raterkit.llm.textarrays import buffer_of, groups_of, shingles
from raterkit.operators.skew import salted_join
from raterkit.session import discard, materialize, ship_package

#: Longest adaptive extension of a prefix.
MATCHES = 4
#: Reading one list entry costs as much as comparing so many shingles of a pair.
COMPARED = 16
#: Rounds that link to a pivot before all remaining pairs are counted.
STAR_ROUNDS = 2
#: Bits of the parity map of a set.
MAP_BITS = 512
_SCAN = "doc_id long, key long, n long, digest binary, grams array<long>, map array<long>"


def _parity_map(grams: np.ndarray) -> np.ndarray:
    """One bit per remainder of the hash: whether an odd number of shingles has it."""
    odd = np.bincount((grams % np.uint64(MAP_BITS)).astype(np.int64), minlength=MAP_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _scan(store: Store, size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    longs = pa.list_(pa.int64())
    for batch in batches:
        keys = batch.column(1).to_numpy()
        data, starts = buffer_of(batch.column(2))
        for i, j in groups_of(starts):
            values, counts = shingles(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i], size)
            ends = np.cumsum(counts)
            found = store.get(keys[i:j])
            grams = [values[e - c : e] if f is not None else None for f, e, c in zip(found, ends, counts)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[i:j],
                    batch.column(1)[i:j],
                    pa.array(counts, pa.int64()),
                    pa.array([None if g is None else hashlib.sha256(g.tobytes()).digest() for g in grams], pa.binary()),
                    pa.array([None if g is None else g.view(np.int64) for g in grams], longs),
                    pa.array([None if g is None else _parity_map(g) for g in grams], longs),
                ],
                names=["doc_id", "key", "n", "digest", "grams", "map"],
            )


def _needed(n: Column, percent: int) -> Column:
    """ceil(percent * n / 100), in integers."""
    return F.floor((n * percent + 99) / 100).cast("int")


def _prefixes(classes: DataFrame, percent: int) -> DataFrame:
    """t, cid, n, l, rare, at: the adaptive prefix of every class that can have a partner.

    ``at`` is the shingle's place in the class's order; the ``rare`` shingles, which no
    other class has, come first.
    """
    tokens = classes.select("cid", "n", F.explode("grams").alias("t"))
    often = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    lists = (
        tokens.join(often, "t")
        .groupBy("cid", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("a"))
        .withColumn("need", _needed(F.col("n"), percent))
        .filter(F.size("a") >= F.col("need"))
    )
    spare = F.size("a") - F.col("need")

    def cost(matches: int) -> Column:
        read = F.aggregate(F.slice("a", F.lit(1), spare + matches), F.lit(0.0), lambda s, x: s + (x["df"] - 1))
        estimate = read * (1 + F.col("n") / (COMPARED * matches))
        return F.when(F.col("need") >= matches, F.struct(estimate.alias("cost"), F.lit(matches).alias("l")))

    chosen = lists.withColumn("l", F.array_min(F.array_compact(F.array(*(cost(k) for k in range(1, MATCHES + 1)))))["l"])
    rows = chosen.select(
        F.posexplode(F.slice("a", F.lit(1), spare + F.col("l"))["t"]).alias("i", "t"),
        "cid",
        "n",
        "l",
        (F.col("n") - F.size("a")).alias("rare"),
    )
    return rows.withColumn("at", F.col("rare") + F.col("i")).drop("i")


def _comparable(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _in_pair_prefix(a: str, b: str, percent: int, matches: Column) -> Column:
    """Whether a shared shingle lies in the prefixes that this pair needs.

    The pair's sizes fix the overlap it must reach, at least ceil(s n) of either side, so
    its own prefixes are shorter, and the same number of matches must lie in them.
    """
    n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
    overlap = _overlap(n_a, n_b, percent)
    return (F.col(f"at_{a}") < n_a - overlap + matches) & (F.col(f"at_{b}") < n_b - overlap + matches)


def _overlap(n_a: Column, n_b: Column, percent: int) -> Column:
    """The smallest intersection with 100 * intersection >= percent * union."""
    return F.floor(((n_a + n_b) * percent + 99 + percent) / (100 + percent))


def _maps_allow(percent: int) -> Column:
    """Parity maps differ in at most as many bits as the sets in shingles, so pairs whose
    maps differ in more than a similar pair's sets can are none."""
    differing = sum((F.bit_count(F.col("map_a")[k].bitwiseXOR(F.col("map_b")[k])) for k in range(MAP_BITS // 64)), F.lit(0))
    n_a, n_b = F.col("n_a"), F.col("n_b")
    return differing <= n_a + n_b - 2 * _overlap(n_a, n_b, percent)


def _verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose shingle sets are similar enough."""
    left = classes.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("grams").alias("g_a"))
    right = classes.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("grams").alias("g_b"))
    both = pairs.join(left, "a").join(right, "b")
    common = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("g_a", "g_b")).alias("c"))
    return common.filter(F.col("c") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("c")) * percent).select("a", "b")


def _open_lists(prefixes: DataFrame, roots: DataFrame | None, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Prefix rows with their component, and the pivot of each list that spans components."""
    if roots is None:
        rows = prefixes.withColumn("root", F.col("cid"))
    else:
        rows = prefixes.join(roots.withColumnRenamed("node", "cid"), "cid", "left")
        rows = rows.withColumn("root", F.coalesce("root", "cid"))
    pivot = F.min(F.struct(*order, *(F.col(c).alias(f"p_{c}") for c in ("cid", "n", "root", "at"))))
    lists = rows.groupBy("t").agg(pivot.alias("p"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    return rows, lists.select("t", "p.p_cid", F.col("p.p_n").alias("n_p"), "p.p_root", F.col("p.p_at").alias("at_p"))


def class_links(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) that connect what is connected, and the roots of the classes linked."""
    prefixes = materialize(_prefixes(classes, percent), "prefixes")
    links, roots = None, None
    for number in range(STAR_ROUNDS):
        order = [F.col("rare")] if number == 0 else [F.xxhash64("cid", F.lit(number)).alias("h")]
        rows, lists = _open_lists(prefixes, roots, order)
        pairs = (
            rows.withColumnsRenamed({"n": "n_r", "at": "at_r"})
            .join(lists, "t")
            .filter((F.col("root") != F.col("p_root")) & _comparable(F.col("n_r"), F.col("n_p"), percent))
            .filter(_in_pair_prefix("r", "p", percent, F.lit(1)))
            .select(F.col("cid").alias("a"), F.col("p_cid").alias("b"))
            .distinct()
        )
        links, roots = _extended(links, _verified(pairs, classes, percent))
    rows, lists = _open_lists(prefixes, roots, [F.col("rare")])
    open_rows = rows.join(lists.select("t"), "t").join(classes.select("cid", "map"), "cid")
    side = lambda x: open_rows.select(
        "t", F.col("cid").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "l", "at", "root", "map"))
    )
    pairs = (
        side("a")
        .join(side("b"), "t")
        .filter((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & _comparable(F.col("n_a"), F.col("n_b"), percent))
        .filter(_in_pair_prefix("a", "b", percent, F.least("l_a", "l_b")) & _maps_allow(percent))
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("matches"), F.first(F.least("l_a", "l_b")).alias("l"))
        .filter("matches >= l")
        .select("a", "b")
    )
    return _extended(links, _verified(pairs, classes, percent))


def _extended(links: DataFrame | None, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links so far and their roots. ``components`` keeps the last of its rounds only."""
    found = materialize(more, "class-links")
    links = found if links is None else links.unionByName(found)
    return links, materialize(components(links), "class-roots")


def near_copies(
    docs: DataFrame, words: int, percent: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, key, n_shingles, component_id, digest: one row per input row.

    Lower-cased (A-Z) words; a set of distinct ``words``-word shingles, or the whole
    sequence of a shorter text. Texts link at 100 * intersection >= percent * union, and
    ``component_id`` is the smallest id that links reach. Null, empty and blank texts have
    no shingles, no links and their own id. Repeated rows and rows with equal or null ids
    are rows like others; a null id is never the smallest unless alone. ``key`` is a hash of id and
    text; ``digest`` is null if the row has no partner. Other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(key), F.col(text)).alias("key"), F.col(text).alias("text"))
    keys_of = partial(shingles, size=words)
    similar = shared_keys(texts.select("key", "text"), keys_of, percent / 100, with_marks=False)
    store = build(similar.dropDuplicates(["key"]), "similar-texts")
    scanned = materialize(texts.mapInArrow(partial(_scan, store, words), _SCAN), "shingle-scan")
    rows = materialize(scanned.select("doc_id", "key", "n", "digest"), "shingle-rows")
    members = rows.filter("digest IS NOT NULL")
    chosen = members.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("key").alias("key"))
    classes = materialize(
        scanned.filter("digest IS NOT NULL")
        .select("digest", "key", "n", "grams", "map")
        .join(chosen, ["digest", "key"])
        .dropDuplicates(["digest"])
        .select(F.monotonically_increasing_id().alias("cid"), "digest", "rep", "n", "grams", "map"),
        "shingle-classes",
    )
    discard(scanned)  # the arrays are kept once, by class
    _, roots = class_links(classes, percent)
    rooted = classes.select("cid", "digest", "rep").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    rooted = materialize(rooted.select("digest", "rep", F.coalesce("root", "cid").alias("root")), "class-members")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = materialize(rooted.join(least, "root").select("digest", "component_id"), "class-components")
    grouped = salted_join(members.select("doc_id", "key", F.col("n").alias("n_shingles"), "digest"), of_class, ["digest"])
    alone = rows.filter("digest IS NULL").select(
        "doc_id", "key", F.col("n").alias("n_shingles"), "digest", F.col("doc_id").alias("component_id")
    )
    return grouped.unionByName(alone)


def keep_one_of_each(docs: DataFrame, words: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near-copies: of each component the row with the smallest id stays.

    Columns are unchanged. Of rows with that id, the one with the smallest hash stays, and
    of identical rows one. Rows without a partner never meet a shuffled group.
    """
    found = materialize(near_copies(docs, words, percent, key, text).filter("digest IS NOT NULL"), "near-copies")
    stays = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))).alias("s"))
    chosen = stays.select(F.col("s.key").alias("_key"), F.lit(True).alias("_stays"))
    marked = materialize(
        found.select(F.col("key").alias("_key")).distinct().join(chosen.distinct(), "_key", "left").select("_key", F.coalesce("_stays", F.lit(False)).alias("_stays")),
        "near-copy-keys",
    )
    rows = packed(docs).withColumn("_key", F.xxhash64(F.col(f"{ROW}.`{key}`"), F.col(f"{ROW}.`{text}`")))
    judged = rows.join(marked, "_key", "left")
    once = judged.filter("_stays").dropDuplicates(["_key"])
    return unpacked(judged.filter("_stays IS NULL").unionByName(once), docs)
