"""Mix sources to target weights by Poisson replication.

Each document is repeated k times, k being the inverse of a Poisson distribution at a
number hashed from the seed, the document's id and text, and, for rows that agree in both,
their ordinal. The mean is the source's target repetition rate, so the expected size of
every source is its target, and a document's count never depends on other documents, on the
partitioning or on the run; of rows that agree, it is only open which has which ordinal.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from raterkit.llm.common import ROW, hash_share, packed, unpacked
from raterkit.operators.ordering import with_index
from raterkit.operators.skew import salted_join
from raterkit.session import materialize, shuffle_slots

#: Cells of all sources' tables of the distribution (8 bytes each) up to which they are
#: broadcast; beyond it the rows are joined.
BROADCAST_CELLS = 1_000_000
#: Target share of a source = its size ** ALPHA, normalised: small sources gain, large ones shrink.
ALPHA = 0.5
SEED = "mix-1"


def source_rates(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    alpha: float = ALPHA,
    budget: float | None = None,
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """source, size (characters), rate (mean repetitions per document).

    ``weights`` gives target shares by source (absent ones get 0); without it the share
    is proportional to size ** alpha. ``budget`` is the target total in characters, by
    default that of the input. A null source is a source of its own. A source with no
    characters has rate 1, since no repetition can give it weight.
    """
    size = F.length(F.coalesce(F.col(text), F.lit(""))).cast("bigint")
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("size"))
    if weights is None:
        share = F.pow(F.col("size").cast("double"), F.lit(alpha))
    else:
        pairs = [F.struct(F.lit(k).alias("k"), F.lit(float(v)).alias("v")) for k, v in weights.items()]
        found = F.filter(F.array(*pairs), lambda x: x["k"] == F.col("source"))
        share = F.coalesce(F.get(found, F.lit(0))["v"], F.lit(0.0))
    sized = materialize(sizes.withColumn("share", share), "source-sizes")
    all_size, all_share = sized.filter("size > 0").agg(F.sum("size"), F.sum("share")).first()
    wanted = float(all_size or 0 if budget is None else budget)
    part = F.col("share") / F.lit(all_share) if all_share else F.lit(0.0)
    rate = F.when(F.col("size") > 0, part * wanted / F.col("size")).otherwise(1.0)
    return sized.select("source", "size", rate.alias("rate"))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """source, cdf: the cumulative Poisson probabilities of 0, 1, 2, ... at the source's rate.

    The array goes 12 standard deviations and 24 beyond the mean, past the last value a
    52-bit number can reach. Logarithms keep large rates from underflowing.
    """
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 24).cast("int")
    cells = rates.select("source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    order = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log_p = -F.col("rate") + F.when(F.col("k") > 0, F.col("k") * F.log("rate")).otherwise(0.0) - F.sum(
        F.when(F.col("k") > 0, F.log(F.col("k").cast("double"))).otherwise(0.0)
    ).over(order)
    p = F.when(F.col("rate") > 0, F.exp(log_p)).otherwise(F.when(F.col("k") == 0, 1.0).otherwise(0.0))
    return (
        cells.withColumn("p", p)
        .withColumn("c", F.sum("p").over(order))
        .groupBy("source")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf"))
    )


def invert(cdf: Column, share: Column) -> Column:
    """The smallest k whose cumulative probability exceeds ``share``."""
    return F.size(F.filter(cdf, lambda c: c <= share))


def _with_ordinals(rows: DataFrame, key: Column, text: Column) -> DataFrame:
    """Add ``_ordinal``: 1, 2, ... among the rows that agree in key and text.

    Only rows that are repeated are numbered, by a range-partitioned index of their hashes,
    so a third of all rows may be one repeated row.
    """
    same = ["_h1", "_h2"]
    keyed = rows.withColumns({"_h1": F.xxhash64(key, text), "_h2": F.xxhash64(F.lit(1), text, key)})
    counts = keyed.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    counts = materialize(counts, "repeated")
    if not counts.limit(1).count():
        return rows.withColumn("_ordinal", F.lit(1).cast("bigint"))
    again = salted_join(keyed, counts.select(*same), same, "left_semi", counts).withColumn("_place", F.monotonically_increasing_id())
    again = materialize(again, "repeated-rows")
    placed = with_index(again.select(*same, "_place"), [*same, "_place"], "_at")
    first = placed.groupBy(*same).agg(F.min("_at").alias("_first"))
    numbered = salted_join(placed, first, same, counts=counts).select("_place", (F.col("_at") - F.col("_first") + 1).alias("_ordinal"))
    repeated = again.join(numbered, "_place").select(*rows.columns, "_ordinal")
    once = salted_join(keyed, counts.select(*same), same, "left_anti", counts).select(*rows.columns, F.lit(1).cast("bigint").alias("_ordinal"))
    return once.unionByName(repeated)


def _copies(docs: DataFrame, weights, alpha: float, budget: float | None, seed: str, key: str, source: str, text: str) -> DataFrame:
    """Packed documents, ``_copy`` (from 1) and ``_order``, in their places."""
    tables = materialize(
        poisson_tables(source_rates(docs, weights, alpha, budget, source, text)), "poisson"
    ).select(F.struct("source").alias("_source"), "cdf")
    field = lambda name: F.col(f"{ROW}.`{name}`")
    rows = _with_ordinals(packed(docs), field(key), field(text))
    part = lambda value: F.coalesce(value, F.lit("null"))
    origin = F.concat_ws(":", F.lit(seed), part(field(key).cast("string")), part(F.md5(field(text))), F.col("_ordinal").cast("string"))
    rows = rows.select(ROW, F.struct(field(source).alias("source")).alias("_source"), origin.alias("_origin"))
    if (tables.agg(F.sum(F.size("cdf"))).first()[0] or 0) <= BROADCAST_CELLS:
        known = rows.join(F.broadcast(tables), "_source")
    else:
        known = salted_join(rows, tables, ["_source"])
    counted = known.withColumn("n", invert(F.col("cdf"), hash_share(F.col("_origin")))).filter("n > 0")
    copies = counted.select(ROW, "_origin", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_copy"))
    order = F.md5(F.concat_ws(":", "_origin", F.col("_copy").cast("string")))
    return (
        copies.select(ROW, "_copy", order.alias("_order"))
        .repartition(shuffle_slots(docs.sparkSession), "_order")
        .sortWithinPartitions("_order")
    )


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    alpha: float = ALPHA,
    budget: float | None = None,
    seed: str = SEED,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """Every document as often as its source's rate says, in a global random order.

    All columns of ``docs``, then ``copy`` (from 1) and ``shuffle_key``; input columns of
    those two names are replaced. A third of all rows may share a source: sizes are
    combined before the shuffle, and documents meet their source's small table by
    broadcast (or a salted join beyond ``BROADCAST_CELLS``). Rows go to tasks by the
    hash of their copy, so no source, size, id or repetition rate makes a task large; the
    order is by task and, within it, by ``shuffle_key``. Rows with equal or null ids, and
    equal rows, are counted each by itself. An empty table gives an empty table.
    """
    columns = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    found = _copies(docs, weights, alpha, budget, seed, key, source, text)
    return found.select(*(F.col(f"{ROW}.`{c}`").alias(c) for c in columns), F.col("_copy").alias("copy"), F.col("_order").alias("shuffle_key"))


def mixed(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    alpha: float = ALPHA,
    budget: float | None = None,
    seed: str = SEED,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """As ``mix``, with the columns of ``docs`` only, whatever their names, and their values."""
    return unpacked(_copies(docs, weights, alpha, budget, seed, key, source, text), docs)
