"""Cleaning of ratings: restructuring, null rules, de-duplication, count filters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F, types as T

from raterkit.functions.columns import nonzero_flag, replace_two, text_digest
from raterkit.operators.ordering import with_index
from raterkit.operators.skew import key_counts, salted_join
from raterkit.session import materialize


# ---- restructuring -------------------------------------------------------------------

def explode_ratings(df: DataFrame, column: str = "ratings", drop: Sequence[str] = ("source",)) -> DataFrame:
    """One row per element of the array; an empty or null array keeps one row of nulls."""
    return df.drop(*drop).withColumn(column, F.explode_outer(column))


def flatten(df: DataFrame, sep: str = ".", only: Sequence[str] | None = None) -> DataFrame:
    """Struct fields, at any depth, as columns named parent<sep>child."""

    def leaves(dtype: T.StructType, path: str, label: str):
        for field in dtype.fields:
            at, name = f"{path}.`{field.name}`", f"{label}{field.name}"
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, at, f"{name}{sep}")
            else:
                yield F.col(at).alias(name)

    columns = []
    for field in df.schema.fields:
        wanted = only is None or field.name in only
        if wanted and isinstance(field.dataType, T.StructType):
            columns.extend(leaves(field.dataType, f"`{field.name}`", f"{field.name}{sep}"))
        else:
            columns.append(F.col(f"`{field.name}`"))
    return df.select(*columns)


def unpack(df: DataFrame, column: str = "ratings", sep: str = ".") -> DataFrame:
    """Replace a struct column by its fields (nested ones with dotted names)."""
    fields = [f.name for f in df.schema[column].dataType.fields]
    rest = [F.col(f"`{c}`") for c in df.columns if c != column]
    return flatten(df.select(*rest, *(F.col(f"`{column}`.`{f}`") for f in fields)), sep, only=fields)


# ---- ids and values ------------------------------------------------------------------

def dense_ids(
    df: DataFrame, value: str, order: Sequence[str], name: str, long_text: bool = False, numbered: DataFrame | None = None
) -> DataFrame:
    """Number the distinct values 0, 1, 2, ... by first appearance in ``order``.

    Null is one more distinct value. With ``long_text`` the values are compared by their
    digest: texts are read whole, but only 32 bytes of each are shuffled and sorted.
    ``numbered`` holds the same rows, if ``df`` is costly to compute twice.
    """
    keys = ["_key", "_missing"]
    key = text_digest(F.col(value)) if long_text else F.coalesce(F.col(value).cast("string"), F.lit(""))
    added = {"_key": key, "_missing": F.col(value).isNull()}
    keyed = df.withColumns(added)
    first = (keyed if numbered is None else numbered.withColumns(added)).groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("n"))
    ids = with_index(first, ["_first", *keys], name)
    return salted_join(keyed, ids.select(*keys, name), keys, counts=ids.select(*keys, "n")).drop(*keys)


def fill_zero(df: DataFrame) -> DataFrame:
    """Null becomes 0 in every column: number 0, text '0', boolean false."""
    numbers = df.na.fill(0)
    return numbers.na.fill("0").na.fill(False)


def booleans_to_int(df: DataFrame) -> DataFrame:
    flags = {n: F.col(f"`{n}`").cast("int") for n, t in df.dtypes if t == "boolean"}
    return df.withColumns(flags) if flags else df


# ---- de-duplication and filters ------------------------------------------------------

def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in ``order``; null keys compare equal.

    Rows that tie in ``order`` are chosen by a hash of the whole row, the same way on every
    run; of identical rows one stays. Only keys, order columns and hashes are aggregated,
    map-side first. The rows are then fetched by key and hash, which spreads a key with a
    third of all rows, and are hashed against the narrow side, not sorted. Where keys and
    order columns are the whole row, the aggregate is the result, and nothing is fetched.
    """
    names = df.columns
    front = [c for c in order if c not in keys]
    if set(names) == {*keys, *front} and front and all(_exact(df.schema[c].dataType) for c in keys):
        ordered = F.min(F.struct(*(F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(front)))).alias("_first")
        chosen = df.groupBy(*(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keys))).agg(ordered)
        places = {c: f"_k{i}" for i, c in enumerate(keys)} | {c: f"_first._o{i}" for i, c in enumerate(front)}
        return chosen.select(*(F.col(places[n]).alias(n) for n in names))
    key = {c: f"_k{i}" for i, c in enumerate(keys)}
    rest = {c: f"_o{i}" for i, c in enumerate(front)}
    row_hash = F.xxhash64(*(F.col(f"`{n}`") for n in names if n not in key and n not in rest), F.lit(0))
    hashed = df.withColumn("_hash", row_hash)
    narrow = hashed.select(*(F.col(f"`{c}`").alias(a) for c, a in (key | rest).items()), "_hash")
    counted = narrow.groupBy(*narrow.columns).agg(F.count(F.lit(1)).alias("_n"))
    first = counted.groupBy(*key.values()).agg(F.min(F.struct(*rest.values(), "_hash", "_n")).alias("_first"))
    first = materialize(first.select(*key.values(), "_first.*"), "first-keys")

    def fetched(chosen: DataFrame) -> DataFrame:
        same = [F.col(f"rows.`{c}`").eqNullSafe(F.col(f"chosen.{a}")) for c, a in (key | rest).items()]
        on = reduce(and_, same, F.col("rows._hash") == F.col("chosen._hash"))
        found = hashed.alias("rows").join(chosen.hint("shuffle_hash").alias("chosen"), on, "left_semi")
        return found.select(*(F.col(f"`{n}`") for n in names))

    if not first.filter("_n > 1").limit(1).count():
        return fetched(first)
    once = fetched(first.filter("_n = 1"))
    return once.unionByName(fetched(first.filter("_n > 1")).dropDuplicates(list(keys)))


def _exact(kind: T.DataType) -> bool:
    """Whether grouping keeps a value as it is: of floats, -0.0 becomes 0.0."""
    return isinstance(kind, T.AtomicType) and not isinstance(kind, (T.FloatType, T.DoubleType))


def keep_frequent(df: DataFrame, key: str, at_least: int, counts: DataFrame | None = None) -> DataFrame:
    """Rows whose ``key`` occurs ``at_least`` times; rows with a null key are dropped.

    The counts (key, n) are written out, if they are not given: one pass makes them, and
    the planner knows their true size when it chooses how to join them.
    """
    counts = materialize(key_counts(df, [key]), "counts") if counts is None else counts
    kept = counts.filter(F.col("n") >= at_least).select(key)
    return salted_join(df, kept, [key], "left_semi", counts)


def keep_active(
    df: DataFrame,
    annotator_floor: int,
    comment_floor: int,
    annotator: str = "annotator_id",
    comment: str = "comment_id",
) -> DataFrame:
    """Annotators first, then comments on what is left; one pass, not a fixpoint.

    Comments are counted on the two key columns, not on whole rows.
    """
    per_annotator = materialize(key_counts(df, [annotator]), "counts")
    narrow = keep_frequent(df.select(annotator, comment), annotator, annotator_floor, per_annotator)
    per_comment = materialize(key_counts(narrow, [comment]), "counts")
    kept = keep_frequent(df, annotator, annotator_floor, per_annotator)
    return keep_frequent(kept, comment, comment_floor, per_comment)


def refuse_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df``, after a check that no two rows have the same keys."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys).first()
    if twice is not None:
        raise ValueError(f"more than one row for {twice.asDict()}")
    return df


def keep_comments(df: DataFrame, comments: DataFrame, key: str = "comment_id") -> DataFrame:
    """Rows whose comment is in ``comments`` (one row per comment)."""
    return salted_join(df, comments.select(key), [key], "left_semi")


# ---- whole preparation of the two data sets ------------------------------------------

FLAT_FLOORS = (20, 2)  # fixed values: annotators >= 20, then comments >= 2
NESTED_FLOORS = (21, 5)  # fixed values: strictly more than 20, then more than 4


def prepare_flat(ratings: DataFrame, floors: tuple[int, int] = FLAT_FLOORS, score: str = "hatespeech") -> DataFrame:
    """Filter, fill nulls, booleans to int, binary label."""
    kept = keep_active(ratings, *floors)
    filled = booleans_to_int(fill_zero(kept))
    return filled.withColumn(f"binary_{score}", replace_two(F.col(score)).cast("int"))


def prepare_nested(
    nested: DataFrame,
    order: Sequence[str],
    floors: tuple[int, int] = NESTED_FLOORS,
    score: str = "toxic_score",
) -> DataFrame:
    """Explode, number comments and workers, keep first ratings, label, filter.

    ``order`` gives the input order of the comments; ratings of a comment follow their
    position in the array. The exploded rows are written out once, with a number each.
    Comments and workers are numbered, first ratings chosen and floors applied on a narrow
    table of keys, in which a digest stands for a comment; the rows meet its result once.
    """
    at = nested.drop("source").select("*", F.posexplode_outer("ratings").alias("_pos", "_rating"))
    rows = unpack(at.drop("ratings").withColumnRenamed("_rating", "ratings"))
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "ratings")
    by_input = [*order, "_pos"]
    digest = F.when(F.col("comment").isNotNull(), F.sha2("comment", 256))
    keys = rows.select("_row", *by_input, digest.alias("_digest"), "worker_id")
    keys = dense_ids(materialize(keys, "rating-keys"), "_digest", by_input, "comment_id")
    keys = dense_ids(materialize(keys, "rating-keys"), "worker_id", by_input, "annotator_id")
    keys = keys.select("_row", *by_input, "comment_id", "annotator_id")
    first = first_rows(materialize(keys, "rating-keys"), ["annotator_id", "comment_id"], [*by_input, "_row"])
    kept = keep_active(materialize(first, "first"), *floors).select("_row", "comment_id", "annotator_id")
    found = rows.join(kept.hint("shuffle_hash"), "_row").drop("_row", "_pos")
    return found.withColumn(f"binary_{score}", nonzero_flag(F.col(score)))
