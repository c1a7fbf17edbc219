"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from raterkit.session import shuffle_slots

_PIECES = "_pieces"
_SALT = "_salt"


def key_counts(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Rows per non-null key. Combined map-side, so a hot key ships one row per task."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def heavy_keys(counts: DataFrame, keys: Sequence[str]) -> list[tuple]:
    """(*key, pieces) of the keys holding more than 1/slots of all rows.

    ``slots`` is the session's number of reduce tasks. Fewer than ``slots`` keys can be
    that heavy, whatever the data, and their pieces add up to less than twice ``slots``:
    that bound makes it safe to fetch and broadcast them.
    """
    slots = shuffle_slots(counts.sparkSession)
    seen = Observation()
    top = (
        counts.select(*keys, "n")
        .observe(seen, F.sum("n").alias("total"))
        .orderBy(F.desc("n"))
        .limit(slots)
        .collect()
    )
    total = seen.get["total"] if top else 0
    return [(*row[:-1], -(-row["n"] * slots // total)) for row in top if row["n"] * slots > total]


def salted_join(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    counts: DataFrame | None = None,
) -> DataFrame:
    """``many`` joined with ``one`` (at most one row per key), hot keys spread over tasks.

    One pass over the key columns finds the heavy keys. Their rows are dealt into pieces
    by a hash of the row and the matching row of ``one`` is repeated once per piece; all
    other keys join as usual, so the result is that of the plain join. ``how`` is inner,
    left, left_semi or left_anti; rows without a key that left and left_anti keep bypass
    the join if they are many. Pass ``counts`` (keys, n) if they are already known.
    """
    keys = list(keys)
    if counts is None:
        counts = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    found = heavy_keys(counts, keys)
    known = [row for row in found if None not in row]
    if len(known) < len(found) and how in ("left", "left_anti"):
        keyed = many.dropna(subset=keys)
        joined = _join(keyed, one, keys, how, known)
        return joined.unionByName(many.filter(_any_null(keys)), allowMissingColumns=True)
    return _join(many, one, keys, how, known)


def _any_null(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(key).isNull() for key in keys))


def _join(many: DataFrame, one: DataFrame, keys: list[str], how: str, known: list[tuple]) -> DataFrame:
    if not known:
        joined = many.join(one, keys, how)
    else:
        schema = T.StructType([*(many.schema[k] for k in keys), T.StructField(_PIECES, T.IntegerType())])
        heavy = F.broadcast(many.sparkSession.createDataFrame(known, schema))
        pieces = F.coalesce(F.col(_PIECES), F.lit(1))
        piece = F.when(pieces > 1, F.pmod(_row_hash(many), pieces)).otherwise(0)
        dealt = many.join(heavy, keys, "left").withColumn(_SALT, piece.cast("int"))
        repeated = one.join(heavy, keys, "left").withColumn(
            _SALT, F.explode(F.sequence(F.lit(0), pieces - 1))
        )
        joined = dealt.drop(_PIECES).join(repeated.drop(_PIECES), [*keys, _SALT], how)
    extra = [] if how in ("left_semi", "left_anti") else [c for c in one.columns if c not in keys]
    return joined.select(*many.columns, *extra)


def _row_hash(df: DataFrame) -> Column:
    """Of all columns that can be hashed, arrays and structs too: a vector may be all that
    tells two rows of a key apart."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema.fields if _hashable(f.dataType)))


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.UserDefinedType, T.VariantType))
