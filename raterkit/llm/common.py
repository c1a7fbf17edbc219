"""What the corpus operators share: word rules, hashing, and handling of extra columns."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The characters that part words, as a Java and RE2 character class.
BLANK = r"[\x20\x09-\x0D]"
ROW = "_llm_row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of the words of a text; none for a null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK + "+", -1), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without_blanks(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK + "+", "")


def hash_share(*parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by ':'. A null part reads 'null'."""
    text = F.concat_ws(":", *(F.coalesce(F.lit(p) if isinstance(p, str) else p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def packed(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` in one struct, so that no added name can clash with theirs."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(ROW))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` out of the struct again."""
    return rows.select(*(F.col(f"{ROW}.`{c}`").alias(c) for c in docs.columns))


def on_groups(function: Callable[..., pa.Table], *fixed) -> Callable[[pa.Table], pa.Table]:
    """``function`` with its first arguments fixed, in the form ``applyInArrow`` asks for."""

    def apply(rows: pa.Table) -> pa.Table:
        return function(*fixed, rows)

    return apply
