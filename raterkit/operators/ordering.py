"""Positions and running totals in a global order, without a one-task window.

Rows are range partitioned on a total order and written out together with the number
of their partition. Only the per-partition totals (one row per write task, and group)
pass through a small window; the rows themselves stay where they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from raterkit.session import materialize

_ROW = "_row"
_PART = "_part"
_START = "_start"
_OFFSET_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33


def with_index(
    df: DataFrame, order: Sequence[Column | str], name: str = "idx", computed: Mapping[str, Column] | None = None
) -> DataFrame:
    """Add the 0-based position of each row in ``order``, which must have no ties. Names of
    ``order`` may be those of ``computed`` columns: such values are not shuffled, but computed
    again where a row arrives, and left out of what is written."""
    computed = computed or {}
    dealt = df.repartitionByRange(*(computed.get(c, c) if isinstance(c, str) else c for c in order))
    placed = materialize(
        dealt.withColumns(computed)
        .sortWithinPartitions(*order)
        .withColumn(_ROW, F.monotonically_increasing_id())
        .drop(*computed),
        "index",
    ).withColumn(_PART, F.shiftright(_ROW, _OFFSET_BITS))
    sizes = placed.groupBy(_PART).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(_PART, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias(_START))
    offset = F.col(_ROW).bitwiseAND(F.lit((1 << _OFFSET_BITS) - 1))
    return (
        placed.join(F.broadcast(starts), _PART)
        .withColumn(name, (F.col(_START) + offset).cast("bigint"))
        .select(*df.columns, name)
    )


def total_before(
    df: DataFrame, order: Sequence[str], value: str, by: Sequence[str], name: str
) -> DataFrame:
    """Add the sum of ``value`` over the rows of the same ``by`` group that come earlier.

    ``(by, order)`` must be unique. A group as large as the whole table is still split
    over the range partitions; ``by`` should have few distinct values (models, runs).
    """
    placed = materialize(
        df.repartitionByRange(*by, *order).withColumn(_PART, F.spark_partition_id()), "totals"
    )
    sums = placed.groupBy(*by, _PART).agg(F.sum(value).alias("_sum"))
    parts_before = Window.partitionBy(*by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *by, _PART, F.coalesce(F.sum("_sum").over(parts_before), F.lit(0)).alias(_START)
    )
    rows_before = (
        Window.partitionBy(_PART, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = F.coalesce(F.sum(value).over(rows_before), F.lit(0))
    return (
        placed.withColumn("_inside", inside)
        .join(starts, [*by, _PART])
        .withColumn(name, F.col(_START) + F.col("_inside"))
        .select(*df.columns, name)
    )
