"""Batch moments and their exponentially weighted running values, over any number of batches.

A running value is ``decay * before + value``, which composes: a stretch of batches turns
the value before it into ``decay ** length`` times it plus the stretch's own sum. Stretches
of bounded length are scanned by themselves, their sums are scanned in the same way, and
what comes in from before is added. No task scans all batches.
"""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from raterkit.functions.network import NORM_MOMENTUM
from raterkit.operators.features import join_required
from raterkit.session import materialize

STRETCH = 1024


def batch_moments(batches: DataFrame, vectors: DataFrame, key: str = "comment_id", vector: str = "embedding") -> DataFrame:
    """(batch_id, pos, n, mean, var) of the rows' vectors in each batch; ``var`` divides by n.

    ``batches`` is (batch_id, key): a vector is looked up once per batch and counts as often
    as the batch has its key.
    """
    held = batches.groupBy("batch_id", key).agg(F.count(F.lit(1)).alias("_n"))
    read = join_required(held, vectors, key, vector)
    times = F.col("_n").cast("double")
    plain = F.transform(vector, lambda x: x.cast("double") * times)
    squares = F.transform(vector, lambda x: x.cast("double") * x.cast("double") * times)
    both = read.select("batch_id", "_n", array_to_vector(F.concat(plain, squares)).alias("v"))
    summed = both.groupBy("batch_id").agg(F.sum("_n").alias("n"), vector_to_array(Summarizer.sum(F.col("v"))).alias("s"))
    width = (F.size("s") / 2).cast("int")
    pairs = F.arrays_zip(F.slice("s", F.lit(1), width).alias("a"), F.slice("s", width + 1, width).alias("b"))
    rows = summed.select("batch_id", "n", F.posexplode(pairs).alias("pos", "x"))
    mean = F.col("x.a") / F.col("n")
    return rows.select("batch_id", "pos", "n", mean.alias("mean"), F.greatest(F.col("x.b") / F.col("n") - mean * mean, F.lit(0.0)).alias("var"))


def decayed_sums(df: DataFrame, by: str, at: str, values: dict[str, Column], decay: float, stretch: int = STRETCH) -> DataFrame:
    """Add, for each of ``values``, the sum over earlier rows of the group and this one,
    weighted ``decay ** distance``. ``at`` counts 0, 1, 2, ... in every group."""
    length = max(2, min(stretch, int(100 / -math.log10(decay)) if decay > 1e-50 else 2))
    part, off = f"{at}_part", f"{at}_off"
    added = {part: F.floor(F.col(at) / length).cast("bigint"), off: (F.col(at) % length).cast("double")}
    rows = df.withColumns({**added, **{f"_v_{n}": v for n, v in values.items()}})
    before = Window.partitionBy(by, part).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = F.lit(float(decay))
    scanned = rows.withColumns({n: F.sum(F.col(f"_v_{n}") * F.pow(base, -F.col(off))).over(before) * F.pow(base, F.col(off)) for n in values})
    if (df.agg(F.max(at)).first()[0] or 0) >= length:
        whole = rows.groupBy(by, part).agg(*(F.sum(F.col(f"_v_{n}") * F.pow(base, (length - 1) - F.col(off))).alias(n) for n in values))
        ends = decayed_sums(materialize(whole, "stretches"), by, part, {f"_in_{n}": F.col(n) for n in values}, decay**length, stretch)
        carried = ends.select(by, (F.col(part) + 1).alias(part), *(f"_in_{n}" for n in values))
        scanned = scanned.join(carried, [by, part], "left")
        scanned = scanned.withColumns({n: F.col(n) + F.coalesce(F.col(f"_in_{n}"), F.lit(0.0)) * F.pow(base, F.col(off) + 1) for n in values})
    return scanned.select(*df.columns, *values)


def running_moments(moments: DataFrame, momentum: float = NORM_MOMENTUM, stretch: int = STRETCH) -> DataFrame:
    """Add ``running_mean`` and ``running_var`` after each batch of ``batch_moments``.

    They start at 0 and 1 and move by ``momentum`` towards a batch's mean and unbiased
    variance; a batch of one row counts with its variance as it is.
    """
    unbiased = F.col("var") * F.col("n") / F.greatest(F.col("n") - 1, F.lit(1))
    scanned = decayed_sums(moments, "pos", "batch_id", {"_mean": F.col("mean"), "_var": unbiased}, 1 - momentum, stretch)
    start = F.pow(F.lit(1 - momentum), F.col("batch_id") + 1)
    return scanned.select(
        *moments.columns, (F.col("_mean") * momentum).alias("running_mean"), (F.col("_var") * momentum + start).alias("running_var")
    )
