"""A table of byte strings by 64-bit key, as sorted arrays in the shared folder.

It serves scans that need a little about each of their rows, such as the marks or spans
of a document: the table is cut by key into parts, each task looks its own rows up, and
the large side of the join, the texts, is not shuffled.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from raterkit.llm.common import on_groups
from raterkit.llm.files import map_array, write_array, write_bytes
from raterkit.session import scratch_path, shuffle_slots


def _write_part(folder: str, rows: pa.Table) -> pa.Table:
    part = rows["part"][0].as_py()
    keys = rows["key"].to_numpy()
    order = np.argsort(keys, kind="stable")
    chosen = rows["value"].combine_chunks().cast(pa.large_binary()).take(pa.array(order))
    offsets = np.frombuffer(chosen.buffers()[1], np.int64)[: len(chosen) + 1]
    body = chosen.buffers()[2]
    write_array(f"{folder}/{part}.keys", keys[order])
    write_array(f"{folder}/{part}.starts", offsets)
    write_bytes(f"{folder}/{part}.values", memoryview(body)[: int(offsets[-1])] if body is not None else b"")
    return pa.table({"part": pa.array([part], pa.int32())})


class Store:
    """Where the parts are; small enough to travel with a task."""

    def __init__(self, folder: str, parts: int, present: frozenset[int]):
        self.folder, self.parts, self.present = folder, parts, present

    def get(self, keys: np.ndarray) -> list[bytes | None]:
        """The value of each key, None where there is none. Equal keys share a value."""
        found: list[bytes | None] = [None] * len(keys)
        part_of = keys % self.parts
        order = np.argsort(part_of, kind="stable")
        cuts = np.flatnonzero(np.diff(part_of[order])) + 1
        for chosen in np.split(order, cuts) if len(keys) else []:
            part = int(part_of[chosen[0]])
            if part not in self.present:
                continue
            known = map_array(f"{self.folder}/{part}.keys", "<i8")
            starts = map_array(f"{self.folder}/{part}.starts", "<i8")
            at = np.minimum(np.searchsorted(known, keys[chosen]), len(known) - 1)
            hit = known[at] == keys[chosen]
            if not hit.any():
                continue
            body = map_array(f"{self.folder}/{part}.values", "u1")
            for i, k in zip(chosen[hit], at[hit]):
                found[i] = body[starts[k] : starts[k + 1]].tobytes()
        return found


def build(rows: DataFrame, name: str) -> Store:
    """Write (key long, value binary); ``key`` is spread evenly and has no repeats."""
    spark = rows.sparkSession
    folder, parts = scratch_path(spark, name), shuffle_slots(spark)
    parted = rows.select(F.pmod("key", F.lit(parts)).cast("int").alias("part"), "key", "value")
    written = parted.groupBy("part").applyInArrow(on_groups(_write_part, folder), "part int")
    return Store(folder, parts, frozenset(row["part"] for row in written.collect()))
