"""Where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application.

    Not needed where it is installed on the workers or given with ``--py-files``.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="raterkit-code-")) / package.name
    context.addPyFile(shutil.make_archive(str(target), "zip", package.parent, package.name))
    _SHIPPED.add(context.applicationId)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the session's ``spark.checkpoint.dir``.

    Only a ``local[...]`` session without the setting gets a temporary folder; on a
    cluster a machine-local folder would be invisible to the other executors.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="raterkit-")
    context.setCheckpointDir(folder)
    return folder


_SCOPES: list[list[tuple[SparkSession, str]]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark).rstrip('/')}/raterkit/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append((spark, path))
    return path


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Removes on exit, also by an error, what was written to the shared folder inside.

    Only for work whose results are saved elsewhere by then; scopes may be nested.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for spark, path in _SCOPES.pop():
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str, partition_by: Sequence[str] = (), compression: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back; without
    ``compression``, under the session's.

    Cuts the lineage, survives lost executors, and freezes values that depend on the
    physical placement of rows, such as ``monotonically_increasing_id``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path, compression=compression)
    written = spark.read.schema(df.schema).parquet(path)
    written._scratch = path
    return written


def discard(table: DataFrame) -> None:
    """Remove a table that ``materialize`` returned and that no later step reads."""
    _remove(table.sparkSession, table._scratch)


def even_tasks(df: DataFrame, rows_per_task: int = 50_000) -> int:
    """Tasks for work bound by arithmetic: every core busy, and on large tables about as many
    as the session's reduce tasks. They are a multiple of the cores, so that none is idle
    while a last few tasks run."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    turns = min(shuffle_slots(spark) // cores, -(-df.count() // (rows_per_task * cores)))
    return cores * max(turns, 1)


def shuffle_slots(spark: SparkSession) -> int:
    """Number of reduce tasks the session plans for."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
