"""Arrow data set files (IPC format) as a Spark data source, for reading and writing.

    spark.dataSource.register(ArrowFiles)        # or read_arrow / write_arrow below
    spark.read.format("arrow_files").load(path)

Files are planned by their record batches, so a large file is read by several tasks. A
schema given to the reader names the columns that are read; simple filters are applied to
the batches before they reach Spark. Writing goes to drafts that are renamed when all tasks
are done; a task that is killed late may leave a draft, which no reader sees. Paths are anything that Arrow's file systems open and all workers reach.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from raterkit.session import ship_package

SUFFIX = ".arrow"
#: Record batches of a file that one task reads.
BATCHES = 16
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

_COMPARED = {
    EqualTo: pc.equal,
    GreaterThan: pc.greater,
    GreaterThanOrEqual: pc.greater_equal,
    LessThan: pc.less,
    LessThanOrEqual: pc.less_equal,
}


def _files(path: str) -> tuple[fs.FileSystem, list[str]]:
    """The files below a path, by name; what lies in a draft folder is not there yet."""
    store, where = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = store.get_file_info(where)
    if info.type == fs.FileType.File:
        return store, [where]
    if info.type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    below = store.get_file_info(fs.FileSelector(where, recursive=True))
    files = [f.path for f in below if f.type == fs.FileType.File and f.path.endswith(SUFFIX)]
    return store, sorted(f for f in files if "/_draft-" not in f[len(where) :])


@dataclass
class _Part(InputPartition):
    file: str
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes the filters it can apply; gives back the others."""
        for one in filters:
            known = type(one) in _COMPARED or isinstance(one, (In, IsNull, IsNotNull))
            if known and len(one.attribute) == 1:
                self.filters.append(one)
            else:
                yield one

    def partitions(self) -> list[InputPartition]:
        store, files = _files(self.path)
        parts = []
        for file in files:
            with store.open_input_file(file) as source:
                n = ipc.open_file(source).num_record_batches
            parts += [_Part(file, i, min(i + BATCHES, n)) for i in range(0, n, BATCHES)]
        return parts

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        wanted = to_arrow_schema(self.schema)
        store, _ = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), None)
        with store.open_input_file(partition.file) as source:
            schema = ipc.open_file(source).schema
            needed = {*wanted.names, *(f.attribute[0] for f in self.filters)}
            chosen = ipc.IpcReadOptions(included_fields=[i for i, name in enumerate(schema.names) if name in needed])
            reader = ipc.open_file(source, options=chosen)
            for i in range(partition.first, partition.last):
                batch = reader.get_batch(i)
                for one in self.filters:
                    batch = batch.filter(_holds(batch.column(one.attribute[0]), one))
                yield batch.select(wanted.names).cast(wanted)


def _holds(values: pa.Array, condition: Filter) -> pa.Array:
    if isinstance(condition, IsNull):
        return pc.is_null(values)
    if isinstance(condition, IsNotNull):
        return pc.is_valid(values)
    if isinstance(condition, In):
        return pc.is_in(values, value_set=pa.array(condition.value, values.type), skip_nulls=True)
    return _COMPARED[type(condition)](values, pa.scalar(condition.value, values.type))


@dataclass
class _Written(WriterCommitMessage):
    draft: str | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        self.path, self.schema, self.overwrite, self.job = path, schema, overwrite, uuid.uuid4().hex

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, where = self._store()
        draft, sink, schema = None, None, to_arrow_schema(self.schema)
        for batch in iterator:
            if sink is None:
                folder = posixpath.join(where, f"_draft-{self.job}")
                store.create_dir(folder, recursive=True)
                draft = posixpath.join(folder, f"part-{uuid.uuid4().hex}{SUFFIX}")
                out = store.open_output_stream(draft)
                sink = ipc.new_file(out, schema)
            sink.write_batch(batch.cast(schema))
        if sink is not None:
            sink.close()
            out.close()
        return _Written(draft)

    def commit(self, messages: list[_Written | None]) -> None:
        store, where = self._store()
        store.create_dir(where, recursive=True)
        before = [f.path for f in store.get_file_info(fs.FileSelector(where)) if f.path.endswith(SUFFIX)] if self.overwrite else []
        for message in messages:
            if message is not None and message.draft is not None:
                store.move(message.draft, posixpath.join(where, posixpath.basename(message.draft)))
        for file in before:
            store.delete_file(file)
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        store, where = self._store()
        folder = posixpath.join(where, f"_draft-{self.job}")
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class ArrowFiles(DataSource):
    """``path``: a file or a folder of files that end in ``.arrow``."""

    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def schema(self) -> T.StructType:
        store, files = _files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no {SUFFIX} files in {self.options['path']}")
        with store.open_input_file(files[0]) as source:
            return from_arrow_schema(ipc.open_file(source).schema)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters pushed into it."""
    ship_package(spark)
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(ArrowFiles)


def read_arrow(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows of Arrow files; a ``schema`` with some of the columns reads these alone."""
    register(spark)
    reader = spark.read.format("arrow_files")
    return (reader if schema is None else reader.schema(schema)).load(path)


def write_arrow(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One file for each task that has rows; they appear together, when all are written."""
    register(df.sparkSession)
    df.write.format("arrow_files").mode(mode).save(path)
