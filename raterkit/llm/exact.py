"""Exact deduplication by stateful streaming.

A narrow feed of digests is read as a stream. A stateful aggregation keeps, per digest
and without expiry, the best row seen so far, where its content lies, and the number of
rows; the state lives on disk in RocksDB and is checkpointed to the shared folder, so a
run that is resumed, or fed with more files, goes on from what it knows. Every row that
hits a digest held by another row is then compared with it byte by byte.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from raterkit.llm.common import ROW, packed, unpacked, without_blanks
from raterkit.operators.skew import salted_join
from raterkit.session import scratch_path

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else 4 MB of disk per state partition and log
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
#: Bytes of feed (some 100 bytes a document) that one micro-batch takes.
BATCH_BYTES = 16 << 30
#: Rows of a group of copies that are compared with one delivery of the kept text.
PIECE_ROWS = 1000


Digest = Callable[[Column], Column]


def sha256(body: Column) -> Column:
    return F.sha2(body, 256)


def identify(docs: DataFrame, key: Column, text: Column, digest: Digest, carry: Sequence[Column] = ()) -> DataFrame:
    """``carry``, doc_id, body (without blanks), digest, points and content hash of each row."""
    rows = docs.select(
        *carry,
        key.alias("doc_id"),
        F.length(F.coalesce(text, F.lit(""))).alias("points"),
        without_blanks(text).alias("body"),
    )
    return rows.select("*", digest(F.col("body")).alias("digest"), F.xxhash64("body").alias("content"))


def make_feed(docs: DataFrame, key: str, text: str, digest: Digest, path: str) -> DataFrame:
    """doc_id, digest, points, content, text_sha256, locator of every row, written once.

    ``locator`` names the file and the row's place in the scan, so it tells apart rows
    that agree in everything else.
    """
    place = F.concat_ws("#", F.input_file_name(), F.monotonically_increasing_id().cast("string"))
    rows = identify(docs, F.col(key), F.col(text), digest, [place.alias("locator")])
    feed = rows.select("doc_id", "digest", "points", "content", sha256(F.col("body")).alias("text_sha256"), "locator")
    feed.write.parquet(path)
    return docs.sparkSession.read.schema(feed.schema).parquet(path)


def rank() -> Column:
    """Largest for the row that stays: most code points, then smallest id, then one locator."""
    return F.struct("points", F.bitwise_not(F.col("doc_id")).alias("id_down"), "doc_id", "content", "locator")


@contextmanager
def _disk_state(spark: SparkSession) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def stream_groups(
    spark: SparkSession, feed_path: str, schema: StructType, state_path: str, files_per_batch: int | None = None
) -> DataFrame:
    """digest, best, n: the state after all files in ``feed_path``.

    Copies are combined before they reach the state, so a digest held by a third of all
    rows costs one state row and one update per task. With the same ``state_path``, files
    added later are folded into the kept state.
    """
    limit = ("maxFilesPerTrigger", files_per_batch) if files_per_batch else ("maxBytesPerTrigger", BATCH_BYTES)
    state = (
        spark.readStream.schema(schema)
        .option(*limit)
        .parquet(feed_path)
        .groupBy("digest")
        .agg(F.max(rank()).alias("best"), F.count(F.lit(1)).alias("n"))
    )
    updates = f"{state_path}/updates"

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{updates}/batch={batch}")

    with _disk_state(spark):
        query = (
            state.writeStream.outputMode("update")
            .foreachBatch(keep)
            .option("checkpointLocation", f"{state_path}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    seen = spark.read.schema(StructType([*state.schema.fields, StructField("batch", IntegerType())])).parquet(updates)
    last = seen.groupBy("digest").agg(F.max(F.struct("batch", "best", "n")).alias("u"))
    path = f"{state_path}/groups"
    last.select("digest", "u.best", "u.n").write.mode("overwrite").parquet(path)
    return spark.read.schema(state.schema).parquet(path)


def _is_best() -> Column:
    """Agrees with the kept row in id, length and content hash."""
    same_id = F.col("doc_id").eqNullSafe(F.col("best.doc_id"))
    return same_id & (F.col("points") == F.col("best.points")) & (F.col("content") == F.col("best.content"))


def collided(docs: DataFrame, groups: DataFrame, key: str, text: str, digest: Digest) -> bool:
    """Whether any row that hit a digest differs in its bytes from the kept row.

    Only members of groups with several rows are compared. The kept text is delivered
    once per ``PIECE_ROWS`` members, so a group of any size is spread over tasks.
    """
    members = identify(docs, F.col(key), F.col(text), digest).join(groups.filter("n > 1"), "digest")
    pieces = F.floor(F.col("n") / PIECE_ROWS)
    kept = (
        members.filter(_is_best())
        .dropDuplicates(["digest"])
        .select("digest", F.explode(F.sequence(F.lit(0), pieces)).alias("piece"), F.col("body").alias("kept_body"))
    )
    hits = members.filter(~_is_best()).select(
        "digest", F.pmod(F.xxhash64("doc_id", "points"), pieces + 1).alias("piece"), "body"
    )
    return not hits.join(kept, ["digest", "piece"]).filter("body <> kept_body").isEmpty()


def _state_of(docs: DataFrame, key: str, text: str, digest: Digest, files: int | None) -> tuple[DataFrame, DataFrame]:
    """The feed and the groups. If different texts share a digest, the texts themselves
    take its place, so the result is exact whatever the digest."""
    spark = docs.sparkSession
    path = scratch_path(spark, "dedup")
    feed = make_feed(docs, key, text, digest, f"{path}/feed")
    groups = stream_groups(spark, f"{path}/feed", feed.schema, f"{path}/state", files)
    if collided(docs, groups, key, text, digest):
        return _state_of(docs, key, text, lambda body: body, files)
    return feed, groups


def decide(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    digest: Digest = sha256,
    files_per_batch: int | None = None,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row.

    Texts are equal when they agree after blanks are removed; a null text counts as
    empty, so null, empty and blank texts are one group. The row with the most code
    points in its original text stays, then the smallest id (a null id comes last), then
    one of the identical rows. Other columns are not read. An empty table gives no rows.
    """
    feed, groups = _state_of(docs, key, text, digest, files_per_batch)
    joined = salted_join(feed, groups, ["digest"], counts=groups.select("digest", "n"))
    return joined.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("locator") == F.col("best.locator")).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all their columns unchanged; rules as in ``decide``."""
    feed, groups = _state_of(docs, key, text, sha256, None)
    rows = identify(packed(docs), F.col(f"{ROW}.`{key}`"), F.col(f"{ROW}.`{text}`"), sha256, [F.col(ROW)]).drop("body")
    found = salted_join(rows, groups, ["digest"], counts=groups.select("digest", "n"))
    alone = found.filter("n = 1")
    first = found.filter((F.col("n") > 1) & _is_best()).dropDuplicates(["digest"])
    return unpacked(alone.unionByName(first), docs)
