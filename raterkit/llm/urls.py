"""URL rules by a sort-merge range join.

Hosts are written backwards, label by label ("com.example."), so all hosts under a rule's
host lie in one interval of the sorted keys and the intervals of nested rules nest. Rules
and URLs are sorted together; a sweep keeps, per number of labels, the rule host that was
opened last. These are the stack: an entry is active while its key is a prefix of the
current one. The sort is range partitioned, and what is open at the start of a partition
is computed from one small row per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from raterkit.llm.common import lower_ascii
from raterkit.session import materialize, shuffle_slots

#: (verdict, host, path): the production rules.
RULES: tuple[tuple[str, str, str], ...] = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
DEFAULT = "allow"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    host = lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0))
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def reversed_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def labels(key: Column) -> Column:
    return F.length(key) - F.length(F.replace(key, F.lit("."), F.lit("")))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def match(
    pages: DataFrame,
    rules: DataFrame,
    key: str = "page_id",
    url: str = "url",
    default: str = DEFAULT,
) -> DataFrame:
    """page_id, host, path, rule, verdict: one row per page.

    A rule fits its host and all subdomains if the url's path starts with the rule's; the
    longest ``host + path`` wins, then block over allow. No rule fits an empty host.
    Without a fitting rule, ``rule`` is null and the verdict is ``default``. Null keys and
    repeated pages are kept; other columns are not read. Rules with a null or empty host
    are left out, a null path counts as empty.

    Pages are sorted on (key, path, id), so a host with a third of all pages is spread
    over as many range partitions as its share. Only narrow rows are shuffled. The rules
    of one host travel as one array; the depths of rule hosts are at most 127 labels.
    """
    host, path = split_url(F.col(url))
    sites = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    one = F.struct(
        (F.length("host") + F.length("path")).alias("size"),
        (F.col("verdict") == "block").cast("int").alias("block"),
        F.concat("host", "path").alias("rule"),
        "path",
        "verdict",
    )
    opened = (
        rules.select("verdict", lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
        .filter("host <> ''")
        .withColumn("key", reversed_key(F.col("host")))
        .groupBy("key")
        .agg(F.collect_set(one).alias("own"))
    )
    starts = materialize(opened.withColumn("depth", labels(F.col("key"))), "url-rules")
    depths = sorted(row["depth"] for row in starts.select("depth").distinct().collect())
    if not depths:
        return sites.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    events = sites.select(
        "*", F.when(F.col("host") != "", reversed_key(F.col("host"))).otherwise("").alias("key"), F.lit(1).alias("kind")
    ).unionByName(starts.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    order = ["key", "kind", "path", "page_id"]
    swept = materialize(
        events.repartitionByRange(shuffle_slots(pages.sparkSession), *order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id()),
        "url-sweep",
    )
    return _sweep(swept, depths, default)


def _sweep(swept: DataFrame, depths: list[int], default: str) -> DataFrame:
    entry = F.struct("key", "own")
    inside = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    at_depth = {d: F.when((F.col("kind") == 0) & (F.col("depth") == d), entry) for d in depths}
    # the last rule host of each depth in each partition: one row per partition that has rules
    latest = swept.filter("kind = 0").groupBy("part").agg(
        *(F.max_by(at_depth[d], F.when(F.col("depth") == d, F.col("key"))).alias(f"last{d}") for d in depths)
    )
    parts = swept.select("part").distinct().join(latest, "part", "left")
    carried = parts.select("part", *(F.last(f"last{d}", ignorenulls=True).over(before).alias(f"from{d}") for d in depths))
    stacked = swept.join(F.broadcast(carried), "part").select(
        "*", *(F.coalesce(F.last(at_depth[d], ignorenulls=True).over(inside), F.col(f"from{d}")).alias(f"open{d}") for d in depths)
    )
    stack = F.array(*(F.col(f"open{d}") for d in depths))
    active = F.filter(stack, lambda e: e.isNotNull() & F.coalesce(F.startswith(F.col("key"), e["key"]), F.lit(False)))
    fitting = F.filter(
        F.flatten(F.transform(active, lambda e: e["own"])), lambda r: F.startswith(F.col("path"), r["path"])
    )
    return (
        stacked.filter("kind = 1")
        .select("page_id", "host", "path", F.array_max(fitting).alias("best"))
        .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )
