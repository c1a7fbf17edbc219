"""Schemas found from data, and Arrow files."""

import json
import os
import re

import pyarrow as pa
import pytest
from conftest import rows
from pyarrow import ipc
from pyspark.sql import functions as F, types as T

from raterkit.operators.cleaning import flatten
from raterkit.sources.arrow_files import BATCHES, read_arrow, write_arrow
from raterkit.sources.discovery import discover_schema, lines_schema, read_discovered

LINES = [
    {"comment": "a", "n": 1, "ratings": [{"worker_id": "w", "score": 1, "who": {"odd name": 1}}, {"score": 2.5}]},
    {"comment": None, "n": 2, "mixed": 7, "ratings": []},
    {"n": 3, "mixed": "seven", "flag": True, "nothing": None},
    {"n": 12345678901234567890, "mixed": {"deep": [1]}},
]


def lines(spark, values):
    return spark.createDataFrame([(v if v is None or isinstance(v, str) else json.dumps(v),) for v in values], "value string").repartition(3)


def test_types_widen(spark):
    found = lines_schema(lines(spark, LINES))
    kinds = {f.name: f.dataType.simpleString() for f in found.fields}
    assert kinds == {
        "comment": "string",
        "flag": "boolean",
        "mixed": "string",
        "n": "decimal(20,0)",
        "nothing": "string",
        "ratings": "array<struct<score:double,who:struct<odd name:bigint>,worker_id:string>>",
    }


def test_lines_that_are_no_objects(spark):
    assert lines_schema(lines(spark, [])) == T.StructType([]) == lines_schema(lines(spark, [None]))
    with pytest.raises(ValueError, match="not all objects"):
        lines_schema(lines(spark, ["[1]", "[2]"]))
    with pytest.raises(Exception, match="MALFORMED"):
        lines_schema(lines(spark, ['{"a": ']))


def test_read_discovered(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text("\n".join(map(json.dumps, LINES[:3])) + "\n\n")
    assert discover_schema(spark, str(path))["n"].dataType == T.LongType()
    found = read_discovered(spark, str(path))
    flat = flatten(found.withColumn("ratings", F.explode_outer("ratings")))
    assert flat.columns == ["comment", "flag", "mixed", "n", "nothing", "ratings.score", "ratings.who.odd name", "ratings.worker_id"]
    assert rows(flat, "n", "`ratings.score`", "mixed") == [(1, 1.0, None), (1, 2.5, None), (2, None, "7"), (3, None, "seven")]


# ---- Arrow files ---------------------------------------------------------------------


@pytest.fixture
def stored(spark, tmp_path):
    """A file of many batches and a small one, with nulls, lists and structs."""
    n = 40 * 50
    table = pa.table(
        {
            "id": pa.array(range(n), pa.int64()),
            "x": pa.array([None if i % 7 == 0 else i / 2 for i in range(n)], pa.float64()),
            "name": pa.array([f"n{i % 5}" if i % 11 else None for i in range(n)]),
            "v": pa.array([[float(i), 1.0] for i in range(n)], pa.list_(pa.float32())),
            "s": pa.array([{"a": i, "b": str(i)} for i in range(n)]),
        }
    )
    for name, part in (("a.arrow", table.slice(0, n - 10)), ("b.arrow", table.slice(n - 10))):
        with ipc.new_file(str(tmp_path / name), table.schema) as sink:
            sink.write_table(part, max_chunksize=50)
    (tmp_path / "notes.txt").write_text("not data")
    return str(tmp_path), table


def test_read_all(spark, stored):
    path, table = stored
    found = read_arrow(spark, path)
    assert found.dtypes == [("id", "bigint"), ("x", "double"), ("name", "string"), ("v", "array<float>"), ("s", "struct<a:bigint,b:string>")]
    assert found.orderBy("id").toArrow().to_pylist() == table.to_pylist()
    assert found.rdd.getNumPartitions() == -(-40 // BATCHES) + 1
    assert read_arrow(spark, f"file://{path}/b.arrow").count() == 10


def test_columns_are_pruned_by_the_schema(spark, stored):
    path, table = stored
    some = T.StructType([T.StructField("name", T.StringType()), T.StructField("id", T.LongType())])
    found = read_arrow(spark, path, some)
    assert found.columns == ["name", "id"] and rows(found, "id", "name") == sorted(zip(table["id"].to_pylist(), table["name"].to_pylist()), key=repr)


@pytest.mark.parametrize(
    "condition",
    ["id = 77", "id >= 1990", "x < 20", "x > 900.5 AND name = 'n3'", "name IN ('n1', 'n2') AND id <= 30", "name IS NULL", "x IS NOT NULL AND id < 9", "id % 400 = 1", "s.a = 5"],
)
def test_filters(spark, stored, condition):
    path, table = stored
    wanted = rows(spark.createDataFrame(table).filter(condition).select("id", "x", "name"))
    found = read_arrow(spark, path).filter(condition)
    assert rows(found.select("id", "x", "name")) == wanted and wanted


def test_filters_reach_the_files(spark, stored):
    path, _ = stored
    found = read_arrow(spark, path).filter("id >= 1990 AND name = 'n1'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter \(", plan) and found.count() > 0


def test_write_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") * 0.5).alias("x"), F.array(F.lit(1), F.col("id").cast("int")).alias("v"))
    write_arrow(df.repartition(4), path)
    assert rows(read_arrow(spark, path)) == rows(df)
    assert len(os.listdir(path)) == 4 and all(f.endswith(".arrow") for f in os.listdir(path))
    write_arrow(df.filter("id < 5"), path)
    assert read_arrow(spark, path).count() == 5
    write_arrow(df.filter("id < 5"), path, "append")
    assert read_arrow(spark, path).count() == 10


def test_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    write_arrow(spark.range(3), path)
    broken = spark.range(100).repartition(4).select(F.when(F.col("id") == 50, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        write_arrow(broken, path, "append")
    assert rows(read_arrow(spark, path)) == [(0,), (1,), (2,)]
    late = tmp_path / "out" / "_draft-x"  # of a task that was killed after the write was given up
    late.mkdir()
    (late / "part.arrow").write_bytes(b"half a file")
    assert rows(read_arrow(spark, path)) == [(0,), (1,), (2,)]


def test_missing_path(spark, tmp_path):
    with pytest.raises(Exception, match="FileNotFoundError|no such|nowhere"):
        read_arrow(spark, str(tmp_path / "nowhere")).collect()
