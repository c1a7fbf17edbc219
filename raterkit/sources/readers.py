"""Readers. Schemas are given, never inferred from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from raterkit.sources.schemas import NESTED_RATINGS


def read_flat(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Flat ratings in Parquet; the files' own schema if none is given."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


INPUT_ORDER = ["input_file", "input_block", "input_row"]


def read_nested(spark: SparkSession, path: str, schema: T.StructType = NESTED_RATINGS) -> DataFrame:
    """One JSON object per line: a comment with its array of ratings.

    A line that is cut off, or a value of another type, is an error and not a null.
    """
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_nested_in_order(spark: SparkSession, path: str, schema: T.StructType = NESTED_RATINGS) -> DataFrame:
    """The same, with the ``INPUT_ORDER`` columns: files by name, then lines as they stand.

    For first-appearance ids where the data has no order key of its own. A block is read
    by one task from front to back, so its rows count upwards. Write the rows out before
    using the columns twice, as ``prepare_nested`` does.
    """
    lines = read_nested(spark, path, schema)
    return lines.select(
        *lines.columns,
        F.col("_metadata.file_path").alias("input_file"),
        F.col("_metadata.file_block_start").alias("input_block"),
        F.monotonically_increasing_id().alias("input_row"),
    )


def parse_json(df: DataFrame, column: str, schema: T.StructType, name: str) -> DataFrame:
    """A JSON string column as a struct column; null stays null, bad JSON is an error."""
    return df.withColumn(name, F.from_json(column, schema, {"mode": "FAILFAST"}))
