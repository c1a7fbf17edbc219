"""The schema of JSON lines, found from the data.

Every line is parsed to a variant and the lines' schemas are merged by an aggregate, part by
part, so no line reaches the driver and no sample decides. Types widen as they do in a data
frame library: whole and fractional numbers to double, anything else that differs to text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from raterkit.sources.readers import read_nested

_QUOTED = re.compile(r"(`(?:[^`]|``)*`)")
#: Types of the merged schema that are read as another one.
_READ_AS = [
    (re.compile(r"\bOBJECT<"), "STRUCT<"),
    (re.compile(r"\bDECIMAL\([0-9]+,\s*[1-9][0-9]*\)"), "DOUBLE"),
    (re.compile(r"\b(VARIANT|VOID)\b"), "STRING"),
]


def lines_schema(lines: DataFrame, column: str = "value") -> T.StructType:
    """The merged schema of JSON objects in a text column.

    A field that is null everywhere is text; fields appear in the order of their names. Null
    lines count for nothing; a line that is no JSON, or no object, is an error.
    """
    merged = lines.select(F.schema_of_variant_agg(F.parse_json(column)).alias("s")).first()["s"]
    if merged == "VOID":  # no lines
        return T.StructType([])
    if not merged.startswith("OBJECT<"):
        raise ValueError(f"lines are not all objects: {merged[:80]}")
    parts = _QUOTED.split(merged)
    for kind, other in _READ_AS:
        parts[::2] = [kind.sub(other, part) for part in parts[::2]]
    return T.DataType.fromDDL("".join(parts))


def discover_schema(spark: SparkSession, path: str) -> T.StructType:
    """The schema of a folder of JSON lines; one pass over the files."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines_schema(lines)


def read_discovered(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines under the schema found in them; ``cleaning.flatten`` gives dotted columns."""
    return read_nested(spark, path, discover_schema(spark, path))
