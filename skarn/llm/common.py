"""What the operators of this subpackage share: reading tables, storing intermediate ones, driver-planned tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tools import Stored, free_name, named, shared_folder

__all__ = ["SPACE", "Stored", "free_name", "named", "planned", "shared_folder", "table", "utf8"]

#: ASCII white space; words are the runs between it.
SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def planned(spark: SparkSession, rows: list[list], schema: str) -> DataFrame:
    """A small driver-made table as JVM rows (no Python on the executors). Its size must be bounded by the caller."""
    struct = T._parse_datatype_string(schema)
    names = struct.fieldNames()
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    parsed = F.from_json(F.lit(text), T.ArrayType(struct))
    return spark.range(1, numPartitions=1).select(F.inline(parsed))


def utf8(column: str) -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(named(column), F.lit("")).cast("binary")
