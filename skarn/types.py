"""Column types by their SQL names, and column definitions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import SqlParseError

#: SQL names of types and Spark's types.
NAMES: dict[str, T.DataType] = {
    "NULL": T.NullType(), "BOOLEAN": T.BooleanType(), "BOOL": T.BooleanType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "TEXT": T.StringType(),
    "VARCHAR": T.StringType(), "BINARY": T.BinaryType(), "TIMESTAMP": T.TimestampNTZType(), "DATE": T.DateType(), "DECIMAL": T.DecimalType(10, 0),
}


def parse_type(text: str) -> T.DataType:
    """A type by name; lengths of VARCHAR are dropped, precision and scale of DECIMAL kept."""
    found = re.fullmatch(r"\s*(\w+)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*", text)
    if not found or found[1].upper() not in NAMES:
        raise SqlParseError(f"unknown type {text.strip()}")
    if found[1].upper() == "DECIMAL" and found[2]:
        return T.DecimalType(int(found[2]), int(found[3] or 0))
    return NAMES[found[1].upper()]


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: T.DataType
    nullable: bool = True
    primary_key: bool = False
    unique: bool = False
    default: str | None = None


def parse_column(text: str) -> ColumnDef:
    """A column of CREATE TABLE: name, type, NOT NULL, PRIMARY KEY, UNIQUE, DEFAULT expression."""
    found = re.fullmatch(r"\s*`?(\w+)`?\s+(\w+(?:\s*\([\d\s,]+\))?)(.*)", text, re.DOTALL)
    if not found:
        raise SqlParseError(f"not a column definition: {text.strip()}")
    rest = found[3].upper()
    default = re.search(r"\bDEFAULT\s+(.+?)(?:\s+(?:NOT\s+NULL|PRIMARY|UNIQUE)\b|$)", found[3], re.IGNORECASE | re.DOTALL)
    key = "PRIMARY KEY" in " ".join(rest.split())
    return ColumnDef(found[1], parse_type(found[2]), not (key or re.search(r"NOT\s+NULL", rest)), key, "UNIQUE" in rest, default and default[1].strip())


def schema(columns: list[ColumnDef]) -> T.StructType:
    return T.StructType([T.StructField(c.name, c.type, c.nullable, {"primary_key": c.primary_key, "unique": c.unique, "default": c.default}) for c in columns])


def as_string(column: str) -> Column:
    return F.col(column).cast("string")


def as_integer(column: str) -> Column:
    """An integer, or null for what is none or out of range; never a cut value."""
    return F.col(column).try_cast("int")
