"""Key-value access to a table of (k, value). Reads are predicates and joins; writes make new tables.

Limits keep the first keys in key order. Ranges are half open.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def get(table: DataFrame, key: Any) -> DataFrame:
    return table.where(F.col("k") == key).select("value")


def batch_get(table: DataFrame, keys: DataFrame) -> DataFrame:
    """A row for each of keys (k), value null where there is none."""
    return keys.join(table.select("k", "value"), "k", "left")


def scan(table: DataFrame, start: Any, end: Any, limit: int = 1000) -> DataFrame:
    return table.where((F.col("k") >= start) & (F.col("k") < end)).orderBy("k").limit(limit).select("k", "value")


def scan_prefix(table: DataFrame, prefix: str, limit: int = 1000) -> DataFrame:
    return table.where(F.col("k").startswith(prefix)).orderBy("k").limit(limit).select("k", "value")


def put(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Inserts and overwrites, one row for each key: of rows with the same key the last by ``seq`` counts, and without that
    column, as rows have no order, the one with the greatest value. Rows without a key are ignored."""
    new = latest(rows if "seq" in rows.columns else rows.select("k", "value", F.lit(0).alias("seq")))
    return table.select("k", "value").join(new.select("k"), "k", "left_anti").unionByName(new)


def delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys that are not there are ignored."""
    return table.select("k", "value").join(keys.select("k"), "k", "left_anti")


def latest(rows: DataFrame) -> DataFrame:
    """The last value of each key by seq, then the greatest, pre-aggregated before the shuffle."""
    return rows.where("k IS NOT NULL").groupBy("k").agg(F.max(F.struct("seq", "value")).alias("last")).select("k", "last.value")


def apply(table: DataFrame, operations: DataFrame) -> DataFrame:
    """The table after a log of (seq, op, k, value): PUT, INSERT and UPDATE write, DELETE removes, GET and SELECT change
    nothing. Only the last write of a key matters; writes without a key are ignored."""
    writes = operations.where(F.upper("op").isin("PUT", "INSERT", "UPDATE", "DELETE"))
    last = writes.where("k IS NOT NULL").groupBy("k").agg(F.max(F.struct("seq", "op", "value")).alias("w"))
    kept = table.select("k", "value").join(last.select("k"), "k", "left_anti")
    return kept.unionByName(last.where(F.upper("w.op") != "DELETE").select("k", "w.value"))


def outcomes(table: DataFrame, operations: DataFrame) -> DataFrame:
    """(seq, op, k, success, affected_rows) of each operation: writes count one row, reads the rows before the log."""
    known = operations.join(table.select("k", F.lit(1).alias("_there")).distinct(), "k", "left")
    reads = F.upper("op").isin("GET", "SELECT")
    valid = reads | F.upper("op").isin("PUT", "INSERT", "UPDATE", "DELETE")
    return known.select("seq", "op", "k", valid.alias("success"), F.when(reads, F.coalesce("_there", F.lit(0))).when(valid, 1).otherwise(0).cast("long").alias("affected_rows"))


def from_items(df: DataFrame, key: str, value: str, table: str | None = None) -> DataFrame:
    """A key-value table of two columns; with a table's name the keys are the strings of ``Keyed``."""
    return Keyed(df, key, value, table).frame()


#: Digits of the greatest 64-bit integer.
DIGITS = 19


def encoded(table: str, key: int) -> str:
    """The key string of an integer: all have one length after the sign, so that strings are in the order of numbers."""
    return f"{table}:" + (f"-{key + (1 << 63):0{DIGITS}d}" if key < 0 else f"{key:0{DIGITS}d}")


def at_least(table: str, text: str) -> int:
    """The least integer whose key string is not before the text; 2 ** 63 if there is none."""
    low, high = -(1 << 63), 1 << 63
    while low < high:
        middle = (low + high) // 2
        if encoded(table, middle) < text:
            low = middle + 1
        else:
            high = middle
    return low


@dataclass(frozen=True)
class Keyed:
    """Key-value access to a table by its own integer column. With a table's name the keys are strings, ``table:`` and the
    number in 19 digits; bounds on these become bounds on the column, which the reader can use."""

    df: DataFrame
    key: str
    value: str
    table: str | None = None

    def _shown(self, rows: DataFrame) -> DataFrame:
        n = F.col(self.key).cast("long")
        k = F.col(self.key)
        if self.table is not None:
            digits = F.lpad(F.when(n < 0, n - F.lit(-(1 << 63))).otherwise(n).cast("string"), DIGITS, "0")
            k = F.concat(F.lit(f"{self.table}:"), F.when(n < 0, "-").otherwise(""), digits)
        return rows.select(k.alias("k"), F.col(self.value).alias("value"))

    def frame(self) -> DataFrame:
        return self._shown(self.df)

    def _within(self, start: Any, end: Any) -> DataFrame:
        low, high = (start, end) if self.table is None else (at_least(self.table, start), at_least(self.table, end))
        if self.table is not None and low >= 1 << 63:
            return self.df.limit(0)
        out = self.df.where(F.col(self.key) >= low)
        return out if self.table is not None and high >= 1 << 63 else out.where(F.col(self.key) < high)

    def get(self, key: Any) -> DataFrame:
        if self.table is None:
            return self.df.where(F.col(self.key) == key).select(F.col(self.value).alias("value"))
        n = at_least(self.table, key)
        found = self.df.where(F.col(self.key) == n) if n < 1 << 63 and encoded(self.table, n) == key else self.df.limit(0)
        return found.select(F.col(self.value).alias("value"))

    def scan(self, start: Any, end: Any, limit: int = 1000) -> DataFrame:
        """The first keys of start <= key < end."""
        return self._shown(self._within(start, end).orderBy(self.key).limit(limit))


def keys(table: DataFrame, values: Sequence[Any], kind: str = "long") -> DataFrame:
    spark = table.sparkSession
    return spark.createDataFrame([(v,) for v in values], f"k {kind}")
