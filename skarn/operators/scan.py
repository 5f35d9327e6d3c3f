"""Scans: whole tables, index-style lookups, page ranges, bitmaps, shards.

Conditions are plain predicates, so that they reach the Parquet reader; an index type is a name for the kind of predicate
it serves, as Spark prunes by file and row-group statistics and has no indexes.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tools import free_name
from .sort import positions

#: Rows of a page: 8192 bytes of 100-byte rows.
PAGE_ROWS = 81
#: Rows that one task may rank, and by how much the quantiles of a page scan are moved outward.
SLICE_ROWS, MARGIN = 50_000, 0.002
#: Statistics that BTREE ranges use are of little help for HASH and BITMAP lookups; all three are predicates here.
INDEX_TYPES = ("BTREE", "HASH", "BITMAP")


def scan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def index_scan(df: DataFrame, columns: Sequence[str], equals: Mapping[str, Any], index_type: str = "BTREE") -> DataFrame:
    """Rows where every column has its value, on columns that need not be projected. Unknown index types are BTREE."""
    return df.where(all_of([F.col(c) == v for c, v in equals.items()])).select(*columns)


def range_scan(df: DataFrame, columns: Sequence[str], key: str, low: Any, high: Any, closed: bool = True) -> DataFrame:
    """Rows with low <= key <= high, or below high if not closed."""
    upper = F.col(key) <= high if closed else F.col(key) < high
    return df.where((F.col(key) >= low) & upper).select(*columns)


def page_scan(df: DataFrame, columns: Sequence[str], key: str, start: int, end: int, page_rows: int = PAGE_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Rows of pages start <= page < end in the order of a unique number, null last.

    Quantiles of the key bound the slice of the table that holds the pages, a count tells how many rows are before it, and
    this is repeated within the slice until it has ``slice_rows`` rows at most beside those of the pages. So the reader
    gets a range of the key, and only the slice is ranked."""
    first, last = start * page_rows, end * page_rows
    page, before, part = free_name(df, "page"), 0, df
    at = F.col(key)
    rows = df.agg(F.count("*")).first()[0]
    last = min(last, rows)
    if first >= last:
        return df.select(*columns, F.lit(None).cast("long").alias("page")).limit(0)
    while rows > slice_rows + last - first:
        shares = [max(0.0, (first - before) / rows - MARGIN), min(1.0, (last - before) / rows + MARGIN)]
        low, high = part.agg(F.percentile_approx(key, shares, 10_000).alias("q")).first()["q"] or (None, None)
        if low is None:
            break
        below, kept = part.agg(F.count_if(at < low), F.count_if((at >= low) & (at <= high))).first()
        # A quantile that is off keeps its end of the slice as it was, as does one that nulls may follow.
        cut_low, cut_high = before + below <= first, before + below + kept >= last
        now = part.where(at >= low) if cut_low and cut_high else part.where(at <= high) if cut_high else part.where((at >= low) | at.isNull()) if cut_low else part
        left = kept if cut_low and cut_high else below + kept if cut_high else rows - below if cut_low else rows
        if left >= rows:
            break
        part, rows, before = (now.where(at <= high) if cut_high else now), left, before + (below if cut_low else 0)
    if rows > slice_rows + page_rows:
        ranked = positions(part, key, name=page).withColumn(page, F.col(page) - 1)
    else:
        ranked = part.withColumn(page, F.row_number().over(Window.orderBy(at.asc_nulls_last())) - 1)
    placed = ranked.where((F.col(page) >= first - before) & (F.col(page) < last - before))
    return placed.select(*columns, F.floor((F.col(page) + before) / page_rows).cast("long").alias("page"))


@dataclass(frozen=True)
class BitmapCondition:
    """Rows whose column has one of the values; op is how it changes the bitmap so far: AND, OR, NOT (flip where it holds)."""

    column: str
    values: tuple
    op: str = "AND"


def bitmap(conditions: Sequence[BitmapCondition]) -> Column:
    """The bitmap after all conditions, folded in order from one where every row is set; an unknown op changes nothing."""
    steps = {"AND": lambda b, m: b & m, "OR": lambda b, m: b | m, "NOT": lambda b, m: b != m}
    out = F.lit(True)
    for c in conditions:
        if step := steps.get(c.op.upper()):
            out = step(out, F.coalesce(F.col(c.column).isin(*c.values), F.lit(False)))
    return out


def bitmap_scan(df: DataFrame, columns: Sequence[str], conditions: Sequence[BitmapCondition]) -> DataFrame:
    return df.where(bitmap(conditions)).select(*columns)


def parallel_scan(df: DataFrame, columns: Sequence[str], workers: int | None = None) -> DataFrame:
    """A scan by as many tasks as the files have splits, or at most ``workers``, without a shuffle; a failed task is tried
    again and at last fails the job, no rows are dropped."""
    out = df.select(*columns)
    return out.coalesce(workers) if workers else out


def shard_of(key: Column, width: int) -> Column:
    return F.floor(key / width).cast("long")


def shard_range_scan(df: DataFrame, columns: Sequence[str], key: str, ranges: Sequence[tuple[Any, Any]]) -> DataFrame:
    """Rows of the union of ranges [start, end) of the key; a row in several is returned once."""
    parts = [(F.col(key) >= a) & (F.col(key) < b) for a, b in ranges]
    return df.where(reduce(lambda a, b: a | b, parts, F.lit(False))).select(*columns)


#: Points of a shard on the ring of consistent hashing, and slots that the ring is cut into.
POINTS, RING = 64, 4096
STRATEGIES = ("MODULO", "HASH", "RANGE", "ROUND_ROBIN", "CONSISTENT_HASH", "DIRECTORY")


def ring(shards: int) -> list[int]:
    """The shard of each slot of the ring: that of the next point. A new shard takes slots only into itself."""
    at = sorted((zlib.crc32(f"{s}/{p}".encode()) * RING >> 32, s) for s in range(shards) for p in range(POINTS))
    slots = [p for p, _ in at]
    return [at[bisect_left(slots, slot) % len(at)][1] for slot in range(RING)]


def shard_by(key: Column, shards: int, strategy: str = "MODULO", bounds: Sequence[Any] = ()) -> Column:
    """The shard of a key: MODULO of an integer, HASH of any value, CONSISTENT_HASH on a ring, RANGE by the first keys of
    shards 1, 2, ... (null in shard 0), ROUND_ROBIN by place. DIRECTORY needs a table, see ``by_directory``."""
    strategy = strategy.upper()
    if strategy == "MODULO":
        return F.pmod(key, F.lit(shards))
    if strategy == "HASH":
        return F.pmod(F.xxhash64(key), F.lit(shards))
    if strategy == "CONSISTENT_HASH":
        slot = F.pmod(F.xxhash64(key), F.lit(RING)).cast("int")
        return F.element_at(F.array(*map(F.lit, ring(shards))), slot + 1)
    if strategy == "RANGE":
        if len(bounds) != shards - 1 or list(bounds) != sorted(bounds):
            raise ValueError("RANGE needs the first key of each shard but the first, in order")
        return reduce(lambda n, b: n + F.coalesce((key >= b).cast("int"), F.lit(0)), bounds, F.lit(0))
    if strategy == "ROUND_ROBIN":
        return F.pmod(F.monotonically_increasing_id(), F.lit(shards))
    raise ValueError(f"no shard of a key by {strategy}")


def by_directory(df: DataFrame, key: str, directory: DataFrame, name: str = "shard", default: int | None = None) -> DataFrame:
    """df with the shard that a directory (key, shard), one row for each key, names for each row; default for others."""
    place = directory.select(F.col("key").alias(free_name(df, "_key")), F.col("shard").alias(free_name(df, "_shard")))
    joined = df.join(place, df[key] == place[place.columns[0]], "left")
    return joined.withColumn(name, F.coalesce(F.col(place.columns[1]), F.lit(default))).drop(*place.columns)


def repartition_by(df: DataFrame, strategy: str, shards: int, *keys: str, directory: DataFrame | None = None) -> DataFrame:
    """HASH and CONSISTENT_HASH by key, RANGE by key order, ROUND_ROBIN, DIRECTORY by a table (key, shard) of one key."""
    strategy = strategy.upper()
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    if strategy == "RANGE":
        return df.repartitionByRange(shards, *keys)
    if strategy == "ROUND_ROBIN":
        return df.repartition(shards)
    if strategy == "CONSISTENT_HASH":
        return df.repartitionById(shards, shard_by(F.struct(*keys), shards, strategy))
    if strategy == "DIRECTORY":
        if directory is None:
            raise ValueError("DIRECTORY needs a table (key, shard)")
        name = free_name(df, "_place")
        return by_directory(df, keys[0], directory, name, 0).repartitionById(shards, F.col(name).cast("int")).drop(name)
    return df.repartition(shards, *keys)
