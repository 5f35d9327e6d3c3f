"""Sorting, top rows, limits. Null order is always stated; Spark's sort spills to disk by itself."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tools import Stored, free_name


def keys(*columns: str | tuple[str, str]) -> list[Column]:
    """Sort keys from names or (name, "asc" | "desc"); nulls last."""
    out = []
    for c in columns:
        name, way = (c, "asc") if isinstance(c, str) else c
        out.append(F.col(name).desc_nulls_last() if way.lower() == "desc" else F.col(name).asc_nulls_last())
    return out


def sort(df: DataFrame, *columns: str | tuple[str, str]) -> DataFrame:
    return df.orderBy(*keys(*columns))


def positions(df: DataFrame, *columns: str | tuple[str, str], within: Sequence[str] = (), name: str = "pos", large_groups: bool = False) -> DataFrame:
    """The 1-based place of each row in the sorted order, of the table or within groups, as a column.

    Within groups it is a window, with a group in a task; with ``large_groups`` the place in the table in the order of groups
    less that of the group's first row, so that a group may be larger than a task.

    The place in a whole table comes from a distributed sort: rows are dealt by ranges of all keys, so that one frequent
    value of the first is spread, and numbered there; the table is stored so, as ranges are sampled and both uses of them
    must see the same, and the counts of earlier ranges are added. Rows equal in all keys are in one range."""
    order = keys(*columns)
    if within and large_groups:
        start, whole, *own = (free_name(df, n) for n in ("_start", "_place", *(f"_group{k}" for k in range(len(within)))))
        placed = positions(df, *within, *columns, name=whole)
        first = placed.groupBy(*[F.col(c).alias(o) for c, o in zip(within, own, strict=True)]).agg(F.min(whole).alias(start))
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(o)) for c, o in zip(within, own, strict=True)])
        return placed.join(first, same).withColumn(name, F.col(whole) - F.col(start) + 1).drop(start, whole, *own)
    if within:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)).cast("long"))
    part, row = (free_name(df, n) for n in ("_part", "_row"))
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    split = Stored(dealt.withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "positions").df
    counts = dict(map(tuple, split.groupBy(part).agg(F.count("*")).collect()))  # a row for each range, as many as shuffle partitions
    earlier = [0, *accumulate(counts.get(k, 0) for k in range(max(counts, default=-1) + 1))]
    before = F.element_at(F.array(*[F.lit(n).cast("long") for n in earlier]), F.col(part) + 1)
    return split.withColumn(name, before + F.col(row) + 1).drop(part, row)


def top(df: DataFrame, n: int, *columns: str | tuple[str, str]) -> DataFrame:
    """The first n rows of the order: each task keeps n rows, one merges them."""
    return df.orderBy(*keys(*columns)).limit(n)


def limit(df: DataFrame, n: int | None = None, offset: int = 0, *columns: str | tuple[str, str]) -> DataFrame:
    out = df.orderBy(*keys(*columns)) if columns else df
    out = out.offset(offset) if offset else out
    return out if n is None else out.limit(n)
