"""Set operations on tables of the same columns, as sets or as bags, with nulls equal to nulls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame


def union(left: DataFrame, right: DataFrame, distinct: bool = False) -> DataFrame:
    out = left.union(right)
    return out.distinct() if distinct else out


def _same(left: DataFrame, right: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in zip(left.columns, right.columns, strict=True)])


def intersect(left: DataFrame, right: DataFrame, bag: bool = False) -> DataFrame:
    """As a bag: every left row that the right has, as often as the left has it. As a set: SQL's INTERSECT."""
    if not bag:
        return left.intersect(right)
    other = right.distinct()
    return left.join(other, _same(left, other), "left_semi")


def difference(left: DataFrame, right: DataFrame, bag: bool = False) -> DataFrame:
    """As a bag: every left row that the right lacks, as often as the left has it. As a set: SQL's EXCEPT."""
    if not bag:
        return left.subtract(right)
    other = right.distinct()
    return left.join(other, _same(left, other), "left_anti")
