"""Ranks within groups of any size, with DataFrame functions only and no window over a whole group.

The order of a group is that of a hash, a signed 64-bit integer. A unit is a range of hashes, so that units are in the
order of the ranks, and a row's rank is the number of rows in earlier units plus its place in its own. However units
are cut, ranks are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def units_for(rows: int, unit_rows: int = 65_536, least: int = 10, most: int = 40) -> int:
    """The bits of a unit's number: so many units that one holds about ``unit_rows`` rows of the largest group."""
    return min(most, max(least, (rows // unit_rows).bit_length()))


def unit_of(spread: Column, bits: int) -> Column:
    """The unit of a hash, -2 ** (bits - 1) and up, rising with the hash. Rows of a large group fall into all units."""
    return F.shiftright(spread, 64 - bits)


def before_units(counts: DataFrame, group: list[str], unit: str, n: str = "n") -> DataFrame:
    """counts with column ``before``: rows of the group in earlier units. counts has a row for each group and unit."""
    earlier = Window.partitionBy(*group).orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum(n).over(earlier), F.lit(0)))


def within_unit(group: list[str], unit: str, order: list[str]) -> Column:
    """The 0-based place of a row in its unit of its group."""
    return F.row_number().over(Window.partitionBy(*group, unit).orderBy(*order)).cast("long") - 1


def placed_in(df: DataFrame, group: list[str], unit: Column, order: list[str], name: str) -> DataFrame:
    """df with column ``name``, the 0-based place of a row in its group by (unit, order); unit rises with the order."""
    cut = df.withColumn("_unit", unit)
    counts = cut.groupBy(*group, "_unit").agg(F.count("*").alias("n"))
    before = before_units(counts, group, "_unit").select(*group, "_unit", F.col("before").alias("_before"))
    ranked = cut.withColumn("_within", within_unit(group, "_unit", order)).join(before.hint("merge"), [*group, "_unit"])
    return ranked.withColumn(name, F.col("_within") + F.col("_before")).drop("_unit", "_within", "_before")
