"""Aggregation: grouped, global, two-phase for hot keys, distinct. Spark aggregates partially before every shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ExecutionError
from ..tools import free_name

#: Aggregates by name; each ignores nulls, count of "*" counts rows.
FUNCTIONS: dict[str, Callable[[Column], Column]] = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.count_distinct}


def aggregate(name: str, argument: str | Column = "*") -> Column:
    """An aggregate by its name in any case; unknown names raise."""
    try:
        made = FUNCTIONS[name.lower()]
    except KeyError:
        raise ExecutionError(f"unknown aggregate {name}") from None
    return made(F.col(argument) if isinstance(argument, str) and argument != "*" else argument if isinstance(argument, Column) else F.lit(1))


def numeric(column: str | Column) -> Column:
    """A column as numbers; what doesn't parse is null, so that aggregates skip it."""
    return (F.col(column) if isinstance(column, str) else column).try_cast("double")


def group(df: DataFrame, keys: Sequence[str | Column], *aggregates: Column) -> DataFrame:
    """One row for each group; without keys one row, also for no input."""
    return df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)


def two_phase(df: DataFrame, keys: Sequence[str], sums: Sequence[str], salts: int = 16) -> DataFrame:
    """Counts and sums by key in two shuffles, first by key and salt: for keys so hot that even partial results of many
    tasks are too many for one task. Columns: keys, n, sum_<column>."""
    salt = free_name(df, "_salt")
    first = df.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts))).groupBy(*keys, salt).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in sums])
    return first.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(f"sum_{c}").alias(f"sum_{c}") for c in sums])
