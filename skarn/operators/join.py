"""Joins by type and physical strategy. A strategy is a hint; without one Catalyst and AQE choose by size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

#: Names of join types and Spark's.
TYPES = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full", "SEMI": "left_semi", "ANTI": "left_anti"}
#: Strategies and the hints that ask for them.
STRATEGIES = {"HASH": "shuffle_hash", "BROADCAST": "broadcast", "MERGE": "merge", "NESTED_LOOP": "shuffle_replicate_nl"}


def join(left: DataFrame, right: DataFrame, on: str | Column | Sequence[str] | Sequence[Column], how: str = "INNER", strategy: str | None = None) -> DataFrame:
    """SQL multiplicities, null padding, null keys match nothing. A broadcast is for a right side of known size."""
    if how.upper() not in TYPES:
        raise ValueError(f"unknown join type {how}")
    if strategy:
        right = right.hint(STRATEGIES[strategy.upper()])
    return left.join(right, on, TYPES[how.upper()])


def nested_loop(left: DataFrame, right: DataFrame, condition: Column, how: str = "INNER") -> DataFrame:
    """A join by any condition; the right side must be small, as no key spreads the work."""
    return left.join(right, condition, TYPES[how.upper()])


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs; for two small tables."""
    return left.crossJoin(right)
