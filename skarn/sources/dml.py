"""INSERT, UPDATE and DELETE as steps from one snapshot to the next."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ExecutionError
from ..tools import named

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Insert:
    """Columns by name; those that are not given have their default, or null."""

    rows: DataFrame
    defaults: Mapping[str, Column] = field(default_factory=dict)

    def fitted(self, table: DataFrame) -> DataFrame:
        """The new rows alone, in the table's columns and types."""
        known = {c.lower(): c for c in self.rows.columns}
        if unknown := set(known) - {c.lower() for c in table.columns}:
            raise ExecutionError(f"no such column: {', '.join(sorted(unknown))}")
        value = lambda c: named(known[c.lower()]) if c.lower() in known else self.defaults.get(c, F.lit(None))
        return self.rows.select(*[value(f.name).cast(f.dataType).alias(f.name) for f in table.schema])

    def __call__(self, table: DataFrame) -> DataFrame:
        return table.unionByName(self.fitted(table))


@dataclass(frozen=True)
class Update:
    """Rows where the condition is true get the values, all computed from the row as it was."""

    values: Mapping[str, Column]
    where: Column | None = None

    def __call__(self, table: DataFrame) -> DataFrame:
        hit = F.lit(True) if self.where is None else F.coalesce(self.where, F.lit(False))
        given = {c.lower(): v for c, v in self.values.items()}
        if unknown := set(given) - {c.lower() for c in table.columns}:
            raise ExecutionError(f"no such column: {', '.join(sorted(unknown))}")
        return table.select(*[F.when(hit, given[f.name.lower()].cast(f.dataType)).otherwise(named(f.name)).alias(f.name) if f.name.lower() in given else named(f.name) for f in table.schema])


@dataclass(frozen=True)
class Delete:
    """Rows where the condition is true go; those where it is false or null stay."""

    where: Column | None = None

    def __call__(self, table: DataFrame) -> DataFrame:
        return table.limit(0) if self.where is None else table.where(~F.coalesce(self.where, F.lit(False)))


def insert(rows: DataFrame, defaults: Mapping[str, Column] | None = None) -> Insert:
    return Insert(rows, defaults or {})


def update(values: Mapping[str, Column], where: Column | None = None) -> Update:
    return Update(values, where)


def delete(where: Column | None = None) -> Delete:
    return Delete(where)


def affected(df: DataFrame, where: Column | None = None) -> int:
    """How many rows an update or delete touches."""
    return df.count() if where is None else df.where(where).count()
