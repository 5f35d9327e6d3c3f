"""What a DataFrame's plans say, as text and lists; the JVM's plan objects are used here only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Names for rewrites and the optimizer rules that do them. Spark ignores the exclusion of rules it can't do without.
RULES = {
    "constant_folding": ["ConstantFolding", "ConstantPropagation"],
    "expression_simplification": ["BooleanSimplification", "SimplifyBinaryComparison"],
    "subquery_flattening": ["RewritePredicateSubquery", "RewriteCorrelatedScalarSubquery"],
    "predicate_pushdown": ["PushDownPredicates", "PushPredicateThroughJoin", "InferFiltersFromConstraints"],
    "column_pruning": ["ColumnPruning"],
    "join_reorder": ["ReorderJoin", "CostBasedJoinReorder"],
    "order_by": ["EliminateSorts", "RemoveRedundantSorts"],
    "group_by": ["RemoveLiteralFromGroupExpressions", "RemoveRepetitionFromGroupExpressions"],
    "distinct": ["EliminateDistinct", "RemoveRedundantAggregates"],
    "limit": ["LimitPushDown", "EliminateLimits"],
    "union": ["CombineUnions", "PushProjectionThroughUnion"],
}


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df: DataFrame) -> list[str]:
    """Names of the physical operators, from the top."""
    return re.findall(r"^[\s:+|\-*()\d]*([A-Z]\w+)", physical(df), re.MULTILINE)


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", physical(df))


def read_columns(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: struct<([^>]*)>", physical(df))


def shuffles(df: DataFrame) -> int:
    return sum(o == "Exchange" for o in operators(df))


def estimate(df: DataFrame) -> dict[str, int | None]:
    """Catalyst's estimate of the result's bytes and rows."""
    found = df._jdf.queryExecution().optimizedPlan().stats()
    rows = found.rowCount()
    return {"bytes": int(str(found.sizeInBytes())), "rows": int(str(rows.get())) if rows.isDefined() else None}


def features(df: DataFrame) -> dict[str, int]:
    """Counts of joins, aggregates, sorts, scans and shuffles in the physical plan."""
    found = operators(df)
    count = lambda pattern: sum(bool(re.search(pattern, o)) for o in found)
    return {"operators": len(found), "joins": count("Join|Cartesian"), "aggregates": count("Aggregate"), "sorts": count("Sort$|TakeOrdered"), "scans": count("Scan"), "shuffles": count("^Exchange$")}


def disable_rules(spark: SparkSession, *names: str) -> None:
    """Excludes the optimizer rules of these rewrites for the session; none restores all."""
    rules = [f"org.apache.spark.sql.catalyst.optimizer.{r}" for n in names for r in RULES[n]]
    if rules:
        spark.conf.set("spark.sql.optimizer.excludedRules", ",".join(rules))
    else:
        spark.conf.unset("spark.sql.optimizer.excludedRules")
