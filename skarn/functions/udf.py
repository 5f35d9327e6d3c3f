"""A registry of user-defined functions: scalar ones work on Arrow batches, aggregates on a group's values."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def scalar(spark: SparkSession, name: str, function: Callable[[pd.Series], pd.Series], returns: str) -> Callable:
    """Registers a function of columns, given and returned as Series; usable in SQL by name and on columns."""

    def call(*columns: pd.Series) -> pd.Series:
        return function(*columns)

    call.__annotations__ = {"columns": pd.Series, "return": pd.Series}
    made = F.pandas_udf(call, returns)
    spark.udf.register(name, made)
    return made


def aggregate(spark: SparkSession, name: str, function: Callable[[pd.Series], float], returns: str) -> Callable:
    """Registers a function of all values of a group; a group must fit a task's memory."""

    def call(values: pd.Series) -> float:
        return function(values)

    made = F.pandas_udf(call, returns)
    spark.udf.register(name, made)
    return made


def table(spark: SparkSession, name: str, handler: type, returns: str) -> Callable:
    """Registers a table function: a class whose ``eval`` yields rows, usable in FROM and LATERAL."""
    made = F.udtf(handler, returnType=returns)
    spark.udtf.register(name, made)
    return made
