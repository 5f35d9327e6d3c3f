"""Readers and writers of files and databases; filters and columns reach them by Catalyst's pushdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..errors import StorageError

FORMATS = ("parquet", "orc", "csv", "json", "text")
#: Engines that a JDBC URL can name.
DATABASES = {"MySQL": "jdbc:mysql", "PostgreSQL": "jdbc:postgresql"}


def read(spark: SparkSession, path: str, kind: str = "parquet", **options: str) -> DataFrame:
    if kind not in FORMATS:
        raise StorageError(f"unknown format {kind}")
    if kind == "csv":
        options = {"header": "true", "inferSchema": "true", **options}
    return spark.read.format(kind).options(**options).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", by: tuple[str, ...] = (), **options: str) -> None:
    if kind not in FORMATS:
        raise StorageError(f"unknown format {kind}")
    if kind == "csv":
        options = {"header": "true", **options}
    writer = df.write.format(kind).mode(mode).options(**options)
    (writer.partitionBy(*by) if by else writer).save(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def database(spark: SparkSession, engine: str, server: str, name: str, query: str, **options: str) -> DataFrame:
    """A query to a database through JDBC, whose driver must be on the class path."""
    if engine not in DATABASES:
        raise StorageError(f"no reader for engine {engine}")
    return spark.read.format("jdbc").option("url", f"{DATABASES[engine]}://{server}/{name}").option("query", query).options(**options).load()
