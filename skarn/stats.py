"""Statistics of tables, columns and keys, each one aggregation over the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a page, and one of how many rows is sampled, for table statistics.
PAGE, SAMPLE = 100, 10


def table(df: DataFrame) -> DataFrame:
    n = F.count("*")
    return df.agg(n.alias("row_count"), F.ceil(n / PAGE).cast("long").alias("page_count"), F.floor(n / SAMPLE).cast("long").alias("sample_size"))


def column(df: DataFrame, name: str) -> DataFrame:
    return df.agg((F.count("*") - F.count(name)).alias("null_count"), F.count_distinct(name).alias("distinct_count"), F.min(name).alias("lo"), F.max(name).alias("hi"))


def column_sketch(df: DataFrame, name: str, buckets: int = 10) -> DataFrame:
    """Estimates in one pass and bounded memory: distinct values, and bounds of equal-height buckets."""
    points = F.array(*[F.lit(i / buckets) for i in range(buckets + 1)])
    return df.agg(F.approx_count_distinct(name).alias("distinct_estimate"), F.percentile_approx(name, points).alias("bounds"), F.avg(F.length(F.col(name).cast("string"))).alias("average_width"))


def most_common(df: DataFrame, name: str, n: int) -> DataFrame:
    return df.groupBy(F.col(name).alias("val")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "val").limit(n)


def key(df: DataFrame, *columns: str) -> DataFrame:
    """Whether the columns are a key, and how many values they have."""
    one = df.groupBy(*columns).agg(F.count("*").alias("_n"))
    return one.agg((F.coalesce(F.max("_n"), F.lit(1)) == 1).alias("is_unique"), F.count("*").alias("distinct_count"))


def shards(df: DataFrame, name: str, width: int) -> DataFrame:
    """Rows and key range of each shard of this many keys."""
    return df.groupBy(F.floor(F.col(name) / width).cast("long").alias("shard")).agg(F.count("*").alias("n"), F.min(name).alias("lo"), F.max(name).alias("hi"))
