"""What the whole library shares: literal and free column names, the cluster's shared folder, stored tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ConfigError

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir. Where that is unset, a session in one process gets a
    folder of its own, and one with executors elsewhere, which would not see such a folder, raises."""
    named_folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named_folder:
        return named_folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ConfigError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="skarn-shared-")
    return _own_folder[app]


class Stored:
    """A table written to the shared folder: its lineage is cut, and a lost executor costs no recomputation."""

    def __init__(self, df: DataFrame, label: str, by: list[str] | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/skarn/{label}-{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(self.path)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a file or folder of any store that Spark reads."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or that with underscores in front until no column of df has the name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def named(column: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")
