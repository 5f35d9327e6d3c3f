"""Settings with checks, for the session and the optimizer."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from pyspark.sql import SparkSession

from .errors import ConfigError


@dataclass(frozen=True)
class Config:
    shuffle_partitions: int = 200
    broadcast_bytes: int = 10 << 20
    batch_rows: int = 10_000
    sample_ratio: float = 0.1
    adaptive: bool = True
    cost_based: bool = True

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if not isinstance(value, bool) and value <= 0:
                raise ConfigError(f"{f.name} must be positive")
        if self.sample_ratio > 1:
            raise ConfigError("sample_ratio must be at most 1")

    @classmethod
    def load(cls, path: str) -> Config:
        try:
            return cls(**json.loads(Path(path).read_text()))
        except (OSError, ValueError, TypeError) as e:
            raise ConfigError(str(e)) from e

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self)))

    def apply(self, spark: SparkSession) -> None:
        for key, value in {
            "spark.sql.shuffle.partitions": self.shuffle_partitions,
            "spark.sql.autoBroadcastJoinThreshold": self.broadcast_bytes,
            "spark.sql.execution.arrow.maxRecordsPerBatch": self.batch_rows,
            "spark.sql.adaptive.enabled": self.adaptive,
            "spark.sql.cbo.enabled": self.cost_based,
            "spark.sql.cbo.joinReorder.enabled": self.cost_based,
        }.items():
            spark.conf.set(key, str(value).lower())
