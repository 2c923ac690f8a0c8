"""Settings from the environment, and the session they describe."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    data_dir: Path = Path("data")
    log_level: str = "INFO"
    random_state: int = 42
    jdbc_url: str | None = None

    @property
    def raw_dir(self) -> Path:
        return self.data_dir / "raw"

    @property
    def clean_dir(self) -> Path:
        return self.data_dir / "interim"

    @property
    def processed_dir(self) -> Path:
        return self.data_dir / "processed"

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Settings:
        return cls(
            Path(env.get("PLUMBLINE_DATA_DIR", "data")),
            env.get("PLUMBLINE_LOG_LEVEL", "INFO"),
            int(env.get("PLUMBLINE_RANDOM_STATE", "42")),
            env.get("PLUMBLINE_JDBC_URL"),
        )


def session(name: str = "plumbline", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` in addition."""
    builder = SparkSession.builder.appName(name)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str):
    """A table of a database; ``partitionColumn`` and its bounds split the read."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def reachable(spark: SparkSession, url: str, **options: str) -> bool:
    """Whether the database answers a query for one row."""
    return read_jdbc(spark, url, "(SELECT 1 AS one) probe", **options).first()["one"] == 1
