"""Session settings shared by tests, benchmarks and queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DATA_DIR = "/root/testdata"


def local_session(cores: int | str = 8, name: str = "foliant") -> SparkSession:
    """A local session with the settings the engine assumes (UTC, AQE on)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture table, read lazily so column pruning reaches the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
