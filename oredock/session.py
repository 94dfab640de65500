"""A local session with the settings that tests and benchmarks use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": partitions,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.master(f"local[{cores}]").appName("oredock").config(map=conf).getOrCreate()
