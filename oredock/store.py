"""Tables and files in the folder that executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session may go without one: it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("oredock.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("oredock.shared.dir", found)
    return found.rstrip("/")


def place(spark: SparkSession, kind: str = "table") -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/{kind}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df by way of the shared folder."""
    path, schema = place(df.sparkSession), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def csv(df: DataFrame, path: str) -> DataFrame:
    """df written as CSV with a header, and read again with its schema."""
    df.write.csv(path, header=True)
    return df.sparkSession.read.schema(df.schema).csv(path, header=True)


def json(df: DataFrame, path: str) -> DataFrame:
    """df written as JSON objects, a line each, and read again with its schema."""
    df.write.json(path)
    return df.sparkSession.read.schema(df.schema).json(path)
