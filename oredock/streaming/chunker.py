"""Chunking of byte streams that arrive as files, with Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from oredock.functions import codecs
from oredock.operators import chunks


def _run(spark: SparkSession, path: str, schema: StructType, folder: str, files_per_batch: int, rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Send rows(documents) of the parquet files under path to a parquet sink under folder, a few files a micro-batch, until all are read.

    The sink has a checkpoint beside it: a query that was stopped goes on where it was.
    """
    out = f"{folder}/stream-{uuid.uuid4().hex}"
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    query = rows(docs).writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows")
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def chunk_files(spark: SparkSession, path: str, schema: StructType, size: int, folder: str, files_per_batch: int = 4) -> DataFrame:
    """Plan the chunks of documents that arrive. A document is one stream, so a micro-batch never ends within a chunk."""
    return _run(spark, path, schema, folder, files_per_batch, lambda docs: chunks.plan(docs.select(F.col("doc_id").alias("stream_id"), F.length(chunks.bytes_of()).cast("long").alias("n_bytes")), size))


def encode_files(spark: SparkSession, path: str, schema: StructType, size: int, folder: str, codec: str = "gzip", files_per_batch: int = 4) -> DataFrame:
    """stream_id, chunk_index and packed: the chunks of documents that arrive, each a member or frame of its own."""

    def members(docs: DataFrame) -> DataFrame:
        parts = chunks.split(docs.select(F.col("doc_id").alias("stream_id"), chunks.bytes_of().alias("raw")), size)
        return parts.select("stream_id", "chunk_index", codecs.encode(codec, F.col("raw")).alias("packed"))

    return _run(spark, path, schema, folder, files_per_batch, members)
