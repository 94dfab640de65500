"""Byte streams as tables of ordered chunks, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oredock.functions import codecs
from oredock.store import kept


def bytes_of(text: str = "text") -> Column:
    return F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")


def checked_size(size: int) -> int:
    if size < 1:
        raise ValueError("a chunk has a byte at least")
    return size


def plan(streams: DataFrame, size: int) -> DataFrame:
    """stream_id, chunk_index, start and length of each chunk of streams(stream_id, n_bytes); none for an empty stream."""
    last = F.floor((F.col("n_bytes") - 1) / checked_size(size)).cast("int")
    rows = streams.filter("n_bytes > 0").select("stream_id", "n_bytes", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    start = F.col("chunk_index").cast("long") * size
    return rows.select("stream_id", "chunk_index", start.alias("start"), F.least(F.lit(size).cast("long"), F.col("n_bytes") - start).alias("length"))


def split(streams: DataFrame, size: int) -> DataFrame:
    """stream_id, chunk_index and raw of each chunk of streams(stream_id, raw)."""
    sized = streams.withColumn("n_bytes", F.length("raw").cast("long")).filter("n_bytes > 0")
    last = F.floor((F.col("n_bytes") - 1) / checked_size(size)).cast("int")
    rows = sized.select("stream_id", "raw", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    return rows.select("stream_id", "chunk_index", F.substring("raw", F.col("chunk_index") * size + 1, F.lit(size)).alias("raw"))


def sub_split(chunks: DataFrame, size: int) -> DataFrame:
    """Chunks cut again: stream_id, chunk_index, sub_index and raw of each part of chunks(stream_id, chunk_index, raw)."""
    last = F.floor((F.length("raw") - 1) / checked_size(size)).cast("int")
    rows = chunks.filter(F.length("raw") > 0).select("stream_id", "chunk_index", "raw", F.explode(F.sequence(F.lit(0), last)).alias("sub_index"))
    return rows.select("stream_id", "chunk_index", "sub_index", F.substring("raw", F.col("sub_index") * size + 1, F.lit(size)).alias("raw"))


def assemble(chunks: DataFrame, column: str, alias: str) -> DataFrame:
    """stream_id and the concatenation of its chunks by index, in one pass over them."""
    return chunks.groupBy("stream_id").agg(F.expr(f"listagg({column}, X'') WITHIN GROUP (ORDER BY chunk_index)").alias(alias))


def starts(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """rows(key, order, value) with start, the sum of value over the rows before within key, by order.

    Rows are dealt to ranges of (key, order), which are written; sums within a range and over the ranges
    before it make a row's start. No task has all rows of a key.
    """
    ranged = kept(rows.repartitionByRange(key, order).sortWithinPartitions(key, order).withColumn("part", F.spark_partition_id()))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    # a row for each key and range that it reaches
    ahead = ranged.groupBy(key, "part").agg(F.sum(value).alias("whole")).withColumn("ahead", F.coalesce(F.sum("whole").over(before(key, "part")), F.lit(0)))
    inner = ranged.withColumn("inner", F.coalesce(F.sum(value).over(before("part", key, order)), F.lit(0)))
    joined = inner.join(ahead.select(F.col(key).alias("of"), F.col("part").alias("in"), "ahead"), F.col(key).eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
    return joined.select(*rows.columns, (F.col("ahead") + F.col("inner")).cast("long").alias("start"))


def round_trip(streams: DataFrame, codec: str, size: int, level: int = 5) -> DataFrame:
    """Compress each chunk, decompress it, and assemble: stream_id, raw, packed_bytes."""
    packed = split(streams, size).select("stream_id", "chunk_index", codecs.encode(codec, F.col("raw"), level).alias("packed"))
    opened = packed.select("stream_id", "chunk_index", F.length("packed").alias("n"), codecs.decode(codec, F.col("packed")).alias("raw"))
    whole = assemble(opened, "raw", "raw").join(opened.groupBy("stream_id").agg(F.sum("n").cast("long").alias("packed_bytes")), "stream_id")
    return streams.select("stream_id").join(whole, "stream_id", "left").select("stream_id", F.coalesce("raw", F.lit(b"")).alias("raw"), F.coalesce("packed_bytes", F.lit(0)).cast("long").alias("packed_bytes"))
