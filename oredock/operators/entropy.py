"""Symbol statistics, prefix codes and bit placement as joins, aggregations and windows."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# First length of each length symbol from 257 on, and its extra bits.
LENGTH_BASE = [3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 15, 17, 19, 23, 27, 31, 35, 43, 51, 59, 67, 83, 99, 115, 131, 163, 195, 227, 258]
LENGTH_EXTRA = [0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4, 5, 5, 5, 5, 0]
# First distance of each distance symbol from 0 on, and its extra bits.
DISTANCE_BASE = [1, 2, 3, 4, 5, 7, 9, 13, 17, 25, 33, 49, 65, 97, 129, 193, 257, 385, 513, 769, 1025, 1537, 2049, 3073, 4097, 6145, 8193, 12289, 16385, 24577]
DISTANCE_EXTRA = [0, 0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 8, 8, 9, 9, 10, 10, 11, 11, 12, 12, 13, 13]


#: The order in which lengths of the meta alphabet's codes are written; at least this many are.
META_ORDER, META_LEAST = [16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15], 4


def _log2(n: Column) -> Column:
    """The whole part of log2(n) of 1 <= n < 2 ** 15."""
    return reduce(lambda a, b: a + b, [(n >= 1 << k).cast("int") for k in range(1, 15)])


def with_symbol(rows: DataFrame, value: str, kind: str) -> DataFrame:
    """rows with symbol, extra (bits) and extra_value of a length (3 to 258) or distance (1 to 32768); null for others.

    Symbols follow from the highest bits: each power of two has four symbols of lengths or two of distances.
    """
    v = F.col(value)
    first, per, base, limit = (3, 4, 257, 258) if kind == "length" else (1, 2, 0, 32768)
    n = v - first
    extra = F.greatest(_log2(F.greatest(n, F.lit(1))) - (2 if per == 4 else 1), F.lit(0))
    high = F.call_function("shiftright", n.cast("int"), extra)
    symbol = base + per * extra + high
    low = n - F.call_function("shiftleft", high, extra)
    inside = v.between(first, limit)
    top = F.lit(kind == "length") & (v == 258)  # 258 has a symbol of its own
    columns = {"symbol": F.when(top, 285).otherwise(symbol), "extra": F.when(top, 0).otherwise(extra), "extra_value": F.when(top, 0).otherwise(low)}
    return rows.select("*", *[F.when(inside, c).cast("int").alias(k) for k, c in columns.items()])


def pack_token(length: Column, distance: Column) -> Column:
    """A token as one number: the length above 16 bits of the distance; a literal has length 0, and its byte there."""
    return F.shiftleft(length.cast("long"), 16).bitwiseOR(distance.cast("long"))


def unpack_token(packed: Column) -> tuple[Column, Column, Column]:
    """(length, distance, is_literal) of a packed token."""
    length = F.shiftright(packed, 16).cast("int")
    return length, packed.bitwiseAND(F.lit(0xFFFF)).cast("int"), length == 0


def reverse_bits(code: Column, n_bits: Column) -> Column:
    """The low n_bits of code in reverse order."""
    return F.conv(F.reverse(F.lpad(F.bin(code), n_bits, F.lit("0"))), 2, 10).cast("long")


def fixed_code(symbol: Column) -> tuple[Column, Column]:
    """(code, bits) of a literal or length symbol in the fixed code."""
    code = F.when(symbol < 144, 48 + symbol).when(symbol < 256, 400 + symbol - 144).when(symbol < 280, symbol - 256).otherwise(192 + symbol - 280)
    return code, F.when(symbol < 144, 8).when(symbol < 256, 9).when(symbol < 280, 7).otherwise(8)


def byte_histogram(streams: DataFrame, key: str) -> DataFrame:
    """key, byte and freq over raw: a task counts the bytes of each key of its batches, Spark adds them up."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict = {}
            for k, raw in zip(batch.column(key).to_pylist(), batch.column("raw").to_pylist()):
                seen[k] = seen.get(k, 0) + np.bincount(np.frombuffer(raw or b"", np.uint8), minlength=256)
            for k, counts in seen.items():
                at = np.nonzero(counts)[0]
                yield pa.RecordBatch.from_pydict({key: pa.array([k] * len(at), batch.column(key).type), "byte": pa.array(at, pa.int32()), "n": pa.array(counts[at], pa.int64())})

    schema = T.StructType([streams.schema[key], T.StructField("byte", T.IntegerType()), T.StructField("n", T.LongType())])
    return streams.select(key, "raw").mapInArrow(counted, schema).groupBy(key, "byte").agg(F.sum("n").alias("freq"))


def shannon_lengths(histogram: DataFrame, key: str) -> DataFrame:
    """Code lengths from the frequencies alone: the least n with freq * 2^n >= total."""
    total = F.sum("freq").over(Window.partitionBy(key))
    fits = F.filter(F.sequence(F.lit(1), F.lit(40)), lambda n: F.expr("freq").cast("decimal(38,0)") * F.pow(F.lit(2), n).cast("decimal(20,0)") >= F.col("total"))
    return histogram.withColumn("total", total).select(key, "byte", "freq", F.element_at(fits, 1).alias("bits"))


def canonical_codes(lengths: DataFrame, key: str, symbol: str) -> DataFrame:
    """code: prefix codes in order of (bits, symbol), from a running sum of the shares 2^-bits."""
    before = Window.partitionBy(key).orderBy("bits", symbol).rowsBetween(Window.unboundedPreceding, -1)
    share = F.pow(F.lit(2.0), 40 - F.col("bits")).cast("long")
    start = F.coalesce(F.sum(share).over(before), F.lit(0))
    return lengths.withColumn("code", F.floor(start / share).cast("long"))


def huffman(freq: list[int], limit: int = 15) -> list[int]:
    """Optimal code lengths; equal weights in order of symbols; frequencies are halved until the limit holds."""
    used = [s for s, f in enumerate(freq) if f]
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols have no code of at most {limit} bits")
    if len(used) <= 1:
        return [1 if s in used else 0 for s in range(len(freq))]
    weights = {s: freq[s] for s in used}
    while True:
        heap = [(w, s, (s,)) for s, w in weights.items()]
        heapq.heapify(heap)
        depth, node = dict.fromkeys(used, 0), len(freq)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], node, a[2] + b[2]))
            node += 1
        if max(depth.values()) <= limit:
            return [depth.get(s, 0) for s in range(len(freq))]
        weights = {s: max(1, w // 2) for s, w in weights.items()}


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def huffman_lengths(freqs: pa.Array) -> pa.Array:
    """Code lengths of dense frequency arrays: the merges of one alphabet, at most a few hundred symbols."""
    return pa.array([huffman(f) for f in freqs.to_pylist()], pa.list_(pa.int32()))


def run_lengths(lengths: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Runs of equal values as (symbol, repeat): 16 repeats the last one 3 to 6 times, 17 and 18 are 3 to 10 and 11 to 138 zeros."""
    order = Window.partitionBy(key).orderBy(at)
    island = F.row_number().over(order) - F.row_number().over(Window.partitionBy(key, value).orderBy(at))
    runs = lengths.withColumn("island", island).groupBy(key, value, "island").agg(F.min(at).alias("start"), F.count("*").cast("int").alias("n"))

    def cut(left: Column, most: int, symbol: Column) -> Column:
        """Pieces of at most `most`, then single values for a rest below 3."""
        whole, rest = F.floor(left / most).cast("int"), (left % most).cast("int")
        full = F.array_repeat(F.struct(symbol.alias("symbol"), F.lit(most).alias("repeat")), whole)
        tail = F.when(rest >= 3, F.array(F.struct(symbol.alias("symbol"), rest.alias("repeat")))).otherwise(F.array_repeat(F.struct(F.col(value).alias("symbol"), F.lit(1).alias("repeat")), rest))
        return F.concat(full, tail)

    n = F.col("n")
    big = F.floor(n / 138).cast("int")
    rest = (n % 138).cast("int")
    zeros = F.concat(F.array_repeat(F.struct(F.lit(18).alias("symbol"), F.lit(138).alias("repeat")), big), F.when(rest >= 11, F.array(F.struct(F.lit(18).alias("symbol"), rest.alias("repeat")))).otherwise(cut(rest, 10, F.lit(17))))
    others = F.concat(F.array(F.struct(F.col(value).alias("symbol"), F.lit(1).alias("repeat"))), cut(n - 1, 6, F.lit(16)))
    parts = F.when(F.col(value) == 0, zeros).otherwise(others)
    return runs.select(key, "start", F.posexplode(parts).alias("part", "x")).select(key, "start", "part", "x.symbol", "x.repeat")


def trimmed(lengths: DataFrame, key: str, at: str, value: str, least: int) -> DataFrame:
    """key and kept: how many lengths are left when zeros at the end go, `least` at the fewest."""
    return lengths.groupBy(key).agg(F.greatest(F.lit(least), F.coalesce(F.max(F.when(F.col(value) > 0, F.col(at))) + 1, F.lit(0))).cast("int").alias("kept"))


def meta_order(frequencies: DataFrame, key: str) -> DataFrame:
    """The meta alphabet (key, symbol, freq) in the order in which its lengths are written, without the unused end: key, place, symbol, freq."""
    order = frequencies.sparkSession.createDataFrame(list(enumerate(META_ORDER)), "place int, symbol int")
    every = frequencies.select(key).distinct().crossJoin(F.broadcast(order)).join(frequencies, [key, "symbol"], "left").fillna(0, ["freq"])
    return every.join(trimmed(every, key, "place", "freq", META_LEAST), key).filter(F.col("place") < F.col("kept")).select(key, "place", "symbol", "freq")


def bit_offsets(writes: DataFrame, key: str, order: str, first: int = 0) -> DataFrame:
    """offset: the bits written before, by a window over each block."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return writes.withColumn("offset", F.coalesce(F.sum("n_bits").over(before), F.lit(0)).cast("long") + first)


def bit_words(placed: DataFrame, key: str) -> DataFrame:
    """key, word and value: 32-bit words, each the OR of the writes that touch it. A write has at most 32 bits."""
    shift = (F.col("offset") % 32).cast("int")
    shifted = F.call_function("shiftleft", F.col("value").cast("long"), shift)
    low, high = shifted.bitwiseAND(F.lit(0xFFFFFFFF)), F.call_function("shiftrightunsigned", F.col("value").cast("long"), F.lit(32) - shift)
    word = F.floor(F.col("offset") / 32)
    parts = F.array(F.struct(word.alias("word"), low.alias("v")), F.struct((word + 1).alias("word"), F.when(shift + F.col("n_bits") > 32, high).otherwise(0).alias("v")))
    rows = placed.select(key, F.explode(parts).alias("x")).select(key, "x.word", "x.v")
    return rows.groupBy(key, "word").agg(F.bit_or("v").alias("value"))
