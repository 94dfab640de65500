"""Best-fit packing of documents into token sequences with Martello-Toth dominance reduction (operator 4).

Documents become pieces of at most `size` tokens, written once to the shared folder. Only the histogram
of piece lengths (at most `size` numbers, whatever the input) goes to the driver. There:

* reduction: a set of lengths that provably dominates every other way to fill the bin of one of its
  members is fixed for good, as often as the histogram allows, which shrinks the instance: a length and
  its exact complement; then for every length from the largest down, until a whole pass fixes nothing:
  it alone where nothing fits beside it; it and the largest one that fits where no two fit; it and two
  others where no three fit and each is the largest it could be;
* the rest is packed best-fit decreasing: bins of equal room form classes, and a run of equal lengths
  goes to the class with the least room that fits.

A piece that fills a sequence dominates whatever else could fill it: it stays where it is, gets a
sequence of its own (numbers below 0) and takes no part in what follows, so it isn't shuffled.

The plan says, for each length and range of ranks, where these pieces go. Ranks are numbered within
(length, slice), and pieces are dealt to slices in turn, so neither a frequent length nor repeated rows are one task's;
the slices' sizes are at most size * SLICES numbers.

Defined cases: a null text counts as empty and is one piece with the end token; very long documents
are cut; repeated rows are packed one by one; null ids are kept; empty input gives no rows; other
columns are left out.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oredock.llm.common import materialize, read, text_of

SIZE, END, SLICES = 1024, 2, 256
SPECIAL = "<|endoftext|>"


class Tokens:
    """Token ids of whole texts."""

    def __init__(self, ranks: str, pattern: str, special: dict[str, int]):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=table, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all")


def tokenized(docs: DataFrame, ranks: str, pattern: str, special: dict[str, int], size: int = SIZE, end: int = END) -> DataFrame:
    """Pieces: doc_id, piece, start, length, slice (pieces are dealt out to slices in turn), ids_crc32 and ids (little-endian, four bytes each)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, count = Tokens(ranks, pattern, special), TaskContext.get().partitionId()
        for batch in batches:
            owner, number, start, length, parts = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(encode(text), np.uint32(end)).astype("<u4").tobytes()
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    step = (n - at) % size or size
                    owner.append(i)
                    number.append(k)
                    start.append(at)
                    length.append(step)
                    parts.append(ids[4 * at : 4 * (at + step)])
                    at, k = at + step, k + 1
            crc = pa.array([zlib.crc32(p) for p in parts], pa.int64())
            dealt = pa.array(((count + np.arange(len(parts))) % SLICES).astype(np.int32))
            count += len(parts)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(owner, pa.int64())), "piece": pa.array(number, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "slice": dealt, "ids_crc32": crc, "ids": pa.array(parts, pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, slice int, ids_crc32 long, ids binary")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def as_array(ids: pa.Array) -> pa.Array:
    whole = ids.cast(pa.large_binary())
    values = np.frombuffer(b"".join(whole.to_pylist()), "<i4")
    sizes = np.array([len(x) // 4 for x in whole.to_pylist()])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


class Plan:
    """Where pieces go: rows of (length, first rank, ranks, first sequence, offset)."""

    def __init__(self, counts: np.ndarray, size: int):
        """counts[l]: pieces of length l, 0 <= l <= size."""
        self.size, self.left = size, counts.astype(np.int64).copy()
        self.used = np.zeros(size + 1, dtype=np.int64)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.bins, self.fixed = 0, 0
        self._reduce()
        self._best_fit()

    def _put(self, length: int, times: int, first: int, offset: int) -> None:
        self.rows.append((length, int(self.used[length]), times, first, offset))
        self.used[length] += times
        self.left[length] -= times

    def _fix(self, lengths: list[int]) -> None:
        """Bins with exactly these lengths, as many as there are."""
        times = min(int(self.left[x]) // lengths.count(x) for x in lengths)
        at = 0
        for x in lengths:
            self._put(x, times, self.bins, at)
            at += x
        self.bins += times
        self.fixed += times

    def _largest(self, limit: int, taken: list[int]) -> int:
        """The largest length up to limit of which one is left besides those taken; 0 if none."""
        for x in range(min(limit, self.size), 0, -1):
            if self.left[x] > taken.count(x):
                return x
        return 0

    def _smallest(self, taken: list[int], number: int) -> list[int]:
        out: list[int] = []
        for x in range(1, self.size + 1):
            out += [x] * min(number - len(out), max(0, int(self.left[x]) - taken.count(x)))
            if len(out) == number:
                break
        return out

    def _reduce(self) -> None:
        for x in range(1, self.size // 2 + 1):  # exact complements
            other = self.size - x
            if self.left[x] >= 1 + (x == other) and self.left[other]:
                self._fix([other, x])
        before = -1
        while self.fixed > before:  # until a whole pass fixes nothing
            before = self.fixed
            for x in range(self.size, 0, -1):
                while self.left[x] and self._dominated(x):
                    pass

    def _dominated(self, x: int) -> bool:
        """Fix the set that dominates all others with an item of length x, if one is found."""
        room = self.size - x
        best = self._largest(room, [x])
        if not best:
            self._fix([x])
            return True
        low = self._smallest([x], 3)
        if len(low) < 2 or low[0] + low[1] > room:  # no two fit beside it
            self._fix([x, best])
            return True
        second = self._largest(room - best, [x, best])
        if (len(low) < 3 or sum(low) > room) and second and second >= self._largest(room // 2, [x, best]):  # no three fit
            self._fix([x, best, second])
            return True
        return False

    def _best_fit(self) -> None:
        classes: list[list[tuple[int, int]]] = [[] for _ in range(self.size + 1)]  # by room: (first bin, bins)
        for x in range(self.size, 0, -1):
            while (n := int(self.left[x])) > 0:
                room = next((r for r in range(x, self.size + 1) if classes[r]), 0)
                if not room:
                    per = max(1, self.size // x)
                    times = -(-n // per)  # new bins of this length alone
                    whole, rest = divmod(n, per)
                    first = self.bins
                    self.bins += times
                    for k in range(per):
                        bins = whole + (k < rest)
                        if bins:
                            self._put(x, bins, first, k * x)
                    if whole:
                        classes[self.size - per * x].append((first, whole))
                    if rest:
                        classes[self.size - rest * x].append((first + whole, 1))
                    if whole and rest == 0:
                        continue
                    # the bin with the rest holds `rest` of them; its pieces above are one each
                    continue
                first, bins = classes[room].pop()
                times = min(n, bins)
                self._put(x, times, first, self.size - room)
                classes[room - x].append((first, times))
                if bins > times:
                    classes[room].append((first + times, bins - times))

    def lookup(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys (length, first rank) as length << 44 | rank, then first ranks, sequences and offsets."""
        table = np.array(sorted((x << 44 | rank, rank, first, offset) for x, rank, _, first, offset in self.rows), dtype=np.int64).reshape(-1, 4)
        return table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy(), table[:, 3].copy()


def scattered(numbers: np.ndarray) -> np.ndarray:
    """The same numbers, distinct as before, in an order that looks random."""
    x = numbers.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def pack(docs: DataFrame, ranks: str, pattern: str, special: dict[str, int], size: int = SIZE, end: int = END, scatter: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids, sequence_id and offset.

    Sequences are numbered as they are planned, or, with scatter, so that the order of the numbers is a
    shuffle of the sequences.
    """
    pieces = materialize(tokenized(docs, ranks, pattern, special, size, end))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]

    @F.arrow_udf(T.LongType())
    def own_number(row: pa.Array) -> pa.Array:
        return pa.array(scattered(-1 - row.to_numpy()))

    row = F.monotonically_increasing_id()
    full = pieces.filter(F.col("length") == size).select(*columns, row.alias("row")).select(*columns, (own_number("row") if scatter else -1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pieces = pieces.filter(F.col("length") < size)
    counted = pieces.groupBy("length", "slice").count().toPandas()  # at most size * SLICES rows
    grid = np.zeros((size + 1, SLICES), dtype=np.int64)
    grid[counted["length"].to_numpy(np.int64), counted["slice"].to_numpy(np.int64)] = counted["count"].to_numpy(np.int64)
    base = np.cumsum(grid, axis=1) - grid
    keys, first_rank, first_bin, offsets = Plan(grid.sum(axis=1), size).lookup()

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, part: pa.Array, number: pa.Array) -> pa.Array:
        x = length.to_numpy(zero_copy_only=False).astype(np.int64)
        rank = base[x, part.to_numpy(zero_copy_only=False)] + number.to_numpy(zero_copy_only=False) - 1
        at = np.searchsorted(keys, x << 44 | rank, side="right") - 1
        sequence = first_bin[at] + rank - first_rank[at]
        return pa.StructArray.from_arrays([pa.array(scattered(sequence) if scatter else sequence), pa.array(offsets[at])], ["sequence_id", "offset"])

    own = Window.partitionBy("length", "slice").orderBy("doc_id", "piece")
    placed = pieces.withColumn("number", F.row_number().over(own)).withColumn("place", place("length", "slice", "number"))
    rows = placed.select(*columns, "place.sequence_id", "place.offset").unionByName(full)
    return rows.withColumn("ids", as_array("ids"))


def public_tokens() -> tuple[str, str, dict[str, int]]:
    """The vocabulary, pattern and special token of the public byte-level tokenizer that is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {SPECIAL: 50256}


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # without the ids, which then aren't shuffled
    return pack(read(spark, sf_dir, "documents"), *public_tokens()).drop("ids")
