"""LZ77: hash tables of positions, tokens, their replay, and a DEFLATE block out of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oredock.operators import entropy

MIN_MATCH, MAX_MATCH, WINDOW = 3, 258, 32768
#: Bytes, or tokens, that the functions on whole batches work on at once.
SLICE = 1 << 18
_LENGTH_BASE, _LENGTH_EXTRA = np.array(entropy.LENGTH_BASE), np.array(entropy.LENGTH_EXTRA)
_DISTANCE_BASE, _DISTANCE_EXTRA = np.array(entropy.DISTANCE_BASE), np.array(entropy.DISTANCE_EXTRA)


def _turned(code: int, bits: int) -> int:
    return int(f"{code:0{bits}b}"[::-1], 2)


#: Codes of the fixed code, first bit lowest, and their bits: of literal and length symbols, then of distance symbols (5 bits).
_FIXED_BITS = np.array([8] * 144 + [9] * 112 + [7] * 24 + [8] * 8)
_FIXED = np.array([_turned(c, n) for c, n in zip([*range(48, 192), *range(400, 512), *range(24), *range(192, 200)], _FIXED_BITS.tolist())])
_FAR = np.array([_turned(c, 5) for c in range(30)])


def _slices(weights: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows in order, each of about SLICE in weight or of one row."""
    part = (np.cumsum(weights) - weights) // SLICE
    ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(weights)] if len(weights) else []
    return zip([0, *ends], ends)


def _parts(values: pa.Array) -> Iterator[pa.Array]:
    """Byte strings of a batch, a slice of them at a time."""
    return (values.slice(a, b - a) for a, b in _slices(pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)))


def _joined(raws: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows on end, and where each row starts; the end comes last."""
    return np.frombuffer(b"".join(r or b"" for r in raws), np.uint8), np.cumsum([0, *(len(r or b"") for r in raws)])


def hash3(data: np.ndarray) -> np.ndarray:
    """16 bits from each three bytes in a row, by multiplication with 0x9E3779B1 modulo 2^32."""
    wide = data.astype(np.uint64)
    value = wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:]
    return (value * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)).astype(np.int64) >> 16


def _segment_rows(data: np.ndarray, starts: np.ndarray, segment: int) -> tuple[np.ndarray, ...]:
    """row, hash, segment, oldest, newest and positions of each hash in each segment of each row."""
    sizes = np.maximum(np.diff(starts) - 2, 0)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[row]
    if not len(place):
        return (place,) * 6
    # by hash, then place; rows and segments follow from places
    keys = np.sort(hash3(data)[place] << 47 | np.arange(len(place)))
    hashed, order = keys >> 47, keys & (1 << 47) - 1
    row, p = row[order], (place - starts[row])[order]
    part = p // segment
    first = np.flatnonzero((np.diff(hashed, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
    after = np.append(first[1:], len(p))
    return row[first], hashed[first], part[first], p[first], p[after - 1], after - first


def _merged(rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Such rows, with those of one row, hash and segment made one."""
    order = np.lexsort(rows[2::-1])
    row, hashed, part, oldest, newest, n = (x[order] for x in rows)
    first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(hashed, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
    if not len(first):
        return rows
    return row[first], hashed[first], part[first], np.minimum.reduceat(oldest, first), np.maximum.reduceat(newest, first), np.add.reduceat(n, first)


def segment_table(chunks: DataFrame, segment: int) -> DataFrame:
    """Per chunk, hash and segment of positions: the oldest and the newest position, and how many.

    Chunks are shuffled, not their positions: those of one id, usually a single one, lie next to each other then, and
    what they have in common is added up as they pass. The table of the last id is held until another id comes.
    """
    if segment < 1:
        raise ValueError("a segment has a position at least")
    out = T.StructType([chunks.schema["chunk_id"], *(T.StructField(n, t) for n, t in (("hash", T.LongType()), ("segment", T.IntegerType()), ("oldest", T.IntegerType()), ("newest", T.IntegerType()), ("positions", T.LongType())))])

    def table(ids: pa.Array, rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        columns = [pa.array(x, t) for x, t in zip(rows[1:], (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(rows[0])), *columns], out.names)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_id, held = None, None  # ids as an array of one, and its rows
        for batch in batches:
            ids, raws = batch.column("chunk_id"), batch.column("raw")
            weights = pc.binary_length(raws).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in _slices(weights):
                names = ids.slice(a, b - a)
                keys = names.to_pylist()
                group = np.cumsum([0, *(x != y for x, y in zip(keys, keys[1:]))])
                rows = _segment_rows(*_joined(raws.slice(a, b - a).to_pylist()), segment)
                rows = (group[rows[0]], *rows[1:])
                again = held is not None and held_id[0].as_py() == keys[0]
                if again:
                    rows = tuple(np.concatenate(x) for x in zip((np.zeros_like(held[0]), *held[1:]), rows))
                elif held is not None:
                    yield table(held_id, held)
                if again or group[-1] + 1 < len(keys):
                    rows = _merged(rows)
                last = rows[0] == group[-1]
                of_group = names.take(pa.array(np.flatnonzero(np.diff(group, prepend=-1))))
                yield table(of_group, tuple(x[~last] for x in rows))
                held_id, held = of_group.slice(len(of_group) - 1), tuple(np.zeros_like(x[last]) if i == 0 else x[last] for i, x in enumerate(rows))
        if held is not None:
            yield table(held_id, held)

    return chunks.select("chunk_id", "raw").repartition("chunk_id").sortWithinPartitions("chunk_id").mapInArrow(added, out)


def _matches(data: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Length and distance, at each byte, of its match with the latest place before in the row with the same three bytes; 0 for none."""
    size, sizes = len(data), np.diff(starts)
    first, end = np.repeat(starts[:-1], sizes), np.repeat(starts[1:], sizes)
    places = np.arange(size)
    length, distance = np.zeros(size, np.int64), np.zeros(size, np.int64)
    three = np.flatnonzero(places + 3 <= end)
    wide = data.astype(np.int64)
    # by three bytes, then place: the one before is the latest that came earlier
    keys = np.sort((wide[three] << 16 | wide[three + 1] << 8 | wide[three + 2]) << 39 | three)
    at, key = keys & (1 << 39) - 1, keys >> 39
    again = np.flatnonzero(key[1:] == key[:-1])
    here, before = at[again + 1], at[again]
    near = (before >= first[here]) & (here - before <= window)
    distance[here[near]] = (here - before)[near]
    # neighbours of one distance share their match: only the last of each run is compared
    found = np.flatnonzero(distance)
    last = found[distance[found] != np.append(distance, 0)[found + 1]]
    reach = np.full(len(last), MIN_MATCH)
    live = np.arange(len(last))
    for n in range(MIN_MATCH, MAX_MATCH):
        live = live[last[live] + n < end[last[live]]]
        place = last[live] + n
        live = live[data[place] == data[place - distance[last[live]]]]
        if not len(live):
            break
        reach[live] += 1
    run = np.searchsorted(last, found)
    length[found] = np.minimum(MAX_MATCH, reach[run] + last[run] - found)
    return length, distance


def _tokens(raws: list[bytes | None], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths and distances (bytes for literals) of the tokens of all rows, and where each row's start; the end comes last."""
    data, starts = _joined(raws)
    length, distance = _matches(data, starts, window)
    literal = (length == 0) | (np.append(length[1:], 0) > length)
    # no match goes beyond its row, so one walk meets the start of each
    jump, taken, p = np.where(literal, 1, length).tolist(), [], 0
    while p < len(jump):
        taken.append(p)
        p += jump[p]
    at = np.array(taken, np.int64)
    return np.where(literal, 0, length)[at].astype(np.int32), np.where(literal, data, distance)[at].astype(np.int32), np.searchsorted(at, starts)


def _replayed(lengths: list[int], distances: list[int]) -> bytes:
    data = bytearray()
    for n, d in zip(lengths, distances):
        if not n:
            data.append(d)
        elif n <= d:
            at = len(data) - d
            data += data[at : at + n]
        else:  # the copy overlaps itself
            data += (data[-d:] * (n // d + 1))[:n]
    return bytes(data)


def tokenize(raw: bytes, window: int = WINDOW) -> list[tuple[int, int]]:
    """(length, distance) or (0, byte) tokens, with one step of look-ahead: a longer match at the next byte wins."""
    lengths, distances, _ = _tokens([raw], window)
    return list(zip(lengths.tolist(), distances.tolist()))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("length", T.IntegerType()), T.StructField("distance", T.IntegerType())])))
def tokens_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for values in batches:
        if not len(values):
            yield pa.array([], pa.list_(pa.struct([("length", pa.int32()), ("distance", pa.int32())])))
        for part in _parts(values):
            lengths, distances, starts = _tokens(part.to_pylist())
            pairs = pa.StructArray.from_arrays([pa.array(lengths), pa.array(distances)], ["length", "distance"])
            yield pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pairs, mask=part.is_null())


@F.arrow_udf(T.BinaryType())
def replay(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The bytes that tokens stand for; copies may overlap themselves."""
    for tokens in batches:
        if not len(tokens):
            yield pa.array([], pa.binary())
        counts = pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in _slices(counts):
            flat = tokens.slice(a, b - a).flatten()
            lengths, distances = (pc.struct_field(flat, [i]).to_pylist() for i in (0, 1))
            starts = np.cumsum([0, *counts[a:b]]).tolist()
            out = [None if null else _replayed(lengths[i:j], distances[i:j]) for i, j, null in zip(starts, starts[1:], tokens.slice(a, b - a).is_null().to_pylist())]
            yield pa.array(out, pa.binary())


@F.arrow_udf(T.BinaryType())
def reconstructed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """replay of tokens_of; tokens stay within the slice that they are made and replayed in."""
    for values in batches:
        if not len(values):
            yield pa.array([], pa.binary())
        for part in _parts(values):
            raws = part.to_pylist()
            lengths, distances, starts = _tokens(raws)
            lengths, distances, starts = lengths.tolist(), distances.tolist(), starts.tolist()
            yield pa.array([None if r is None else _replayed(lengths[i:j], distances[i:j]) for r, i, j in zip(raws, starts, starts[1:])], pa.binary())


def symbol_counts(tokens: DataFrame, key: str) -> DataFrame:
    """key, alphabet (literal or distance), symbol and freq; the end of the block counts once."""
    lengths = entropy.with_symbol(tokens.filter("length > 0"), "length", "length").select(key, F.lit("literal").alias("alphabet"), "symbol")
    literals = tokens.filter("length = 0").select(key, F.lit("literal").alias("alphabet"), F.col("distance").alias("symbol"))
    ends = tokens.select(key).distinct().select(key, F.lit("literal").alias("alphabet"), F.lit(256).alias("symbol"))
    distances = entropy.with_symbol(tokens.filter("length > 0"), "distance", "distance").select(key, F.lit("distance").alias("alphabet"), "symbol")
    return lengths.unionByName(literals).unionByName(ends).unionByName(distances).groupBy(key, "alphabet", "symbol").agg(F.count("*").alias("freq"))


def _counts(lengths: np.ndarray, distances: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, alphabet (0 literal, 1 distance), symbol and frequency, in this order, of what the tokens of each row use; the end of the block counts once a row."""
    rows = len(starts) - 1
    row, copy = np.repeat(np.arange(rows), np.diff(starts)), lengths > 0
    symbol = np.where(copy, 256 + np.searchsorted(_LENGTH_BASE, lengths, "right"), distances)
    far = np.searchsorted(_DISTANCE_BASE, distances[copy], "right") - 1
    keys, freq = np.unique(np.concatenate([row << 10 | symbol, np.arange(rows) << 10 | 256, row[copy] << 10 | 512 | far]), return_counts=True)
    return keys >> 10, keys >> 9 & 1, keys & 511, freq


_SYMBOL = T.StructType([T.StructField("alphabet", T.StringType()), T.StructField("symbol", T.IntegerType()), T.StructField("freq", T.LongType())])


@F.arrow_udf(T.StructType([T.StructField("tokens", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("symbols", T.ArrayType(_SYMBOL))]))
def symbols_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """How many tokens each chunk has, how many of them are copies, and symbol_counts of them; tokens stay within their slice."""
    alphabets = pa.array(["literal", "distance"])
    each = pa.struct([("alphabet", pa.string()), ("symbol", pa.int32()), ("freq", pa.int64())])
    for values in batches:
        if not len(values):
            yield pa.array([], pa.struct([("tokens", pa.int64()), ("copies", pa.int64()), ("symbols", pa.list_(each))]))
        for part in _parts(values):
            lengths, distances, starts = _tokens(part.to_pylist())
            row, alphabet, symbol, freq = _counts(lengths, distances, starts)
            used = pa.StructArray.from_arrays([alphabets.take(pa.array(alphabet)), pa.array(symbol, pa.int32()), pa.array(freq, pa.int64())], fields=list(each))
            symbols = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(starts))), pa.int32()), used)
            copies = np.diff(np.cumsum([0, *(lengths > 0)])[starts])
            yield pa.StructArray.from_arrays([pa.array(np.diff(starts), pa.int64()), pa.array(copies, pa.int64()), symbols], ["tokens", "copies", "symbols"], mask=part.is_null())


def _writes(lengths: np.ndarray, distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value and number of bits of each token as one write of at most 31 bits in the fixed code.

    A token's bits are its length or literal code, length's extra bits, distance code and distance's extra bits.
    """
    copy = lengths > 0
    if not np.where(copy, (lengths >= MIN_MATCH) & (lengths <= MAX_MATCH) & (distances >= 1) & (distances <= WINDOW), (lengths == 0) & (distances >= 0) & (distances < 256)).all():
        raise ValueError("a token is a byte, or a length of 3 to 258 and a distance of 1 to 32768")
    n, d = np.where(copy, lengths, MIN_MATCH), np.where(copy, distances, 1)
    of_length, of_distance = np.searchsorted(_LENGTH_BASE, n, "right") - 1, np.searchsorted(_DISTANCE_BASE, d, "right") - 1
    symbol = np.where(copy, 257 + of_length, distances)
    value, bits = _FIXED[symbol], _FIXED_BITS[symbol]
    value = value | np.where(copy, n - _LENGTH_BASE[of_length], 0) << bits
    bits = bits + np.where(copy, _LENGTH_EXTRA[of_length], 0)
    value |= np.where(copy, _FAR[of_distance], 0) << bits
    bits = bits + 5 * copy
    value |= np.where(copy, d - _DISTANCE_BASE[of_distance], 0) << bits
    return value, bits + np.where(copy, _DISTANCE_EXTRA[of_distance], 0)


def _blocks(lengths: np.ndarray, distances: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """One final DEFLATE block for the tokens of each row, and its bits: running sums place the writes, ORs make 32-bit words."""
    rows, counts = len(starts) - 1, np.diff(starts)
    row = np.repeat(np.arange(rows), counts)
    # a row's writes: 3 bits of header, its tokens, 7 bits of end
    head, end = starts[:-1] + 2 * np.arange(rows), starts[1:] + 2 * np.arange(rows) + 1
    value, bits = np.zeros(len(row) + 2 * rows, np.int64), np.zeros(len(row) + 2 * rows, np.int64)
    value[head], bits[head], bits[end] = 3, 3, 7
    place = np.arange(len(row)) + 2 * row + 1
    value[place], bits[place] = _writes(lengths.astype(np.int64), distances.astype(np.int64))
    before = np.cumsum(bits) - bits
    total = before[end] + bits[end] - before[head]
    # each row begins with a word of its own
    words = (total + 31) // 32
    first = np.cumsum(words) - words
    offset = before + np.repeat(first * 32 - before[head], counts + 2)
    shifted, word = value << offset % 32, offset // 32
    out = np.zeros(words.sum() + 1, np.int64)
    each = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[each]] = np.bitwise_or.reduceat(shifted & 0xFFFFFFFF, each)
    out[word[each] + 1] |= np.bitwise_or.reduceat(shifted >> 32, each)
    data = out.astype("<u4").tobytes()
    return [data[4 * a : 4 * a + (n + 7) // 8] for a, n in zip(first.tolist(), total.tolist())], total


@F.arrow_udf(T.BinaryType())
def deflated(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Each chunk as one final DEFLATE block in the fixed code."""
    for values in batches:
        if not len(values):
            yield pa.array([], pa.binary())
        for part in _parts(values):
            blocks, _ = _blocks(*_tokens(part.to_pylist()))
            yield pa.array([None if null else b for b, null in zip(blocks, part.is_null().to_pylist())], pa.binary())


@F.arrow_udf(T.StructType([T.StructField("block", T.BinaryType()), T.StructField("bits", T.LongType())]))
def blocks_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The final DEFLATE block that lists of tokens (length, distance) make, and its bits."""
    for tokens in batches:
        if not len(tokens):
            yield pa.array([], pa.struct([("block", pa.binary()), ("bits", pa.int64())]))
        counts = pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in _slices(counts):
            flat = tokens.slice(a, b - a).flatten()
            blocks, bits = _blocks(*(pc.struct_field(flat, [i]).to_numpy(zero_copy_only=False) for i in (0, 1)), np.cumsum([0, *counts[a:b]]))
            yield pa.StructArray.from_arrays([pa.array(blocks, pa.binary()), pa.array(bits, pa.int64())], ["block", "bits"])


def deflate_blocks(tokens: DataFrame) -> DataFrame:
    """chunk_id, block and bits: one final DEFLATE block per chunk of tokens(chunk_id, i, length, distance), gathered in one shuffle."""
    ordered = F.array_sort(F.collect_list(F.struct("i", "length", "distance")))
    pairs = F.transform(ordered, lambda t: F.struct(t["length"].cast("int").alias("length"), t["distance"].cast("int").alias("distance")))
    return tokens.groupBy("chunk_id").agg(pairs.alias("tokens")).select("chunk_id", blocks_of("tokens").alias("b")).select("chunk_id", "b.block", "b.bits")
