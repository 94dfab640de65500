"""Chunk codecs as Arrow functions: each chunk becomes a member or frame of its own, which any decoder reads."""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the header of every gzip member that is written (no name, no time, unknown system).
GZIP_HEADER = bytes.fromhex("1f8b08000000000000ff")
ZSTD_LEVELS = [1, 2, 2, 2, 2, 3, 6, 12, 17, 19]


def deflate(raw: bytes, level: int = 5) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    return c.compress(raw) + c.flush()


def zstd(raw: bytes, level: int = 5) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=ZSTD_LEVELS[min(max(level, 0), 9)]).compress(raw)


def unzstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data)


def ungzip(data: bytes) -> bytes:
    """All members, whatever their headers; damaged or truncated data raise an error."""
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        if not d.eof:
            raise ValueError("truncated gzip data")
        data = d.unused_data
    return b"".join(out)


def inflate(data: bytes) -> bytes:
    d = zlib.decompressobj(-15)
    out = d.decompress(data)
    if not d.eof or d.unused_data:
        raise ValueError("damaged deflate data")
    return out


ENCODERS: dict[str, Callable[[bytes, int], bytes]] = {
    "deflate": deflate,
    "zstd": zstd,
    "bzip2": lambda raw, level=5: bz2.compress(raw, max(1, level)),
    "lzma": lambda raw, level=5: lzma.compress(raw, preset=level),
}
DECODERS: dict[str, Callable[[bytes], bytes]] = {"deflate": inflate, "gzip": ungzip, "zstd": unzstd, "bzip2": bz2.decompress, "lzma": lzma.decompress}


def register(name: str, encoder: Callable[[bytes, int], bytes] | None = None, decoder: Callable[[bytes], bytes] | None = None) -> None:
    """Offer a codec under a name to encode and decode; one that is there already is replaced."""
    if encoder:
        ENCODERS[name] = encoder
    if decoder:
        DECODERS[name] = decoder


def _column(function: Callable[[bytes], bytes]):
    @F.arrow_udf("binary")
    def mapped(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else function(v) for v in values.to_pylist()], pa.binary())

    return mapped


def little_endian(value: Column) -> Column:
    """The low 32 bits of a number as four bytes, lowest first."""
    text = F.lpad(F.hex(value.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    return F.unhex(F.concat(*[F.substring(text, i, 2) for i in (7, 5, 3, 1)]))


def encode(codec: str, raw: Column, level: int = 5) -> Column:
    """raw as one member or frame. gzip is framed natively: header, deflate data, CRC-32, size."""
    if not 0 <= level <= 9:
        raise ValueError("a level is 0 to 9")
    if codec == "gzip":
        size = F.length(raw).cast("long")
        return F.concat(F.lit(GZIP_HEADER), encode("deflate", raw, level), little_endian(F.crc32(raw)), little_endian(size))
    if codec not in ENCODERS:
        raise ValueError(f"compression is not supported: {codec}")
    function = ENCODERS[codec]
    return _column(lambda v: function(v, level))(raw)


def decode(codec: str, data: Column, failing: bool = True) -> Column:
    """The bytes of a member or frame; damaged data are an error, or null where failing is false."""
    if codec not in DECODERS:
        raise ValueError(f"decompression is not supported: {codec}")
    function = DECODERS[codec]

    def tried(data: bytes) -> bytes | None:
        try:
            return function(data)
        except (ValueError, EOFError, OSError, zlib.error, lzma.LZMAError):
            return None

    return _column(function if failing else tried)(data)


@F.arrow_udf(T.ArrayType(T.LongType()))
def member_starts(values: pa.Array) -> pa.Array:
    """Where a gzip member with our own header may start."""
    out = []
    for v in values.to_pylist():
        found, at = [], (v or b"").find(GZIP_HEADER)
        while at >= 0:
            found.append(at)
            at = v.find(GZIP_HEADER, at + len(GZIP_HEADER))
        out.append(found)
    return pa.array(out, pa.list_(pa.int64()))
