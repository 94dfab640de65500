"""Container formats, codecs, levels, entry paths and sizes as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes of each container (compound ones first), its payload's codec, whether it is written.
SUFFIXES = {
    "tar.gz": [".tar.gz", ".tgz"],
    "tar.zst": [".tar.zst", ".tzst"],
    "tar.xz": [".tar.xz", ".txz"],
    "tar.bz2": [".tar.bz2", ".tbz2", ".tbz"],
    "tar": [".tar"],
    "zip": [".zip"],
    "rar": [".rar"],
    "7z": [".7z"],
}
PAYLOAD = {"zip": "deflate", "tar.gz": "gzip", "tar.zst": "zstd", "tar.xz": "lzma", "tar.bz2": "bzip2", "rar": "rar", "7z": "lzma"}
WRITABLE = ["zip", "tar", "tar.gz", "tar.zst"]
# Names of codecs for people.
NAMES = {"deflate": "deflate", "gzip": "gzip", "zstd": "zstd", "lzma": "lzma", "bzip2": "bzip2", "rar": "rar"}
# Fixed values: (backend, priority, codec, compresses, decompresses).
CAPABILITIES = [
    ("gpu", 0, "gzip", True, False),
    ("cpu", 1, "deflate", True, True),
    ("cpu", 1, "gzip", True, True),
    ("cpu", 1, "zstd", True, True),
    ("cpu", 1, "lzma", False, True),
    ("cpu", 1, "bzip2", False, True),
    ("cpu", 1, "rar", False, True),
]


def detect_format(name: Column | str) -> Column:
    """The container of a file name, null if no suffix is known; upper and lower case are alike."""
    low = F.lower(name)
    cases = [(low.endswith(s), k) for k, found in SUFFIXES.items() for s in found]
    return reduce(lambda c, x: c.when(*x), cases[1:], F.when(*cases[0]))


def payload_codec(container: Column | str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in PAYLOAD.items() for x in pair]), F.col(container) if isinstance(container, str) else container)


def codec_name(codec: Column | str) -> Column:
    """The codec's name for people; null for an unknown one."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair]), F.col(codec) if isinstance(codec, str) else codec)


def is_writable(container: Column | str) -> Column:
    return F.col(container).isin(WRITABLE) if isinstance(container, str) else container.isin(WRITABLE)


def clamp_level(level: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(level, F.lit(low)), F.lit(high))


def zstd_level(level: Column) -> Column:
    """Levels 0 to 9 to zstd's own."""
    return F.when(level <= 0, 1).when(level <= 4, 2).when(level == 5, 3).when(level == 6, 6).when(level == 7, 12).when(level == 8, 17).otherwise(19)


def is_safe_path(path: Column | str) -> Column:
    """Neither absolute nor with a step upwards."""
    parts = F.split(path, "/")
    return ~(F.startswith(F.col(path) if isinstance(path, str) else path, F.lit("/")) | F.array_contains(parts, ".."))


def clean_path(path: Column | str) -> Column:
    """The path without empty, `.` and `..` parts."""
    return F.array_join(F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".", "..")), "/")


def listing_line(path: str = "path", size: str = "size", is_dir: str = "is_dir") -> Column:
    return F.format_string("%s %12d %s", F.when(F.col(is_dir), "d").otherwise("-"), F.col(size), F.col(path))


def parse_size(text: Column | str) -> Column:
    """Bytes of `4K`, `2M`, `1G`; bare digits are MiB."""
    number = F.regexp_extract(text, r"^([0-9]+)", 1).cast("long")
    unit = F.upper(F.regexp_extract(text, r"([KMGkmg]?)$", 1))
    return number * F.when(unit == "K", 1 << 10).when(unit == "G", 1 << 30).otherwise(1 << 20)


def print_size(size: Column) -> Column:
    """The largest of K, M and G that divides the size, else plain bytes."""
    cases = [(30, "G"), (20, "M"), (10, "K")]
    return reduce(lambda c, x: c.when((size > 0) & (size % (1 << x[0]) == 0), F.concat((size / (1 << x[0])).cast("long").cast("string"), F.lit(x[1]))), cases, F.when(F.lit(False), "")).otherwise(size.cast("string"))


def pick_backend(requests: DataFrame, spark: SparkSession) -> DataFrame:
    """requests(codec, compress) with the first backend by priority that is able; null if none is."""
    able = spark.createDataFrame(CAPABILITIES, "backend string, priority int, codec string, compresses boolean, decompresses boolean")
    long = able.select("backend", "priority", "codec", F.explode(F.array(F.struct(F.lit(True).alias("compress"), F.col("compresses").alias("able")), F.struct(F.lit(False).alias("compress"), F.col("decompresses").alias("able")))).alias("x")).select("backend", "priority", "codec", "x.*")
    first = long.filter("able").groupBy("codec", "compress").agg(F.min_by("backend", "priority").alias("backend"))
    return requests.join(F.broadcast(first), ["codec", "compress"], "left")
