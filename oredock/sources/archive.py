"""Archives as tables of entries: zip, tar and compressed tar.

Archives are read with Spark's binaryFile source, so any store will do, one archive a task; entries
come out as rows. Packing groups entries by archive: keep what one archive holds within a task's memory.
RAR has no public decoder in Python, and 7z none that is installed here: both raise an error.
"""

from __future__ import annotations

import bz2
import io
import lzma
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oredock.functions.codecs import GZIP_HEADER, deflate, ungzip, unzstd, zstd
from oredock.functions.formats import WRITABLE, clean_path, detect_format, is_safe_path

MEMBER = 2 << 20
ENTRY = "archive string, path string, size long, is_dir boolean, content binary"
OPENERS = {"tar": lambda b: b, "tar.gz": ungzip, "tar.zst": unzstd, "tar.xz": lzma.decompress, "tar.bz2": bz2.decompress}


def entries_of(container: str, data: bytes, content: bool) -> Iterator[tuple[str, int, bool, bytes | None]]:
    """(path, size, is_dir, content) of each entry, in the archive's order."""
    if container == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i in z.infolist():
                yield i.filename.rstrip("/"), i.file_size, i.is_dir(), z.read(i) if content and not i.is_dir() else None
    elif container in OPENERS:
        with tarfile.open(fileobj=io.BytesIO(OPENERS[container](data)), mode="r|") as t:
            for m in t:
                yield m.name, m.size, m.isdir(), t.extractfile(m).read() if content and m.isreg() else None
    else:
        raise ValueError(f"archives of this kind can't be read: {container}")


def list_entries(archives: DataFrame, content: bool = False) -> DataFrame:
    """One row per entry of archives(archive, container, data): archive, path, size, is_dir, content and is_safe."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, container, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows = list(entries_of(container, data, content))
                yield pa.RecordBatch.from_pydict({"archive": pa.array([name] * len(rows), pa.string()), "path": pa.array([r[0] for r in rows], pa.string()), "size": pa.array([r[1] for r in rows], pa.int64()), "is_dir": pa.array([r[2] for r in rows], pa.bool_()), "content": pa.array([r[3] for r in rows], pa.binary())})

    return archives.select("archive", "container", "data").mapInArrow(listed, ENTRY).withColumn("is_safe", is_safe_path("path"))


def read_archives(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """Entries of the archive files under path; what a file is follows from its name."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), detect_format("path").alias("container"), F.col("content").alias("data"))
    return list_entries(files, content)


def tar_bytes(paths: list[str], contents: list[bytes | None], links: list[str | None] | None = None) -> bytes:
    """A tar; an entry without contents is a link if it has a target, else a directory."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as t:
        for path, raw, link in zip(paths, contents, links or [None] * len(paths)):
            info = tarfile.TarInfo(path)
            if raw is None:
                info.type, info.linkname, info.mode = (tarfile.SYMTYPE, link, 0o777) if link else (tarfile.DIRTYPE, "", 0o755)
            info.size = len(raw or b"")
            t.addfile(info, io.BytesIO(raw or b""))
    return out.getvalue()


def pack_entries(container: str, paths: list[str], contents: list[bytes | None], level: int, member: int, links: list[str | None] | None = None) -> bytes:
    """One archive; compressed tar data is cut into members or frames that can be decoded one by one."""
    if container == "zip":
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=level) as z:
            for path, raw in zip(paths, contents):
                z.writestr(zipfile.ZipInfo(path if raw is not None else f"{path}/"), raw or b"", zipfile.ZIP_DEFLATED, level)
        return out.getvalue()
    data = tar_bytes(paths, contents, links)
    if container == "tar":
        return data
    parts = [data[i : i + member] for i in range(0, len(data), member)]
    if container == "tar.zst":
        return b"".join(zstd(p, level) for p in parts)
    return b"".join(GZIP_HEADER + deflate(p, level) + zlib.crc32(p).to_bytes(4, "little") + (len(p) & 0xFFFFFFFF).to_bytes(4, "little") for p in parts)


def pack(entries: DataFrame, container: str, level: int = 5, member: int = MEMBER) -> DataFrame:
    """One archive per value of archive in entries(archive, path, raw), entries in order of their paths: archive, container, data.

    With a column link, rows without raw are symbolic links where it names a target, else directories; zip has no
    links, so there they are left out. Paths lose empty, `.` and `..` parts; two entries that then share a path are an error.
    """
    if container not in WRITABLE:
        raise ValueError(f"archives of this kind can't be written: {container}")
    if not 0 <= level <= 9 or member < 1:
        raise ValueError("a level is 0 to 9, and a member has a byte at least")
    has_links = "link" in entries.columns

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("path")
        paths, raw, links = (table.column(c).to_pylist() for c in ("path", "raw", "link"))
        if len(set(paths)) < len(paths):
            raise ValueError("two entries of an archive have one path")
        data = pack_entries(container, paths, raw, level, member, links)
        return pa.table({"archive": table.column("archive")[:1], "container": [container], "data": pa.array([data], pa.binary())})

    raw = F.col("raw") if has_links else F.coalesce("raw", F.lit(b""))
    rows = entries.select("archive", clean_path("path").alias("path"), raw.alias("raw"), (F.col("link") if has_links else F.lit(None).cast("string")).alias("link"))
    if container == "zip":
        rows = rows.filter("link IS NULL")
    return rows.groupBy("archive").applyInArrow(packed, "archive string, container string, data binary")
