"""File trees that executors can see under one path (a mounted store): scanning, and writing files into them.

A tree is scanned level by level: each level's directories are a table, and tasks list them, so a wide
tree is listed by many tasks. Children come sorted by name, directories are entries, symbolic links are
recorded and not followed, and other kinds of nodes are left out.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oredock.store import kept

ENTRY = "path string, is_dir boolean, size long, link string"


def local(path: str) -> str:
    return urlparse(path).path if path.startswith("file:") else path


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path (from the root's own name on), is_dir, size and link (its target, or null) of every entry below and at root."""
    base = local(root).rstrip("/")
    above = os.path.dirname(base)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {"path": [], "is_dir": [], "size": [], "link": []}
            for path in batch.column("path").to_pylist():
                with os.scandir(os.path.join(above, path)) as children:
                    for x in sorted(children, key=lambda c: c.name):
                        is_dir = x.is_dir(follow_symlinks=False)
                        if not (is_dir or x.is_symlink() or x.is_file(follow_symlinks=False)):
                            continue
                        rows["path"].append(f"{path}/{x.name}")
                        rows["is_dir"].append(is_dir)
                        rows["size"].append(0 if is_dir or x.is_symlink() else x.stat().st_size)
                        rows["link"].append(os.readlink(x.path) if x.is_symlink() else None)
            yield pa.RecordBatch.from_pydict({"path": pa.array(rows["path"], pa.string()), "is_dir": pa.array(rows["is_dir"], pa.bool_()), "size": pa.array(rows["size"], pa.int64()), "link": pa.array(rows["link"], pa.string())})

    level = spark.createDataFrame([(os.path.basename(base), True, 0, None)], ENTRY)
    found = level
    while True:
        level = kept(level.filter("is_dir").select("path").repartition("path").mapInArrow(listed, ENTRY))
        if level.isEmpty():
            return found
        found = found.unionByName(level)


def with_content(entries: DataFrame, root: str) -> DataFrame:
    """Entries of scan with raw, the bytes of files (null for directories and links)."""
    above = os.path.dirname(local(root).rstrip("/"))
    names = entries.columns

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                raw = None
                if not row.column("is_dir")[0].as_py() and row.column("link")[0].as_py() is None:
                    with open(os.path.join(above, row.column("path")[0].as_py()), "rb") as f:
                        raw = f.read()
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([raw], pa.binary())], [*names, "raw"])

    return entries.mapInArrow(opened, ENTRY + ", raw binary")


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write each of files(path, raw) under root from the task that holds it; path and size of what was written.

    A file is written beside its place and then moved there, so a task that runs twice does no harm.
    """
    base = local(root).rstrip("/")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("raw").to_pylist()):
                at = os.path.join(base, path)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                part = f"{at}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(raw)
                os.replace(part, at)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_pydict({"path": batch.column("path"), "size": pa.array(sizes, pa.int64())})

    if not files.filter(F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")).isEmpty():
        raise ValueError("paths must lie below the folder")
    return kept(files.select("path", "raw").mapInArrow(written, "path string, size long"))
