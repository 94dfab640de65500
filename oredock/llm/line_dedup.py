"""Line deduplication by a sharded minimal perfect hash (operator 5).

1. Documents per distinct line: Python counts lines of its batches, Spark sums the counts.
2. The distinct line hashes (128 bits) are dealt into shards of about SHARD keys; each shard's minimal
   perfect hash, fingerprints and counts become one row of a table in the shared folder.
3. Documents are dealt into groups of about GROUP bytes. A group asks the shards for each of its distinct
   lines once. Index and requests are sorted by shard, so a task holds one shard's arrays at a time and
   streams requests past them; lines found often enough come back to the group that asked.
4. Groups drop the lines that came back.

Every line goes through the index; each is in it, so a probe's answer is exact. A frequent line is one
request of each group at most, so no shard is hot. Requests are rows of 20 bytes, as many as there are
distinct lines in each group: they grow with the input.

Defined cases: a null or empty text is one empty line; a line whose key is shorter than min_chars
stays; repeated rows count as documents of their own; null ids are kept; other columns ride along,
but for n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oredock.llm.common import LOWER, WHITE_BYTES, fold, materialize, read, text_of
from oredock.llm.line_index import LineIndex

MIN_DOCS, MIN_CHARS, SHARD, GROUP, HELD = 10, 1, 1 << 17, 2 << 20, 200_000
LINES = "high long, low long, docs long"
PROBE = "shard int, group int, high long, low long, data binary"
#: The group number of a shard's own row, which sorts before all that ask.
INDEX = -1


def line_hashes(text: bytes, min_chars: int) -> list[bytes | None]:
    """The hash of each line's key, None for keys that are too short."""
    keys = [x.strip(WHITE_BYTES) for x in text.translate(LOWER).split(b"\n")]
    return [xxhash.xxh3_128_digest(x) if x and (min_chars <= 1 or len(x.decode()) >= min_chars) else None for x in keys]


def _texts(batch: pa.RecordBatch | pa.Table) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _split(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])


def count_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """high and low (a line's hash) and docs, the number of documents that have it."""

    def packed(seen: dict[bytes, int]) -> pa.RecordBatch:
        high, low = _split(list(seen))
        return pa.RecordBatch.from_pydict({"high": high, "low": low, "docs": pa.array(list(seen.values()), pa.int64())})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            for text in _texts(batch):
                for h in set(line_hashes(text, min_chars)):
                    if h is not None:
                        seen[h] = seen.get(h, 0) + 1
            if len(seen) >= HELD:
                yield packed(seen)
                seen = {}
        yield packed(seen)

    return docs.select(text_of().alias("text")).mapInArrow(counted, LINES).groupBy("high", "low").agg(F.sum("docs").alias("docs"))


def build_index(counts: DataFrame, shards: int) -> DataFrame:
    """One row per shard, with its arrays in `data`."""

    def built(group: pa.Table) -> pa.Table:
        high, low, docs = (group.column(c).to_numpy() for c in ("high", "low", "docs"))
        data = LineIndex.build(high, low, docs).to_bytes()
        return pa.table({"shard": group.column("shard")[:1], "group": pa.array([INDEX], pa.int32()), "high": pa.array([0], pa.int64()), "low": pa.array([0], pa.int64()), "data": pa.array([data], pa.binary())})

    return counts.select(F.pmod("high", F.lit(shards)).cast("int").alias("shard"), "high", "low", "docs").groupBy("shard").applyInArrow(built, PROBE)


def find_frequent(dealt: DataFrame, index: DataFrame, shards: int, min_docs: int, min_chars: int) -> DataFrame:
    """group, high and low: the lines of each group that the index counts often enough. dealt: group and text, by group."""

    def asked(table: pa.Table) -> pa.Table:
        own = {h for text in _texts(table) for h in line_hashes(text, min_chars) if h is not None}
        high, low = _split(sorted(own))
        group = pa.array(np.full(len(high), table.column("group")[0].as_py(), np.int32))
        return pa.table({"shard": pa.array((high % shards).astype(np.int32)), "group": group, "high": high, "low": low, "data": pa.nulls(len(high), pa.binary())})

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, arrays = None, None
        for batch in batches:
            shard, group, high, low = (batch.column(c).to_numpy() for c in ("shard", "group", "high", "low"))
            cuts = [0, *(np.nonzero(np.diff(shard))[0] + 1).tolist(), len(shard)]
            for start, end in zip(cuts, cuts[1:]):
                if start < end and group[start] == INDEX:
                    at, arrays = shard[start], LineIndex.from_bytes(batch.column("data")[start].as_py())
                    start += 1
                if start == end:
                    continue
                if at != shard[start]:
                    raise ValueError("a shard of the line index is missing")
                own = slice(start, end)
                hit = arrays.lookup(high[own], low[own]) >= np.uint64(min_docs)
                yield pa.RecordBatch.from_pydict({"group": group[own][hit], "high": high[own][hit], "low": low[own][hit]})

    requests = dealt.groupBy("group").applyInArrow(asked, PROBE)
    return index.unionByName(requests).repartition("shard").sortWithinPartitions("shard", "group").mapInArrow(probed, "group int, high long, low long")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """The columns of docs, text without lines found in min_docs documents or more, and n_lines, n_dropped."""
    counts = materialize(count_lines(docs, min_chars))
    shards = max(1, -(-counts.count() // shard))
    index = materialize(build_index(counts, shards))
    size = docs.select(F.sum(F.octet_length(text_of()))).first()[0] or 0
    groups = max(1, -(-size // group))
    folded, unfold = fold(docs, "doc_id", "text")
    # rows without an id may all be alike: their number in the input tells them apart
    apart = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    dealt = folded.select(F.pmod(F.xxhash64("doc_id", "text", apart), F.lit(groups)).cast("int").alias("group"), "doc_id", text_of().alias("text"), "row").repartition("group")
    frequent = find_frequent(dealt, index, shards, min_docs, min_chars)  # all columns, so that one shuffle serves both

    def cleaned(rows: pa.Table, lines: pa.Table) -> pa.Table:
        pairs = np.stack([lines.column("high").to_numpy(), lines.column("low").to_numpy()], axis=1).astype("<i8")
        gone = {p.tobytes() for p in pairs}
        out, n_lines, n_dropped = [], [], []
        for text in _texts(rows):
            parts = text.split(b"\n")
            stay = [p for p, h in zip(parts, line_hashes(text, min_chars)) if h not in gone]
            out.append(b"\n".join(stay))
            n_lines.append(len(parts))
            n_dropped.append(len(parts) - len(stay))
        return pa.table({"doc_id": rows.column("doc_id"), "row": rows.column("row"), "text": pa.array(out, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())})

    schema = T.StructType([folded.schema["doc_id"], T.StructField("row", folded.schema["row"].dataType), T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    done = dealt.groupBy("group").cogroup(frequent.groupBy("group")).applyInArrow(cleaned, schema)
    return unfold(done, {"n_lines": F.col("n_lines"), "n_dropped": F.col("n_dropped")})


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT doc_id, i, line, key IN (SELECT key FROM f) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""


def clean(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The columns of docs with cleaned text; n_chars, if there is one, is the cleaned text's length."""
    folded, unfold = fold(docs, "doc_id", "text", "n_chars")
    done = dedup_lines(folded, min_docs, min_chars)
    return unfold(done.drop("n_lines", "n_dropped"), {"n_chars": F.length("text").cast("long")})
