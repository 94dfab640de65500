"""All registered queries of the archive and codec operators, and the SQL of those that it can express.

"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oredock.functions import codecs, formats
from oredock.operators import chunks, entropy, lz77
from oredock.sources import archive, tree
from oredock.store import csv, folder, json, kept, place
from oredock.streaming import chunker

QUERIES: dict = {}
SQL: dict = {}
CHUNK, MEMBERS = 4096, 1024


def query(sql: str | None = None):
    def added(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return added


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream_id"), chunks.bytes_of().alias("raw"))


@query()
def entry_ratio_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream_id"), chunks.bytes_of().alias("raw"))
    parts = chunks.split(docs, CHUNK).select("stream_id", F.length("raw").alias("n"), F.length(codecs.encode("gzip", F.col("raw"))).alias("gz"))
    sized = parts.groupBy("stream_id").agg(F.count("*").alias("chunks"), F.sum("n").alias("raw_bytes"), F.sum("gz").alias("gz_bytes"))
    by_doc = read(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("stream_id")).join(sized, "stream_id", "left").fillna(0, ["chunks", "raw_bytes", "gz_bytes"])
    totals = by_doc.groupBy("source").agg(F.count("*").alias("docs"), *[F.sum(c).alias(c) for c in ("chunks", "raw_bytes", "gz_bytes")])
    return totals.withColumn("ratio", F.round(F.col("gz_bytes") / F.col("raw_bytes"), 4))


_SUFFIX = [".zip", ".ZIP", ".tar.gz", ".tgz", ".tar.zst", ".tzst", ".tar.xz", ".tar.bz2", ".tbz", ".tar", ".rar", ".7z", ".unknown", ""]
_NAME_SQL = f"source || '_' || doc_id || list_extract([{', '.join(repr(s) for s in _SUFFIX)}], (doc_id % 14)::INT + 1)"
_FORMAT_SQL = "CASE " + " ".join(f"WHEN lower(name) LIKE '%{s}' THEN '{k}'" for k, v in formats.SUFFIXES.items() for s in v) + " END"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    suffix = F.element_at(F.array(*map(F.lit, _SUFFIX)), (F.col("doc_id") % 14 + 1).cast("int"))
    return docs.select("doc_id", F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), suffix).alias("name"))


@query(f"""
WITH n AS (SELECT doc_id, {_NAME_SQL} AS name FROM documents), f AS (SELECT *, {_FORMAT_SQL} AS container FROM n)
SELECT doc_id, name, container, CASE container {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in formats.PAYLOAD.items())} END AS codec, container IN ({", ".join(repr(x) for x in formats.WRITABLE)}) AS writable FROM f
""")
def s1_format_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _named(spark, sf_dir).withColumn("container", formats.detect_format("name"))
    return rows.withColumn("codec", formats.payload_codec("container")).withColumn("writable", formats.is_writable("container"))


@query("""
WITH l AS (SELECT doc_id, (n_chars % 13 - 2)::INT AS level FROM documents)
SELECT doc_id, level, least(greatest(level, 0), 9) AS clamped, CASE WHEN level <= 0 THEN 1 WHEN level <= 4 THEN 2 WHEN level = 5 THEN 3 WHEN level = 6 THEN 6 WHEN level = 7 THEN 12 WHEN level = 8 THEN 17 ELSE 19 END AS zstd_level FROM l
""")
def p4_level_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 13 - 2).cast("int").alias("level"))
    return rows.withColumn("clamped", formats.clamp_level(F.col("level"), 0, 9)).withColumn("zstd_level", formats.zstd_level(F.col("level")))


@query("""
WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_replace(url, '^https?://', '') WHEN 1 THEN regexp_replace(url, '^https?:/', '') WHEN 2 THEN '../' || page_id ELSE './a/../' || page_id END AS path FROM pages)
SELECT page_id, path, NOT (starts_with(path, '/') OR list_contains(string_split(path, '/'), '..')) AS is_safe, array_to_string(list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.', '..')), '/') AS cleaned FROM p
""")
def f3_safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 4 == 0, F.regexp_replace("url", "^https?://", "")).when(F.col("page_id") % 4 == 1, F.regexp_replace("url", "^https?:/", "")).when(F.col("page_id") % 4 == 2, F.concat(F.lit("../"), own)).otherwise(F.concat(F.lit("./a/../"), own))
    rows = read(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return rows.withColumn("is_safe", formats.is_safe_path("path")).withColumn("cleaned", formats.clean_path("path"))


_CODECS = ["deflate", "gzip", "zstd", "lzma", "bzip2", "rar"]


@query(f"""
WITH r AS (SELECT doc_id, list_extract([{", ".join(map(repr, _CODECS))}], (doc_id % 6)::INT + 1) AS codec, n_chars % 2 = 0 AS compress FROM documents),
b(backend, priority, codec, c, d) AS (VALUES {", ".join(str(x).replace("True", "true").replace("False", "false") for x in formats.CAPABILITIES)}),
a AS (SELECT codec, true AS compress, backend, priority FROM b WHERE c UNION ALL SELECT codec, false, backend, priority FROM b WHERE d),
f AS (SELECT codec, compress, backend FROM a QUALIFY row_number() OVER (PARTITION BY codec, compress ORDER BY priority) = 1)
SELECT codec, compress, coalesce(backend, 'none') AS backend, count(*) AS requests FROM r LEFT JOIN f USING (codec, compress) GROUP BY ALL
""")
def j6_backend_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = read(spark, sf_dir, "documents").select(F.element_at(F.array(*map(F.lit, _CODECS)), (F.col("doc_id") % 6 + 1).cast("int")).alias("codec"), (F.col("n_chars") % 2 == 0).alias("compress"))
    return formats.pick_backend(wanted, spark).groupBy("codec", "compress", F.coalesce("backend", F.lit("none")).alias("backend")).agg(F.count("*").alias("requests"))


_PLAN_SQL = f"""
WITH s AS (SELECT doc_id AS stream_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
c AS (SELECT stream_id, n, unnest(range(0, (n + {CHUNK - 1}) // {CHUNK})) AS chunk_index FROM s)
SELECT stream_id, chunk_index::INT AS chunk_index, chunk_index * {CHUNK} AS start, least({CHUNK}, n - chunk_index * {CHUNK}) AS length FROM c
"""


@query(_PLAN_SQL)
def c1_chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.plan(streams(spark, sf_dir).select("stream_id", F.length("raw").cast("long").alias("n_bytes")), CHUNK)


@query(f"""
WITH s AS (SELECT doc_id AS stream_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT stream_id, h, unnest(range(0, (length(h) + {2 * CHUNK - 1}) // {2 * CHUNK})) AS chunk_index FROM s)
SELECT stream_id, chunk_index::INT AS chunk_index, md5(substr(h, chunk_index * {2 * CHUNK} + 1, {2 * CHUNK})) AS hex_md5 FROM c
""")
def c1_chunk_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.split(streams(spark, sf_dir), CHUNK).select("stream_id", "chunk_index", F.md5(F.hex("raw").cast("binary")).alias("hex_md5"))


def _round_trip(name: str, codec: str, table: str, key: str, text: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = read(spark, sf_dir, table).select(F.expr(key).alias("stream_id"), chunks.bytes_of(text).alias("raw"))
        return chunks.round_trip(rows, codec, CHUNK).select("stream_id", F.md5("raw").alias("md5"), F.length("raw").cast("long").alias("n_bytes"))

    run.__name__ = name
    query(f"SELECT {key} AS stream_id, md5(coalesce({text}, '')) AS md5, octet_length(encode(coalesce({text}, ''))) AS n_bytes FROM {table}")(run)


_round_trip("c3_gzip_roundtrip", "gzip", "documents", "doc_id", "text")
_round_trip("c4_zstd_roundtrip", "zstd", "documents", "doc_id", "text")
_round_trip("c5_deflate_roundtrip", "deflate", "pages", "page_id", "html")
_round_trip("c7_bzip2_roundtrip", "bzip2", "pages", "page_id", "html")
_round_trip("c7_xz_roundtrip", "lzma", "conversations", "conv_id * 1000 + turn", "text")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = chunks.split(streams(spark, sf_dir), MEMBERS).select("stream_id", "chunk_index", codecs.encode("gzip", F.col("raw")).alias("packed"))
    return chunks.assemble(parts, "packed", "packed")


def decoded_members(streams: DataFrame) -> DataFrame:
    """stream_id, members and raw of streams(stream_id, packed): gzip members are found by their header and decoded as ranges of their own.

    A stream of which the first member isn't found at its start, or a range isn't a whole member (a header
    within compressed data, a member of another writer), is decoded from its start to its end instead.
    """
    whole = kept(streams.select("stream_id", "packed", codecs.member_starts("packed").alias("starts")))
    ends = F.concat(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), F.array(F.length("packed").cast("long")))
    first = F.get("starts", F.lit(0)) == 0
    ranges = whole.filter(first).select("stream_id", "packed", F.posexplode(F.arrays_zip(F.col("starts").alias("a"), ends.alias("b"))).alias("chunk_index", "r"))
    opened = kept(ranges.select("stream_id", "chunk_index", codecs.decode("gzip", F.expr("substring(packed, int(r.a + 1), int(r.b - r.a))"), failing=False).alias("raw")))
    failed = opened.filter("raw IS NULL").select("stream_id").distinct()
    good = chunks.assemble(opened.join(failed, "stream_id", "left_anti"), "raw", "raw")
    rest = whole.join(good.select("stream_id"), "stream_id", "left_anti")
    serial = rest.select("stream_id", F.when(F.length("packed") > 0, codecs.decode("gzip", F.col("packed"))).otherwise(F.lit(b"")).alias("raw"))
    return whole.select("stream_id", F.size("starts").cast("long").alias("members")).join(good.unionByName(serial), "stream_id")


@query(f"SELECT doc_id AS stream_id, (octet_length(encode(coalesce(text, ''))) + {MEMBERS - 1}) // {MEMBERS} AS members, md5(coalesce(text, '')) AS md5 FROM documents")
def c6_member_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = streams(spark, sf_dir).select("stream_id").join(_members(spark, sf_dir), "stream_id", "left").select("stream_id", F.coalesce("packed", F.lit(b"")).alias("packed"))
    return decoded_members(whole).select("stream_id", "members", F.md5("raw").alias("md5"))


@query(f"""
WITH s AS (SELECT doc_id AS stream_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
c AS (SELECT stream_id, n, unnest(range(0, (n + {CHUNK - 1}) // {CHUNK})) AS chunk_index FROM s)
SELECT stream_id, chunk_index::INT AS chunk_index, '1f8b08000000000000ff' AS header, true AS crc_ok, least({CHUNK}, n - chunk_index * {CHUNK}) AS stored_size FROM c
""")
def p17_gzip_trailer(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = chunks.split(streams(spark, sf_dir), CHUNK).withColumn("packed", codecs.encode("gzip", F.col("raw")))
    number = lambda start: F.conv(F.concat(*[F.hex(F.substring("packed", start + i, 1)) for i in (3, 2, 1, 0)]), 16, 10).cast("long")
    return parts.select("stream_id", "chunk_index", F.lower(F.hex(F.substring("packed", 1, 10))).alias("header"), (number(-8) == F.crc32("raw")).alias("crc_ok"), number(-4).alias("stored_size"))


def _archives(spark: SparkSession, sf_dir: str, container: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("part"), F.floor(F.col("doc_id") / 500).cast("string")).alias("archive"), F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), chunks.bytes_of().alias("raw"))
    return archive.pack(docs, container)


def _archive_query(name: str, container: str, content: bool) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = archive.list_entries(kept(_archives(spark, sf_dir, container)), content)
        extra = [F.md5("content").alias("md5")] if content else [formats.listing_line().alias("line")]
        return rows.select("archive", "path", "size", "is_dir", "is_safe", *extra)

    run.__name__ = name
    extra = "md5(coalesce(text, '')) AS md5" if content else "printf('- %12d %s', octet_length(encode(coalesce(text, ''))), coalesce(source, 'none') || '/' || doc_id || '.txt') AS line"
    query(f"SELECT 'part' || (doc_id // 500) AS archive, coalesce(source, 'none') || '/' || doc_id || '.txt' AS path, octet_length(encode(coalesce(text, ''))) AS size, false AS is_dir, true AS is_safe, {extra} FROM documents")(run)


_archive_query("s3_zip_list", "zip", False)
_archive_query("s4_tar_list", "tar", False)
_archive_query("s5_tar_gz_list", "tar.gz", False)
_archive_query("s15_zip_content", "zip", True)
_archive_query("s16_tar_zst_content", "tar.zst", True)

_HISTOGRAM_SQL = "WITH b AS (SELECT source, unnest(regexp_extract_all(hex(encode(text)), '..')) AS pair FROM documents), h AS (SELECT source, ('0x' || pair)::INT AS byte, count(*) AS freq FROM b GROUP BY ALL)"


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.byte_histogram(read(spark, sf_dir, "documents").select("source", chunks.bytes_of().alias("raw")), "source")


@query(f"{_HISTOGRAM_SQL} SELECT * FROM h")
def a1_byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(spark, sf_dir)


_LENGTHS_SQL = f"{_HISTOGRAM_SQL}, t AS (SELECT *, sum(freq) OVER (PARTITION BY source) AS total FROM h), l AS (SELECT source, byte, freq, list_min(list_filter(range(1, 41), lambda n: freq::HUGEINT * (1::HUGEINT << n) >= total))::INT AS bits FROM t)"


@query(f"{_LENGTHS_SQL} SELECT source, byte, freq, bits, (coalesce(sum(1::BIGINT << (40 - bits)) OVER (PARTITION BY source ORDER BY bits, byte ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // (1::BIGINT << (40 - bits)))::BIGINT AS code FROM l")
def w3_canonical_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.canonical_codes(entropy.shannon_lengths(_histogram(spark, sf_dir), "source"), "source", "byte")


@query(f"{_LENGTHS_SQL} SELECT source, bits, count(*) AS codes FROM l GROUP BY ALL")
def a8_codes_per_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.shannon_lengths(_histogram(spark, sf_dir), "source").groupBy("source", "bits").agg(F.count("*").alias("codes"))


@query(f"{_HISTOGRAM_SQL} SELECT source, count(*) AS symbols, CASE WHEN count(*) > 1 THEN 1.0 ELSE 0.5 END AS kraft, true AS near_entropy FROM h GROUP BY source")
def a9_huffman_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optimal lengths fill the code space exactly, and are within one bit of the entropy."""
    dense = _histogram(spark, sf_dir).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("byte", "freq"))).alias("m"), F.sum("freq").alias("total"))
    rows = dense.select("source", "total", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("freq"))
    coded = rows.withColumn("bits", entropy.huffman_lengths("freq"))
    symbols = coded.select("source", "total", F.explode(F.arrays_zip("freq", "bits")).alias("x")).filter("x.freq > 0")
    share = F.col("x.freq") / F.col("total")
    return symbols.groupBy("source").agg(F.count("*").alias("symbols"), F.sum(F.pow(F.lit(2.0), -F.col("x.bits"))).alias("kraft"), F.sum(share * F.col("x.bits")).alias("mean"), F.sum(-share * F.log2(share)).alias("h")).select("source", "symbols", "kraft", ((F.col("mean") >= F.col("h") - 1e-9) & (F.col("mean") < F.col("h") + 1)).alias("near_entropy"))


_DENSE_SQL = f"{_LENGTHS_SQL}, d AS (SELECT s.source, r.byte, coalesce(l.bits, 0) AS bits FROM (SELECT DISTINCT source FROM h) s CROSS JOIN (SELECT unnest(range(0, 256)) AS byte) r LEFT JOIN l ON l.source = s.source AND l.byte = r.byte)"


@query(f"""{_DENSE_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY byte) - row_number() OVER (PARTITION BY source, bits ORDER BY byte) AS island FROM d)
SELECT source, min(byte)::INT AS start, bits::INT AS bits, count(*)::INT AS covered FROM i GROUP BY source, bits, island""")
def w4_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal code lengths, added up again from the repeat symbols that they are cut into."""
    lengths = entropy.shannon_lengths(_histogram(spark, sf_dir), "source")
    dense = lengths.select("source").distinct().withColumn("byte", F.explode(F.sequence(F.lit(0), F.lit(255)))).join(lengths.select("source", "byte", "bits"), ["source", "byte"], "left").fillna(0, ["bits"])
    runs = entropy.run_lengths(dense, "source", "byte", "bits")
    value = F.when(F.col("symbol").isin(17, 18) & (F.col("repeat") > 2), 0).when((F.col("symbol") == 16) & (F.col("repeat") > 2), None).otherwise(F.col("symbol"))
    return runs.withColumn("v", value).groupBy("source", "start").agg(F.max("v").cast("int").alias("bits"), F.sum("repeat").cast("int").alias("covered"))


def _symbol_sql(base: list[int], extra: list[int], first: int, end: int, value: str) -> str:
    high = [*(b - 1 for b in base[1:]), end - 1]
    table = ", ".join(f"({lo}, {hi}, {first + i}, {x})" for i, (lo, hi, x) in enumerate(zip(base, high, extra)))
    return f"WITH v AS (SELECT doc_id, ({value})::INT AS value FROM documents), t(low, high, symbol, extra) AS (VALUES {table}) SELECT doc_id, value, symbol, extra, value - low AS extra_value FROM v JOIN t ON value BETWEEN low AND high"


@query(_symbol_sql(entropy.LENGTH_BASE, entropy.LENGTH_EXTRA, 257, 259, "3 + n_chars % 256"))
def p10_length_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.with_symbol(read(spark, sf_dir, "documents").select("doc_id", (3 + F.col("n_chars") % 256).cast("int").alias("value")), "value", "length")


@query(_symbol_sql(entropy.DISTANCE_BASE, entropy.DISTANCE_EXTRA, 0, 32769, "1 + n_chars * 37 % 32768"))
def p11_distance_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.with_symbol(read(spark, sf_dir, "documents").select("doc_id", (1 + F.col("n_chars") * 37 % 32768).cast("int").alias("value")), "value", "distance")


@query("""
WITH s AS (SELECT doc_id, (n_chars % 288)::INT AS symbol FROM documents),
c AS (SELECT *, CASE WHEN symbol < 144 THEN 48 + symbol WHEN symbol < 256 THEN 256 + symbol WHEN symbol < 280 THEN symbol - 256 ELSE symbol - 88 END AS code, CASE WHEN symbol < 144 THEN 8 WHEN symbol < 256 THEN 9 WHEN symbol < 280 THEN 7 ELSE 8 END AS bits FROM s)
SELECT doc_id, symbol, code, bits, list_sum(list_transform(range(0, bits), lambda i: ((code >> i::INT) & 1) << (bits - 1 - i)::INT))::BIGINT AS reversed FROM c
""")
def p14_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    code, bits = entropy.fixed_code(F.col("symbol"))
    rows = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 288).cast("int").alias("symbol")).withColumn("code", code).withColumn("bits", bits)
    return rows.withColumn("reversed", entropy.reverse_bits(F.col("code"), F.col("bits")))


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.split(streams(spark, sf_dir), CHUNK).select(F.concat_ws(":", "stream_id", "chunk_index").alias("chunk_id"), "raw")


@query(f"""
WITH s AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, unnest(range(0, (length(h) + {2 * CHUNK - 1}) // {2 * CHUNK})) AS k, h FROM s),
x AS (SELECT doc_id || ':' || k AS chunk_id, list_transform(regexp_extract_all(substr(h, k * {2 * CHUNK} + 1, {2 * CHUNK}), '..'), lambda p: ('0x' || p)::BIGINT) AS b FROM c),
p AS (SELECT chunk_id, b, unnest(range(0, len(b) - 2)) AS p FROM x),
g AS (SELECT chunk_id, p, (((b[p + 1] * 65536 + b[p + 2] * 256 + b[p + 3]) * 2654435761) & 4294967295) >> 16 AS hash FROM p)
SELECT chunk_id, hash, (p // 1024)::INT AS segment, min(p)::INT AS oldest, max(p)::INT AS newest, count(*) AS positions FROM g GROUP BY ALL
""")
def a4_segment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz77.segment_table(_chunked(spark, sf_dir), 1024)


_CHUNK_SQL = f"""
WITH s AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, unnest(range(0, (length(h) + {2 * CHUNK - 1}) // {2 * CHUNK})) AS k, h FROM s)
SELECT doc_id || ':' || k AS chunk_id, md5(substr(h, k * {2 * CHUNK} + 1, {2 * CHUNK})) AS hex_md5 FROM c
"""


@query(_CHUNK_SQL)
def w8_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-ahead token selection, replayed."""
    rows = _chunked(spark, sf_dir).select("chunk_id", lz77.reconstructed("raw").alias("raw"))
    return rows.select("chunk_id", F.md5(F.hex("raw").cast("binary")).alias("hex_md5"))


@query(_CHUNK_SQL)
def c10_deflate_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, symbols, code words, running sums for offsets and ORs by word make blocks that zlib inflates."""
    blocks = _chunked(spark, sf_dir).select("chunk_id", lz77.deflated("raw").alias("block"))
    return blocks.select("chunk_id", F.md5(F.hex(codecs.decode("deflate", F.col("block"))).cast("binary")).alias("hex_md5"))


@query("SELECT count(*) AS chunks, true AS complete FROM (SELECT unnest(range(0, (octet_length(encode(coalesce(text, ''))) + 4095) // 4096)) FROM documents)")
def a1_symbol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of a chunk is one literal or length symbol, and the end of the block one more."""
    chunk = _chunked(spark, sf_dir).select(lz77.symbols_of("raw").alias("c")).select("c.tokens", "c.copies", "c.symbols")
    used = lambda alphabet: F.aggregate(F.filter("symbols", lambda x: x["alphabet"] == alphabet), F.lit(0).cast("long"), lambda n, x: n + x["freq"])
    right = (used("literal") == F.col("tokens") + 1) & (used("distance") == F.col("copies"))
    return chunk.agg(F.count("*").alias("chunks"), F.coalesce(F.every(right), F.lit(True)).alias("complete"))


@query("SELECT source, floor(median(n_chars))::BIGINT AS median FROM documents GROUP BY source")
def a11_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.floor(F.percentile("n_chars", 0.5)).alias("median"))


@query("""
WITH g AS (SELECT tool, CASE WHEN tool = 'gzip' THEN 0 ELSE size END AS chunk_size FROM (VALUES ('own'), ('gzip')) t(tool) CROSS JOIN (VALUES (1024), (4096), (16384)) c(size) GROUP BY ALL)
SELECT tool, chunk_size, source AS workload, sum(CASE WHEN chunk_size = 0 THEN 1 ELSE (n + chunk_size - 1) // greatest(chunk_size, 1) END)::BIGINT AS members, sum(n)::BIGINT AS in_bytes
FROM g CROSS JOIN (SELECT source, octet_length(encode(coalesce(text, ''))) AS n FROM documents) GROUP BY ALL
""")
def j7_bench_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of tools and chunk sizes, where a tool without that knob has one row, over the workloads."""
    sizes = F.explode(F.array(F.lit(1024), F.lit(4096), F.lit(16384)))
    grid = spark.range(2).select(F.when(F.col("id") == 0, "own").otherwise("gzip").alias("tool"), sizes.alias("size"))
    grid = grid.select("tool", F.when(F.col("tool") == "gzip", 0).otherwise(F.col("size")).alias("chunk_size")).distinct()
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("workload"), F.length(chunks.bytes_of()).cast("long").alias("n"))
    rows = docs.crossJoin(F.broadcast(grid))
    members = F.when(F.col("chunk_size") == 0, 1).otherwise(F.ceil(F.col("n") / F.greatest("chunk_size", F.lit(1))))
    return rows.groupBy("tool", "chunk_size", "workload").agg(F.sum(members.cast("long")).alias("members"), F.sum("n").alias("in_bytes"))


@query("SELECT * FROM (PIVOT (SELECT source, coalesce(lang, 'none') AS lang FROM documents) ON lang USING count(*) GROUP BY source)")
def k7_pivot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one source, a column for each language that there is."""
    return read(spark, sf_dir, "documents").withColumn("lang", F.coalesce("lang", F.lit("none"))).groupBy("source").pivot("lang").agg(F.count(F.lit(1))).fillna(0)


@query("""
WITH s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN n_chars || 'K' WHEN 1 THEN n_chars || 'm' WHEN 2 THEN n_chars % 100 || 'G' ELSE n_chars::VARCHAR END AS text FROM documents),
b AS (SELECT *, regexp_extract(text, '^[0-9]+')::BIGINT * CASE upper(regexp_extract(text, '[KMGkmg]?$')) WHEN 'K' THEN 1024 WHEN 'G' THEN 1073741824 ELSE 1048576 END AS size FROM s)
SELECT doc_id, text, size, CASE WHEN size > 0 AND size % 1073741824 = 0 THEN size // 1073741824 || 'G' WHEN size > 0 AND size % 1048576 = 0 THEN size // 1048576 || 'M' WHEN size > 0 AND size % 1024 = 0 THEN size // 1024 || 'K' ELSE size::VARCHAR END AS printed FROM b
""")
def p21_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars").cast("string")
    kind = F.col("doc_id") % 4
    text = F.when(kind == 0, F.concat(n, F.lit("K"))).when(kind == 1, F.concat(n, F.lit("m"))).when(kind == 2, F.concat((F.col("n_chars") % 100).cast("string"), F.lit("G"))).otherwise(n)
    rows = read(spark, sf_dir, "documents").select("doc_id", text.alias("text")).withColumn("size", formats.parse_size("text"))
    return rows.withColumn("printed", formats.print_size(F.col("size")))


@query("SELECT d.doc_id, d.n_chars FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def f8_restrict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id", "left_semi")


@query("WITH o AS (SELECT source, doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents) SELECT source, doc_id, n AS n_bytes, coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM o")
def u1_concatenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document starts in the ordered concatenation of its source."""
    rows = read(spark, sf_dir, "documents").select("source", "doc_id", F.length(chunks.bytes_of()).cast("long").alias("n_bytes"))
    return chunks.starts(rows, "source", "doc_id", "n_bytes")


@query(_PLAN_SQL)
def t1_stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read(spark, sf_dir, "documents").schema
    return chunker.chunk_files(spark, f"{sf_dir}/documents.parquet*", schema, CHUNK, folder(spark))


@query(f"""
WITH s AS (SELECT doc_id AS stream_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT stream_id, h, unnest(range(0, (length(h) + {2 * CHUNK - 1}) // {2 * CHUNK})) AS chunk_index FROM s)
SELECT stream_id, chunk_index::INT AS chunk_index, true AS framed, md5(substr(h, chunk_index * {2 * CHUNK} + 1, {2 * CHUNK})) AS hex_md5 FROM c
""")
def t1_stream_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of files that arrive, encoded by the stream as gzip members; decoded here."""
    schema = read(spark, sf_dir, "documents").schema
    members = chunker.encode_files(spark, f"{sf_dir}/documents.parquet*", schema, CHUNK, folder(spark))
    return members.select("stream_id", "chunk_index", F.startswith("packed", F.lit(codecs.GZIP_HEADER)).alias("framed"), F.md5(F.hex(codecs.decode("gzip", F.col("packed"))).cast("binary")).alias("hex_md5"))


@query(f"WITH r AS (SELECT doc_id, list_extract([{', '.join(map(repr, [*_CODECS, 'other']))}], (doc_id % 7)::INT + 1) AS codec FROM documents) SELECT doc_id, codec, CASE WHEN codec IN ({', '.join(map(repr, formats.NAMES))}) THEN codec END AS name FROM r")
def p2_codec_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = F.element_at(F.array(*map(F.lit, [*_CODECS, "other"])), (F.col("doc_id") % 7 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", codec.alias("codec")).withColumn("name", formats.codec_name("codec"))


@query("""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 3 + n_chars % 256 END AS length, CASE WHEN doc_id % 3 = 0 THEN n_chars % 256 ELSE 1 + n_chars * 37 % 32768 END AS distance FROM documents)
SELECT doc_id, length * 65536 + distance AS packed, length::INT AS length, distance::INT AS distance, length = 0 AS is_literal FROM t
""")
def p8_pack_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens packed into numbers, and unpacked again."""
    literal, n = F.col("doc_id") % 3 == 0, F.col("n_chars")
    packed = entropy.pack_token(F.when(literal, 0).otherwise(3 + n % 256), F.when(literal, n % 256).otherwise(1 + n * 37 % 32768))
    length, distance, is_literal = entropy.unpack_token(F.col("packed"))
    return read(spark, sf_dir, "documents").select("doc_id", packed.alias("packed")).select("*", length.alias("length"), distance.alias("distance"), is_literal.alias("is_literal"))


def _dense_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = entropy.shannon_lengths(_histogram(spark, sf_dir), "source")
    return lengths.select("source").distinct().withColumn("byte", F.explode(F.sequence(F.lit(0), F.lit(255)))).join(lengths.select("source", "byte", "bits"), ["source", "byte"], "left").fillna(0, ["bits"])


@query(f"{_DENSE_SQL} SELECT source, greatest(32, max(CASE WHEN bits > 0 THEN byte END) + 1)::INT AS kept FROM d GROUP BY source")
def p19_trimmed_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.trimmed(_dense_lengths(spark, sf_dir), "source", "byte", "bits", 32)


_META_SQL = f"""{_DENSE_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY byte) - row_number() OVER (PARTITION BY source, bits ORDER BY byte) AS island FROM d),
runs AS (SELECT source, bits, count(*) AS n FROM i GROUP BY source, bits, island),
parts AS (SELECT source, bits, n, CASE WHEN bits = 0 THEN n // 138 + CASE WHEN n % 138 >= 11 THEN 1 ELSE 0 END END AS s18, CASE WHEN bits = 0 AND n % 138 BETWEEN 3 AND 10 THEN 1 ELSE 0 END AS s17,
  CASE WHEN bits > 0 THEN (n - 1) // 6 + CASE WHEN (n - 1) % 6 >= 3 THEN 1 ELSE 0 END END AS s16, CASE WHEN bits > 0 THEN 1 + CASE WHEN (n - 1) % 6 < 3 THEN (n - 1) % 6 ELSE 0 END WHEN n % 138 < 3 THEN n % 138 ELSE 0 END AS own FROM runs),
m AS (SELECT source, symbol, sum(k)::BIGINT AS freq FROM (SELECT source, 18 AS symbol, s18 AS k FROM parts UNION ALL SELECT source, 17, s17 FROM parts UNION ALL SELECT source, 16, s16 FROM parts UNION ALL SELECT source, bits, own FROM parts) GROUP BY ALL HAVING sum(k) > 0)"""


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = entropy.run_lengths(_dense_lengths(spark, sf_dir), "source", "byte", "bits")
    return runs.groupBy("source", F.col("symbol").cast("int").alias("symbol")).agg(F.count("*").alias("freq"))


@query(f"{_META_SQL} SELECT source, symbol::INT AS symbol, freq FROM m")
def a2_meta_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each symbol of the run-length coded code lengths occurs."""
    return _meta(spark, sf_dir)


@query(f"""{_META_SQL}, o(place, symbol) AS (VALUES {", ".join(map(str, enumerate(entropy.META_ORDER)))}),
e AS (SELECT s.source, place, o.symbol, coalesce(freq, 0) AS freq FROM (SELECT DISTINCT source FROM m) s CROSS JOIN o LEFT JOIN m ON m.source = s.source AND m.symbol = o.symbol)
SELECT source, place, symbol, freq FROM e QUALIFY place < greatest({entropy.META_LEAST}, max(CASE WHEN freq > 0 THEN place END) OVER (PARTITION BY source) + 1)""")
def w9_meta_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.meta_order(_meta(spark, sf_dir).filter(F.col("symbol") < 19), "source")


@query(f"""
WITH s AS (SELECT doc_id AS stream_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT stream_id, substr(h, k * {2 * CHUNK} + 1, {2 * CHUNK}) AS h, k FROM (SELECT *, unnest(range(0, (length(h) + {2 * CHUNK - 1}) // {2 * CHUNK})) AS k FROM s)),
p AS (SELECT stream_id, k, h, unnest(range(0, (length(h) + 2047) // 2048)) AS j FROM c)
SELECT stream_id, k::INT AS chunk_index, j::INT AS sub_index, md5(substr(h, j * 2048 + 1, 2048)) AS hex_md5 FROM p
""")
def c9_sub_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks cut again, each part a gzip member of its own; decoded here."""
    parts = chunks.sub_split(chunks.split(streams(spark, sf_dir), CHUNK), 1024).withColumn("packed", codecs.encode("gzip", F.col("raw")))
    return parts.select("stream_id", "chunk_index", "sub_index", F.md5(F.hex(codecs.decode("gzip", F.col("packed"))).cast("binary")).alias("hex_md5"))


_REPORT_SQL = "SELECT source AS workload, count(*) AS docs, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS in_bytes FROM documents GROUP BY source"


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.col("source").alias("workload"), F.length(chunks.bytes_of()).cast("long").alias("n"))
    return rows.groupBy("workload").agg(F.count("*").alias("docs"), F.sum("n").alias("in_bytes"))


@query(_REPORT_SQL)
def k5_csv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv(_report(spark, sf_dir), place(spark, "csv"))


@query(f"SELECT *, '{CHUNK}' AS chunk_size, '5' AS level FROM ({_REPORT_SQL})")
def k6_json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk size and level are strings, as in the report's other uses."""
    return json(_report(spark, sf_dir).withColumn("chunk_size", F.lit(str(CHUNK))).withColumn("level", F.lit("5")), place(spark, "json"))


@query("SELECT source, printf('%.4f', sum(octet_length(encode(coalesce(text, ''))))::DOUBLE / sum(length(coalesce(text, '')))) AS ratio FROM documents GROUP BY source")
def p20_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes to characters of each source, to four places."""
    rows = read(spark, sf_dir, "documents").select("source", F.length(chunks.bytes_of()).alias("b"), F.length(F.coalesce("text", F.lit(""))).alias("c"))
    return rows.groupBy("source").agg(F.format_string("%.4f", F.sum("b").cast("double") / F.sum("c")).alias("ratio"))


@query("""
WITH f AS (SELECT coalesce(source, 'none') AS dir, doc_id || '.txt' AS name, octet_length(encode(coalesce(text, ''))) AS n FROM documents)
SELECT 'docs/' || dir || '/' || name AS path, false AS is_dir, n AS size FROM f UNION ALL SELECT DISTINCT 'docs/' || dir, true, 0 FROM f UNION ALL SELECT 'docs', true, 0
""")
def s8_tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files under one folder of the shared store, which is then scanned."""
    root = f"{place(spark, 'tree')}/docs"
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    tree.write_files(read(spark, sf_dir, "documents").select(path.alias("path"), chunks.bytes_of().alias("raw")), root)
    return tree.scan(spark, root).select("path", "is_dir", "size")
