import bz2
import gzip
import lzma
import random
import tracemalloc
import zlib

import duckdb
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oredock.functions import codecs
from oredock.operators import chunks, entropy, lz77
from oredock.plans import registry
from oredock.sources import archive, tree

STREAMS = [b"", b"a", bytes(range(32)), b"abc" * 56, b"x" * 64, b"".join(b"line %d: the quick brown fox\n" % i for i in range(256)), bytes((i * 2654435761) & 255 for i in range(1500))]
OPEN = {"deflate": lambda d: zlib.decompress(d, -15), "gzip": gzip.decompress, "zstd": lambda d: zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(d), "bzip2": bz2.decompress, "lzma": lzma.decompress}


def frame(spark):
    return spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(STREAMS)], "stream_id long, raw binary")


@pytest.mark.parametrize("codec", list(OPEN))
def test_round_trip(spark, codec):
    got = {r.stream_id: bytes(r.raw) for r in chunks.round_trip(frame(spark), codec, 100).collect()}
    assert got == dict(enumerate(STREAMS))


@pytest.mark.parametrize("codec", list(OPEN))
def test_other_decoders_read_members(spark, codec):
    rows = frame(spark).filter("length(raw) > 0").select("stream_id", codecs.encode(codec, F.col("raw")).alias("p")).collect()
    assert all(OPEN[codec](bytes(r.p)) == STREAMS[r.stream_id] for r in rows)


def test_chunk_plan(spark):
    rows = chunks.plan(spark.createDataFrame([(1, 5000), (2, 0)], "stream_id long, n_bytes long"), 2048).orderBy("chunk_index").collect()
    assert [(r.stream_id, r.chunk_index, r.start, r.length) for r in rows] == [(1, 0, 0, 2048), (1, 1, 2048, 2048), (1, 2, 4096, 904)]


def test_foreign_members_are_decoded_too():
    own = codecs.GZIP_HEADER + codecs.deflate(b"own") + zlib.crc32(b"own").to_bytes(4, "little") + (3).to_bytes(4, "little")
    foreign = gzip.compress(b"foreign")
    assert codecs.ungzip(foreign + own + own) == b"foreignownown"
    assert codecs.ungzip(own + foreign + own) == b"ownforeignown"
    for bad in (own[:-1], own[:-8] + bytes(4) + own[-4:]):
        with pytest.raises((ValueError, zlib.error)):
            codecs.ungzip(bad)


def test_errors_reach_the_caller(spark):
    with pytest.raises(ValueError):
        codecs.encode("rar", F.col("raw"))
    broken = spark.createDataFrame([(bytearray(b"nonsense"),)], "raw binary").select(codecs.decode("gzip", F.col("raw")))
    with pytest.raises(Exception, match="incorrect header|Error"):
        broken.collect()


@pytest.mark.parametrize("container", ["zip", "tar", "tar.gz", "tar.zst"])
def test_archives(spark, container):
    rows = [("x", "src/a.txt", bytearray(b"hello world\n")), ("x", "src/b.bin", bytearray(b"\xaa" * 16384)), ("x", "../src/é.txt", bytearray(b"")), ("y", "/etc/passwd", bytearray(b"p"))]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    packed = archive.pack(spark.createDataFrame(rows, "archive string, path string, raw binary"), container)
    got = {(r.archive, r.path): (r.size, bytes(r.content), r.is_safe) for r in archive.list_entries(packed, True).collect()}
    assert got == {("x", "src/a.txt"): (12, b"hello world\n", True), ("x", "src/b.bin"): (16384, b"\xaa" * 16384, True), ("x", "src/é.txt"): (0, b"", True), ("y", "etc/passwd"): (1, b"p", True)}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_archive_files(spark, tmp_path):
    for container, data in (("tar.xz", lzma.compress), ("tar.bz2", bz2.compress)):
        (tmp_path / f"a.{container}").write_bytes(data(archive.tar_bytes(["d/f"], [b"content"])))
    rows = archive.read_archives(spark, f"file://{tmp_path}", True).collect()
    assert len(rows) == 2 and all((r.path, bytes(r.content)) == ("d/f", b"content") for r in rows)
    with pytest.raises(ValueError):
        archive.pack(spark.createDataFrame([], "archive string, path string, raw binary"), "rar")


@given(st.lists(st.integers(0, 1000), min_size=2, max_size=40))
def test_huffman(freq):
    bits = entropy.huffman(freq, 9)
    used = [b for f, b in zip(freq, bits) if f]
    assert all((b > 0) == (f > 0) for f, b in zip(freq, bits)) and max([0, *used]) <= 9
    assert sum(2.0**-b for b in used) <= 1


@given(st.binary(max_size=400), st.integers(1, 40))
def test_tokens(raw, window):
    data = bytearray()
    for n, d in lz77.tokenize(raw, window):
        if not n:
            data.append(d)
        for _ in range(n):
            assert 3 <= n <= 258 and 1 <= d <= window
            data.append(data[-d])
    assert data == raw


def test_deflate_blocks(spark):
    rows = frame(spark).filter("length(raw) > 0").select(F.col("stream_id").alias("chunk_id"), F.posexplode(lz77.tokens_of("raw")).alias("i", "t")).select("chunk_id", "i", "t.length", "t.distance")
    got = {r.chunk_id: zlib.decompress(bytes(r.block), -15) for r in lz77.deflate_blocks(rows).collect()}
    assert got == {i: b for i, b in enumerate(STREAMS) if b}


@pytest.mark.parametrize("container", ["zip", "tar", "tar.gz", "tar.zst"])
def test_tree_through_files(spark, tmp_path, container):
    """A tree with directories, an empty one, an empty file and a link: scanned, packed, written to files, read and written out again."""
    tree_of = {"src/a.txt": b"hello world\n", "src/b.bin": b"\xaa" * 16384, "src/nested/c.txt": b"second file\n", "src/nested/deep/d.log": b"deeply nested\n", "src/e": b""}
    for path, raw in tree_of.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(raw)
    (tmp_path / "src/void").mkdir()
    (tmp_path / "src/link").symlink_to("a.txt")
    found = tree.scan(spark, f"file://{tmp_path}/src")
    paths = ["src", "src/a.txt", "src/b.bin", "src/e", "src/link", "src/nested", "src/nested/c.txt", "src/nested/deep", "src/nested/deep/d.log", "src/void"]
    assert sorted(r.path for r in found.collect()) == paths
    packed = archive.pack(tree.with_content(found, f"{tmp_path}/src").withColumn("archive", F.lit("all")), container)
    out = tree.write_files(packed.select(F.concat("archive", F.lit("."), "container").alias("path"), F.col("data").alias("raw")), f"file://{tmp_path}/out")
    assert [r.path for r in out.collect()] == [f"all.{container}"]
    read = archive.read_archives(spark, f"file://{tmp_path}/out/*", True)
    listed = {r.path: (r.is_dir, r.content and bytes(r.content)) for r in read.collect()}
    links = {"src/link"} if container != "zip" else set()
    assert set(listed) == {p for p in paths if p != "src/link"} | links
    assert {p: c for p, (d, c) in listed.items() if p in tree_of} == {p: r or listed[p][1] for p, r in tree_of.items()}
    assert all(d == (p in ("src", "src/nested", "src/nested/deep", "src/void")) for p, (d, _) in listed.items())
    tree.write_files(read.filter("NOT is_dir AND content IS NOT NULL").select("path", F.col("content").alias("raw")), f"{tmp_path}/again").count()
    assert all((tmp_path / "again" / p).read_bytes() == raw for p, raw in tree_of.items())
    with pytest.raises(ValueError):
        tree.write_files(spark.createDataFrame([("../x", bytearray(b"y"))], "path string, raw binary"), str(tmp_path))


def test_unknown_suffix(spark, tmp_path):
    (tmp_path / "file.unknownext").write_bytes(b"x")
    with pytest.raises(Exception, match="can't be read"):
        archive.read_archives(spark, f"file://{tmp_path}").collect()


def test_two_entries_of_one_path(spark):
    rows = [("x", "a/b", bytearray(b"1")), ("x", "a/../b", bytearray(b"2")), ("x", "../a/b", bytearray(b"3"))]
    with pytest.raises(Exception, match="one path"):
        archive.pack(spark.createDataFrame(rows, "archive string, path string, raw binary"), "tar").collect()


def test_options_are_checked(spark):
    rows = frame(spark)
    for size in (0, -1):
        with pytest.raises(ValueError):
            chunks.split(rows, size)
    for level in (-1, 10):
        with pytest.raises(ValueError):
            codecs.encode("gzip", F.col("raw"), level)
        with pytest.raises(ValueError):
            archive.pack(rows.withColumn("archive", F.lit("a")).withColumn("path", F.lit("p")), "tar", level)
    with pytest.raises(ValueError):
        entropy.huffman([1] * 40, 5)


def test_members_with_foreign_ones_and_headers_within(spark):
    """Foreign members, and headers within compressed data, are decoded like any other decoder does."""
    own = lambda raw: codecs.GZIP_HEADER + codecs.deflate(raw) + zlib.crc32(raw).to_bytes(4, "little") + len(raw).to_bytes(4, "little")
    stored = zlib.compressobj(0, zlib.DEFLATED, -15)
    noise = b"x" + codecs.GZIP_HEADER + b"y"
    within = codecs.GZIP_HEADER + stored.compress(noise) + stored.flush() + zlib.crc32(noise).to_bytes(4, "little") + len(noise).to_bytes(4, "little")
    cases = [(own(b"a") + own(b"b"), b"ab"), (gzip.compress(b"foreign") + own(b"a") + own(b"b"), b"foreignab"), (own(b"a") + gzip.compress(b"foreign") + own(b"b"), b"aforeignb"), (within + own(b"z"), noise + b"z"), (b"", b""), (gzip.compress(b"only"), b"only")]
    packed = spark.createDataFrame([(i, bytearray(p)) for i, (p, _) in enumerate(cases)], "stream_id long, packed binary")
    assert {r.stream_id: bytes(r.raw) for r in registry.decoded_members(packed).collect()} == {i: raw for i, (_, raw) in enumerate(cases)}


def test_large_stream_is_assembled_in_one_pass(spark):
    raw = bytes(range(256)) * 4096 * 16  # 16 MB in 4,096 chunks
    got = chunks.assemble(chunks.split(spark.createDataFrame([(1, bytearray(raw))], "stream_id long, raw binary"), 4096), "raw", "raw").first()
    assert bytes(got.raw) == raw


def test_starts_of_one_large_group(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 5 == 0, None).otherwise("hot").alias("k"), "id", (F.col("id") % 7).alias("n"))
    got = {r.id: r.start for r in chunks.starts(rows, "k", "id", "n").collect()}
    seen = {True: 0, False: 0}
    for i in range(3000):
        assert got[i] == seen[i % 5 == 0]
        seen[i % 5 == 0] += i % 7


def test_symbols_of_all_values(spark):
    for kind, base, extra, first, values in (("length", entropy.LENGTH_BASE, entropy.LENGTH_EXTRA, 257, range(3, 259)), ("distance", entropy.DISTANCE_BASE, entropy.DISTANCE_EXTRA, 0, range(1, 32769))):
        rows = entropy.with_symbol(spark.createDataFrame([(v,) for v in values], "v int"), "v", kind).collect()
        for r in rows:
            at = max(i for i, b in enumerate(base) if b <= r.v)
            assert (r.symbol, r.extra, r.extra_value) == (first + at, extra[at], r.v - base[at])


def test_own_codec(spark):
    codecs.register("turned", lambda raw, level: raw[::-1], lambda data: data[::-1])
    got = {r.stream_id: bytes(r.raw) for r in chunks.round_trip(frame(spark), "turned", 100).collect()}
    assert got == dict(enumerate(STREAMS))


def plain_tokens(raw, window):
    last, out, p = {}, [], 0

    def match(p):
        at = last.get(raw[p : p + 3], -1)
        if at < 0 or p - at > window or p + 3 > len(raw):
            return 0, 0
        n = 3
        while n < min(258, len(raw) - p) and raw[at + n] == raw[p + n]:
            n += 1
        return n, p - at

    while p < len(raw):
        n, d = match(p)
        last[raw[p : p + 3]] = p
        if not n or match(p + 1)[0] > n:
            n, d = 0, raw[p]
        for q in range(p + 1, p + n):
            last[raw[q : q + 3]] = q
        out.append((n, d))
        p += max(n, 1)
    return out


@given(st.lists(st.binary(max_size=40) | st.text("ab", max_size=600).map(str.encode), max_size=4), st.sampled_from([1, 3, 40, 32768]))
def test_tokens_of_many_rows_are_those_of_each(raws, window):
    lengths, distances, starts = lz77._tokens(raws, window)
    pairs = list(zip(lengths.tolist(), distances.tolist()))
    assert [pairs[a:b] for a, b in zip(starts, starts[1:])] == [plain_tokens(r, window) for r in raws]


def test_tokens_and_replay_keep_rows_and_nulls(spark):
    rows = frame(spark).union(spark.createDataFrame([(99, None)], "stream_id long, raw binary"))
    tokens = rows.select("stream_id", "raw", lz77.tokens_of("raw").alias("t"), lz77.reconstructed("raw").alias("whole"))
    for r in tokens.withColumn("again", lz77.replay("t")).collect():
        assert r.whole == r.raw and r.again == r.raw
        assert (r.t and [tuple(x) for x in r.t]) == (None if r.raw is None else plain_tokens(bytes(r.raw), 32768))


@pytest.mark.parametrize("name", ["tokens_of", "replay", "reconstructed"])
def test_memory_of_a_batch_of_tokens(name):
    """400 chunks without a match: a million tokens and more, which must not be objects all at once."""
    rng = random.Random(1)
    batch = pa.array([rng.randbytes(4096) for _ in range(400)])
    if name == "replay":
        batch = pa.concat_arrays(list(lz77.tokens_of.func(iter([batch]))))
    tracemalloc.start()
    rows = sum(len(part) for part in getattr(lz77, name).func(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert rows == 400 and peak < 100


def test_deflated_chunks_of_any_kind(spark):
    noise = random.Random(3).randbytes(32768)
    raws = [*STREAMS, None, noise + noise[:300], b"".join(bytes([i, 255 - i]) * 200 for i in range(256))]
    rows = spark.createDataFrame([(i, r if r is None else bytearray(r)) for i, r in enumerate(raws)], "chunk_id long, raw binary")
    blocks = {r.chunk_id: r.b for r in rows.select("chunk_id", lz77.deflated("raw").alias("b")).collect()}
    assert {i: b if b is None else zlib.decompress(bytes(b), -15) for i, b in blocks.items()} == dict(enumerate(raws))


def test_deflate_block_needs_no_rows_of_tokens(spark):
    """Work on a chunk stays on its row: no token is written, shuffled or sorted as a row of its own."""
    plan = registry.QUERIES["c10_deflate_block"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Window", "spark-", "table-"))


def test_blocks_are_the_words_of_windows_and_ors(spark):
    """Bits of array functions, and those that a window and grouped ORs place."""
    lengths, distances, starts = lz77._tokens([STREAMS[5]])
    value, bits = lz77._writes(lengths.astype("int64"), distances.astype("int64"))
    writes = [(3, 3), *zip(value.tolist(), bits.tolist()), (0, 7)]
    rows = spark.createDataFrame([(1, i, v, n) for i, (v, n) in enumerate(writes)], "k int, i int, value long, n_bits int")
    words = {r.word: r.value for r in entropy.bit_words(entropy.bit_offsets(rows, "k", "i"), "k").collect()}
    (block,), (total,) = lz77._blocks(lengths, distances, starts)
    assert total == sum(n for _, n in writes)
    assert b"".join((words[w] & 0xFFFFFFFF).to_bytes(4, "little") for w in range((total + 31) // 32))[: len(block)] == block
    with pytest.raises(ValueError):
        lz77._blocks(lengths[:1] + 2, distances[:1] * 0, starts[:2] * 0 + [0, 1])


def plain_segments(rows, segment):
    table = {}
    for k, raw in rows:
        for p in range(len(raw or b"") - 2):
            h = (int.from_bytes(raw[p : p + 3], "big") * 2654435761 & 0xFFFFFFFF) >> 16
            low, high, n = table.get((k, h, p // segment), (p, p, 0))
            table[k, h, p // segment] = min(low, p), max(high, p), n + 1
    return table


@pytest.mark.parametrize("slice_size", [1, 500, lz77.SLICE])
def test_segments_of_ids_that_come_again(spark, monkeypatch, slice_size):
    """Chunks of one id, of null too, share their table, wherever slices and batches end."""
    monkeypatch.setattr(lz77, "SLICE", slice_size)
    rng = random.Random(2)
    rows = [(f"{rng.randrange(40)}:0" if i % 9 else None, rng.choice([*STREAMS, None, bytes(rng.choices(b"ab", k=50))])) for i in range(300)]
    chunked = spark.createDataFrame([(k, r if r is None else bytearray(r)) for k, r in rows], "chunk_id string, raw binary")
    got = lz77.segment_table(chunked.repartition(5), 100).collect()
    assert {(r.chunk_id, r.hash, r.segment): (r.oldest, r.newest, r.positions) for r in got} == plain_segments(rows, 100)
    assert len(got) == len({(r.chunk_id, r.hash, r.segment) for r in got})


def test_segment_table_shuffles_chunks_only(spark):
    """One shuffle, of chunks and before their positions are looked at."""
    plan = registry.QUERIES["a4_segment_table"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan
    assert plan.index("MapInArrow") < plan.index("Exchange")


def test_memory_of_tokens_does_not_follow_the_batch():
    """Four times the chunks in a batch, as larger tables have, need no more memory at once."""
    rng, peaks = random.Random(4), []
    for n in (150, 600):
        batch = pa.array([rng.randbytes(4096) for _ in range(n)])
        tracemalloc.start()
        assert sum(len(part) for part in lz77.tokens_of.func(iter([batch]))) == n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]


@pytest.mark.parametrize("slice_size", [1, 3000, lz77.SLICE])
def test_symbols_of_chunks_are_those_of_rows_of_tokens(spark, monkeypatch, slice_size):
    monkeypatch.setattr(lz77, "SLICE", slice_size)
    noise = random.Random(5).randbytes(20000)
    # matches of every length, and far ones
    raws = [*STREAMS, None, noise + noise[:300], b"".join(noise[n : n + n] + bytes([n % 256]) for n in range(3, 260)) + noise[:520]]
    rows = spark.createDataFrame([(i, r if r is None else bytearray(r)) for i, r in enumerate(raws)], "chunk_id long, raw binary").repartition(2)
    tokens = rows.select("chunk_id", F.explode(lz77.tokens_of("raw")).alias("t")).select("chunk_id", "t.length", "t.distance").localCheckpoint()
    want = {(r.chunk_id, r.alphabet, r.symbol): r.freq for r in lz77.symbol_counts(tokens, "chunk_id").collect()} | {(0, "literal", 256): 1}
    got = {r.chunk_id: r.c for r in rows.select("chunk_id", lz77.symbols_of("raw").alias("c")).collect()}
    assert got.pop(len(STREAMS)) is None
    assert {(k, x.alphabet, x.symbol): x.freq for k, c in got.items() for x in c.symbols} == want
    assert sum(len(c.symbols) for c in got.values()) == len(want)
    many = {r.chunk_id: (r.n, r.copies) for r in tokens.groupBy("chunk_id").agg(F.count("*").alias("n"), F.count_if(F.col("length") > 0).alias("copies")).collect()} | {0: (0, 0)}
    assert {k: (c.tokens, c.copies) for k, c in got.items()} == many


def test_symbol_counts_need_no_rows_of_tokens(spark):
    """Counts are made on a chunk's row: nothing is written, and only the counts of the whole are shuffled."""
    plan = registry.QUERIES["a1_symbol_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("ArrowEvalPython") == 1 and "table-" not in plan and "Join" not in plan


@pytest.mark.parametrize("ids", [[], [1, 1, 2, None, None, 3]])
def test_symbol_counts_of_ids_that_come_again(spark, tmp_path, ids):
    """Chunks are counted row by row, like the SQL does; without any, none is wrong."""
    rows = [(k, t) for k, t in zip(ids, ["a" * 5000, "b" * 5000, "", "c", "d", None])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert [tuple(r) for r in registry.QUERIES["a1_symbol_counts"](spark, str(tmp_path)).collect()] == con.sql(registry.SQL["a1_symbol_counts"]).fetchall()


def test_memory_of_symbols_does_not_follow_the_batch():
    """Four times the chunks in a batch, and a batch of chunks of a byte, need no more memory at once."""
    rng, peaks = random.Random(6), []
    for n, size in ((150, 4096), (600, 4096), (10000, 1)):
        batch = pa.array([rng.randbytes(size) for _ in range(n)])
        tracemalloc.start()
        assert sum(len(part) for part in lz77.symbols_of.func(iter([batch]))) == n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert max(peaks) < 1.5 * peaks[0]
