"""SimHash near-deduplication with bit-sliced comparison (operator 8).

Fingerprints: 64 bits over the XXH64 hashes of 3-word shingles. Two fingerprints that differ in at
most RADIUS bits agree in at least PARTS - RADIUS of PARTS bit ranges, so each fingerprint is dealt to
one bucket for every choice of so many ranges, and all linked pairs meet in a bucket. Distinct
fingerprints only: copies are one node.

Within a task, fingerprints sorted by bucket fill windows of 64 lanes, whose bits are stored as planes
(one 64-bit word for each bit). Windows that share a bucket are compared: one plane at a time, the
differing bits are added to carry-save counters with a sticky overflow, for 64 fingerprints against
64, and window pairs of which every lane has overflowed are abandoned. The distances are exact.

Skew: a bucket of more than BLOCK fingerprints is split into blocks, and its pairs of blocks go to
different tasks. A pair of blocks returns a forest (each fingerprint and its smallest linked one),
so the number of links is linear in what a task reads, and no link is lost: what a task's links
connect, its forest connects. Components come from repeated large-star and small-star rounds,
each written to the shared folder.

Defined cases: a null text counts as empty; texts without words have fingerprint 0, linked like any
other; repeated rows are rows of their own; null ids are kept, and a component's id is null only if all
its ids are; keep_one keeps one row of each component, also of repeated rows and null ids, and all columns.

keep_one with a similarity (the pipeline's stage): a class is the texts of one set of shingles, and has two
64-bit fingerprints over that set. Ranges of equal bits can't be found at the distances that a Jaccard
similarity of 0.8 gives, so classes are dealt to buckets by the shingles themselves: in each of TABLES
tables, by those ROWS of its shingles that have the smallest hashes under ROWS permutations. Two sets of
similarity s meet with probability 1 - (1 - s ** ROWS) ** TABLES, 0.9996 at 0.8. Those that meet are
compared bit-sliced, with a radius DEVIATIONS standard deviations over the distance expected at that
similarity, by both fingerprints, and what is left is checked exactly on the sets of shingles.

Checks come in two rounds, so that a large group of near copies isn't written out pair by pair and no link
between components is lost. First, each class is checked with its NEAREST candidates of smaller key. If
some have more, those of their buckets that hold several components are compared again, now with the sets
of shingles at hand: all candidates of different components are checked, and a task returns a forest of the
links that it finds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oredock.llm.common import LOWER, bounded, fold, materialize, read, text_of

WORDS, RADIUS, PARTS, BLOCK, SEED = 3, 3, 5, 4096, 42
# For a similarity: tables, shingles of each, standard deviations of the distance, and candidates of the first round.
TABLES, ROWS, DEVIATIONS, NEAREST, SPLIT = 20, 5, 4, 4, 1024
LANES = 64
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, words: int = WORDS) -> list[int]:
    """XXH64 of each shingle of the lower-cased text, repeats included; a short text is one shingle."""
    found = text.translate(LOWER).split()
    if not found:
        return []
    line, ends, at = b" ".join(found), [], -1
    for w in found:
        at += len(w) + 1
        ends.append(at)
    if len(ends) <= words:
        return [xxhash.xxh64_intdigest(line, SEED)]
    starts = [0, *(e + 1 for e in ends[: -words])]
    return [xxhash.xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts, ends[words - 1 :])]


def fingerprint(hashes: list[int]) -> int:
    """A bit is set where more than half of the hashes have it."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        part = np.array(hashes[at : at + 4096], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0])


@F.arrow_udf(T.LongType())
def fingerprint_of(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(shingle_hashes(t)) for t in texts.cast(pa.binary()).to_pylist()], pa.int64())


def planes_of(values: np.ndarray) -> np.ndarray:
    """(windows, 64 lanes) of fingerprints to (windows, 64 planes) of words whose bit j is lane j's."""
    bits = np.unpackbits(values.view(np.uint8).reshape(len(values), LANES, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view("<u8").reshape(len(values), 64)


def within(queries: np.ndarray, planes: np.ndarray, dead: np.ndarray, radius: int) -> np.ndarray:
    """(pairs, 64) words: bit j of word i tells whether query i and lane j differ in at most radius bits.

    queries: (pairs, 64) fingerprints; planes: (pairs, 64); dead: (pairs, 64) lanes that don't count.
    """
    alive, out = np.arange(len(queries)), np.zeros_like(queries)
    width = radius.bit_length()
    # counters start at 2 ** width - 1 - radius, so that overflow means a distance over the radius
    start = (1 << width) - 1 - radius
    counters = [np.full_like(queries, ONES if start >> k & 1 else 0) for k in range(width)]
    over = dead.copy()
    for b in range(64):
        differ = planes[alive, b][:, None] ^ (np.uint64(0) - ((queries[alive] >> np.uint64(b)) & np.uint64(1)))
        for k in range(width):
            carry = counters[k] & differ
            counters[k] ^= differ
            differ = carry
        over |= differ
        if b % 8 == 7:
            stay = (over != ONES).any(axis=1)
            if not stay.all():
                alive, over, counters = alive[stay], over[stay], [c[stay] for c in counters]
            if not len(alive):
                return out
    out[alive] = ~over
    return out


def linked(values: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of values (sorted by group) that differ in at most radius bits; those of one group all are found."""
    n = len(values)
    windows = -(-n // LANES)
    padded = np.zeros(windows * LANES, dtype=np.uint64)
    padded[:n] = values
    padded = padded.reshape(windows, LANES)
    absent = np.zeros(windows, dtype=np.uint64)
    if n % LANES:
        absent[-1] = ONES << np.uint64(n % LANES)
    planes = planes_of(padded)
    # the last window that a window's last group reaches
    last = np.searchsorted(groups, groups[np.minimum(np.arange(1, windows + 1) * LANES, n) - 1], side="right") - 1
    reach = last // LANES
    # lane i is compared with later lanes of its own window, and with all lanes of later ones
    earlier = np.array([(1 << (i + 1)) - 1 for i in range(LANES)], dtype=np.uint64)
    lefts, rights = [], []
    todo = np.repeat(np.arange(windows), reach - np.arange(windows) + 1)
    other = todo + np.arange(len(todo)) - np.searchsorted(todo, todo)
    for at in range(0, len(todo), 2048):
        a, b = todo[at : at + 2048], other[at : at + 2048]
        dead = np.repeat(absent[b][:, None], LANES, axis=1)
        dead[a == b] |= earlier
        near = within(padded[a], planes[b], dead, radius)
        pair, lane = np.nonzero(near)
        hits = np.unpackbits(near[pair, lane].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, bit = np.nonzero(hits)
        left = a[pair[row]] * LANES + lane[row]
        inside = left < n
        lefts.append(left[inside])
        rights.append((b[pair[row]] * LANES + bit)[inside])
    return (np.concatenate(lefts), np.concatenate(rights)) if lefts else (np.zeros(0, np.int64),) * 2


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index that each index is connected to, by repeated pointer jumping."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        root = root[root]
        if (root == before).all() and (root[left] == root[right]).all():
            break
    return root


def links(prints: DataFrame, radius: int = RADIUS, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) of fingerprints whose components are those of all pairs within the radius. prints: distinct fp."""
    bounds = [64 * i // parts for i in range(parts + 1)]
    masks = [sum(((1 << bounds[i + 1]) - (1 << bounds[i])) for i in chosen) for chosen in combinations(range(parts), parts - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)])
    dealt = prints.select("fp", F.explode(keys).alias("bucket")).select("fp", "bucket.t", "bucket.k")
    sizes = dealt.groupBy("t", "k").count().filter(F.col("count") > 1)
    parted = dealt.join(sizes, ["t", "k"]).withColumn("blocks", F.ceil(F.col("count") / block).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
    rows = parted.withColumn("own", own).select("t", "k", F.explode(pairs).alias("p"), "fp").select("t", "k", "p.i", "p.j", "fp")

    def edges(values: list[np.ndarray], groups: list[np.ndarray]) -> pa.RecordBatch:
        fp, group = np.concatenate(values), np.concatenate(groups)
        root = forest(len(fp), *linked(fp.view(np.uint64), group, radius))
        child = np.nonzero(root != np.arange(len(fp)))[0]
        a, b = fp[child], fp[root[child]]
        differ = a != b
        return pa.RecordBatch.from_pydict({"a": pa.array(a[differ], pa.int64()), "b": pa.array(b[differ], pa.int64())})

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values: list[np.ndarray] = []
        groups: list[np.ndarray] = []
        held, number, last = 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("t", "k", "i", "j")], axis=1)
            fp = batch.column("fp").to_numpy()
            change = np.concatenate([[last is None or (table[0] != last).any()], (table[1:] != table[:-1]).any(axis=1)])
            ids = number + np.cumsum(change)
            number, last = int(ids[-1]), table[-1]
            if held >= 16 * block and change.any():  # all groups before this batch's first change are whole
                cut = int(np.argmax(change))
                yield edges([*values, fp[:cut]], [*groups, ids[:cut]])
                values, groups, held, fp, ids = [], [], 0, fp[cut:], ids[cut:]
            values.append(fp)
            groups.append(ids)
            held += len(fp)
        if held:
            yield edges(values, groups)

    return rows.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j").mapInArrow(compared, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes with an edge."""
    star = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        star = materialize(small)
        state = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return star.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    """A bucket number for each table: a hash of the table and of the smallest shingles under its permutations; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    odd, plus = again(np.arange(2 * TABLES * ROWS, dtype=np.uint64) + np.uint64(SEED)).reshape(2, -1)
    least = np.full(TABLES * ROWS, ONES)
    for at in range(0, len(hashes), 1024):
        mixed = hashes[at : at + 1024, None] * (odd | np.uint64(1)) + plus
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    key = np.arange(1, TABLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for x in least.reshape(TABLES, ROWS).T:
        key = again(key ^ x)
    return key


def radius_of(similarity: float, width: int = 64) -> int:
    """Bits in which fingerprints of so many bits of two shingle sets of that Jaccard similarity differ, and DEVIATIONS standard deviations more."""
    # sets of similarity s have a cosine of at least 2 s / (1 + s); each bit differs with probability angle / pi
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return min(width - 1, math.ceil(width * p + DEVIATIONS * math.sqrt(width * p * (1 - p))))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.array(shingle_hashes(text, words), dtype=np.uint64))


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; that of two empty ones is 1."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 1.0


def again(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles, for a second fingerprint (the finalizer of SplitMix64)."""
    x = hashes ^ (hashes >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def near_pairs(values: np.ndarray, seconds: np.ndarray, keys: np.ndarray, groups: np.ndarray, radius: int, both: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes of pairs within `radius` by the first and `both` by both fingerprints, the larger key first, and their distance."""
    left, right = linked(values, groups, radius)
    far = (np.bitwise_count(values[left] ^ values[right]) + np.bitwise_count(seconds[left] ^ seconds[right])).astype(np.int64)
    stay = (far <= both) & (keys[left] != keys[right])
    left, right, far = left[stay], right[stay], far[stay]
    larger = keys[left] > keys[right]
    return np.where(larger, left, right), np.where(larger, right, left), far


def nearest(values: np.ndarray, seconds: np.ndarray, keys: np.ndarray, groups: np.ndarray, radius: int, both: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, distance) of candidates: for each key a at most the `most` nearest smaller keys b."""
    upper, lower, far = near_pairs(values, seconds, keys, groups, radius, both)
    a, b = keys[upper], keys[lower]
    order = np.lexsort((b, far, a))
    a, b, far = a[order], b[order], far[order]
    fresh = np.ones(len(a), dtype=bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, far = a[fresh], b[fresh], far[fresh]
    stay = np.arange(len(a)) - np.searchsorted(a, a) < most
    return a[stay], b[stay], far[stay]


def confirmed(own: dict[str, np.ndarray], radius: int, both: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links (a, b) of keys between different roots: candidates of which the larger key has `more`, checked by their sets."""
    upper, lower, far = near_pairs(own["fp"].view(np.uint64), own["second"].view(np.uint64), own["key"], own["group"], radius, both)
    open_ = own["more"][upper] & (own["root"][upper] != own["root"][lower])
    order = np.argsort(far[open_], kind="stable")
    upper, lower, sets, above = upper[open_][order], lower[open_][order], {}, {}

    def top(x: int) -> int:
        while x in above:
            x = above[x]
        return x

    def set_of(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = np.frombuffer(own["s"][i], np.uint64)
        return sets[i]

    found = []
    for i, j, x, y in zip(upper.tolist(), lower.tolist(), own["root"][upper].tolist(), own["root"][lower].tolist()):
        x, y = top(x), top(y)
        if x != y and similarity_of(set_of(i), set_of(j)) >= similarity:
            above[max(x, y)] = min(x, y)
            found.append((i, j))
    at = np.array(found, dtype=np.int64).reshape(-1, 2)
    return own["key"][at[:, 0]], own["key"][at[:, 1]]


def near_links(classes: DataFrame, radius: int, both: int, similarity: float, most: int | None = None, block: int = SPLIT) -> DataFrame:
    """a, b and d: candidates that meet in a bucket and are near by both fingerprints (see nearest); without `most`, links (see confirmed).

    classes: bucket, key, fp, second, a row for each class and bucket; without `most` also root, more and s.
    """
    # sizes, from an eighth of the keys, only decide how a bucket is split; at most a row for each `block` rows
    counted = classes.filter(F.pmod(F.xxhash64("key"), F.lit(8)) == 0).groupBy("bucket").agg((8 * F.count("*")).alias("count"))
    large = materialize(counted.filter(F.col("count") > block).select("bucket", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    parted = classes.join(large, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.least(x, F.col("own")).cast("long") * (1 << 31) + F.greatest(x, F.col("own")))
    columns = [c for c in classes.columns if c != "bucket"]
    rows = parted.select("bucket", F.explode(pairs).alias("pair"), *columns)

    def edges(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        own = dict(zip([*columns, "group"], map(np.concatenate, zip(*parts))))
        _, at, sizes = np.unique(own["group"], return_inverse=True, return_counts=True)
        own = {c: v[sizes[at] > 1] for c, v in own.items()}
        if most is None:
            links_found = confirmed(own, radius, both, similarity)
            found = (*links_found, np.zeros(len(links_found[0]), np.int64))
        else:
            found = nearest(own["fp"].view(np.uint64), own["second"].view(np.uint64), own["key"], own["group"], radius, both, most)
        return pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in zip("abd", found)})

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        held, number, last = 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.stack([batch.column(c).to_numpy() for c in ("bucket", "pair")], axis=1)
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
            change = np.concatenate([[last is None or (table[0] != last).any()], (table[1:] != table[:-1]).any(axis=1)])
            own.append(number + np.cumsum(change))
            number, last = int(own[-1][-1]), table[-1]
            if held >= 4 * block and change.any():  # all groups before this batch's first change are whole
                cut = int(np.argmax(change))
                yield edges([*parts, [x[:cut] for x in own]])
                parts, held, own = [], 0, [x[cut:] for x in own]
            parts.append(own)
            held += len(own[0])
        if held:
            yield edges(parts)

    return rows.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair").mapInArrow(compared, "a long, b long, d long").distinct()


@F.arrow_udf(T.BooleanType())
def are_similar(ones: pa.Array, others: pa.Array, least: pa.Array) -> pa.Array:
    sets = zip(*(([np.frombuffer(x, np.uint64) for x in v.to_pylist()]) for v in (ones, others)))
    return pa.array([similarity_of(a, b) >= s for (a, b), s in zip(sets, least.to_pylist())], pa.bool_())


def sets_of(keys: DataFrame, classes: DataFrame, written: DataFrame, words: int) -> DataFrame:
    """key and s, the sorted hashes of its shingles, for some classes (key); written."""

    def sets(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t, words).tobytes() for t in texts.cast(pa.binary()).to_pylist()], pa.binary())

    sets.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    wanted = materialize(classes.join(keys, "key").select(F.col("first.rid").alias("rid"), "key"))
    return materialize(written.select("rid", text_of().alias("t")).join(bounded(wanted), "rid").select("key", F.arrow_udf(sets, "binary")("t").alias("s")))


def checked(pairs: DataFrame, classes: DataFrame, written: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those pairs (a, b) of classes of which the sets of shingles are similar enough."""
    # a row for each class, so no key of these joins is hot but a class of many pairs, which adaptive execution splits
    known = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), classes, written, words)
    one = pairs.select("a", "b").join(known.select(F.col("key").alias("a"), F.col("s").alias("sa")), "a")
    both = one.join(known.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b")
    return materialize(both.filter(are_similar("sa", "sb", F.lit(float(similarity)))).select("a", "b"))


def similar_rows(docs: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text, row), written with rid, a number for each row; and the rid of the rows that go: all but one of each component."""

    def prints(texts: pa.Array) -> pa.Array:
        sets = [shingle_set(t, words) for t in texts.cast(pa.binary()).to_pylist()]
        fp, second = (pa.array([fingerprint(hashes(s)) for s in sets], pa.int64()) for hashes in (np.asarray, again))
        key = pa.array([xxhash.xxh64_intdigest(s.astype("<u8").tobytes(), SEED) for s in sets], pa.uint64())
        buckets = pa.array([buckets_of(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
        return pa.StructArray.from_arrays([fp, second, key.view(pa.int64()), buckets], names=["fp", "second", "key", "buckets"])

    prints.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    print_of = F.arrow_udf(prints, "fp long, second long, key long, buckets array<long>")
    written = materialize(docs.select("*", F.monotonically_increasing_id().alias("rid"), F.xxhash64("text").alias("hash"), print_of(text_of()).alias("p")))
    ranked = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "rid")
    rows = written.select("rid", ranked.alias("rank"), "p.*")
    classes = materialize(rows.groupBy("key").agg(F.min("fp").alias("fp"), F.min("second").alias("second"), F.min("rank").alias("first"), F.min("buckets").alias("buckets"), F.count("*").alias("n")))

    radius, both = radius_of(similarity), radius_of(similarity, 128)
    found = near_links(classes.select(F.explode("buckets").alias("bucket"), "key", "fp", "second"), radius, both, similarity, NEAREST + 1)
    place = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    found = materialize(found.withColumn("place", place).filter(F.col("place") <= NEAREST + 1))
    pairs = found.filter(F.col("place") <= NEAREST).select("a", "b")
    links = checked(pairs, classes, written, words, similarity)
    roots = components(links)
    full = materialize(found.filter(F.col("place") == NEAREST + 1).select(F.col("a").alias("key")))
    if not full.isEmpty():
        theirs = materialize(classes.join(full, "key", "left_semi").select(F.explode("buckets").alias("bucket")).distinct())
        marks = classes.select("key").join(roots.withColumnRenamed("node", "key"), "key", "left").join(full.withColumn("more", F.lit(True)), "key", "left")
        marks = marks.select("key", F.coalesce("root", "key").alias("root"), F.coalesce("more", F.lit(False)).alias("more"))
        dealt = materialize(classes.select(F.explode("buckets").alias("bucket"), "key", "fp", "second").join(theirs, "bucket", "left_semi").join(marks, "key"))
        several = dealt.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("bucket")
        dealt = dealt.join(materialize(several), "bucket", "left_semi")
        known = sets_of(dealt.select("key").distinct(), classes, written, words)
        links = links.unionByName(materialize(near_links(dealt.join(known, "key"), radius, both, similarity).select("a", "b")))
        roots = components(links)
    named = classes.select("key", "first", "n").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    stay = named.groupBy("root").agg(F.min("first").alias("stays"), F.count("*").alias("classes"))
    # only classes of more than one row, or beside others, lose rows
    several = materialize(named.join(stay, "root").filter("n > 1 OR classes > 1").select("key", F.col("stays.rid").alias("stays")))
    gone = rows.select("rid", "key").join(several, "key").filter("rid <> stays").select("rid")
    return written, materialize(gone)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp of each row, written once."""
    return materialize(docs.select("doc_id", fingerprint_of(text_of()).alias("fp")))


def grouped(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """For each fp of prints(doc_id, fp) its root, the component's smallest, and component_id, the smallest id there."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(distinct.select("fp"), radius))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    return materialize(named.join(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "root", "component_id"))


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row for each of docs: doc_id, fp (64 bits as a signed number), root and component_id."""
    prints = fingerprints(docs)
    return prints.join(grouped(prints, radius), "fp").select("doc_id", "fp", "root", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = near_groups(read(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, similarity: float | None = None) -> DataFrame:
    """The columns of docs; of each component one row with the smallest doc_id stays (by text hash, then any, where several have it).

    With a similarity, texts whose shingle sets of so many words have at least that Jaccard similarity are
    linked, and the radius follows from it.
    """
    folded, unfold = fold(docs, "doc_id", "text")
    if similarity is None:
        written = materialize(folded.withColumn("rid", F.monotonically_increasing_id()).withColumn("fp", fingerprint_of(text_of())))
        table = grouped(written.select("doc_id", "fp"), radius).withColumnRenamed("fp", "its_fp")
        # joined by fingerprint and id at once: copies share a fingerprint, but no key
        smallest = written.join(table, (F.col("fp") == F.col("its_fp")) & F.col("doc_id").eqNullSafe(F.col("component_id")))
        rows = smallest.groupBy("root").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "rid")).alias("first")).select("first.rid")
        return unfold(written.join(rows, "rid", "left_semi"), {})
    written, gone = similar_rows(folded, words, similarity)
    return unfold(written.join(bounded(gone), "rid", "left_anti"), {})
