"""Language-model scoring by a weighted backoff automaton (operator 10).

The model is of order three with Dirichlet smoothing: P(w | u v) = (n(u v w) + MU[1] * P(w | v)) / (n(u v) + MU[1]),
P(w | v) = (n(v w) + MU[0] * P(w)) / (n(v) + MU[0]), P(w) = (c + 1) / (N + V + 1). As an automaton: a state
for each counted pair, for each word and the start, and the root. A state has an arc for each word counted
after it, with its log-probability, and a failure arc to the state of its last word, then to the root, with
the log of the share that is left; the root has an arc for each word. A document is one left-to-right traversal.

The model grows with the corpus and is never in one place. Documents are cut into blocks of about BLOCK
bytes, written once, and BUNDLE blocks are a bundle. For each bundle and shard of the hash range goes one
message, with the sorted hashes of the distinct words, pairs and triples of its blocks (as byte planes of
their differences) and their counts in training documents. A shard adds up what all bundles sent and
answers each message with the sums, in its order, written once; with these, a block builds the part of the
automaton that its documents can reach and traverses it. A frequent word or pair is sent once for each
block, so none makes a shard hot. All are counted; nothing is pruned. There are as many shards as
spark.sql.shuffle.partitions, or one for each SHARD bytes of text if that is more.

Words are known by 64-bit hashes and pairs and triples by 48 bits: V and n_known are exact up to some 10^9
distinct words, and of 10^9 distinct pairs or triples one in 300,000 shares its count with another.

Defined cases: null and empty texts are just the end token; a null id counts as the empty text for
the split; repeated rows are scored and counted one by one; with no training documents N and V are
0 and all tokens have probability 1; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oredock.llm.common import LOWER, held_out, materialize, read, text_of

BLOCK, BUNDLE, SHARD, SLICE, MU = 2 << 20, 8, 32 << 20, 1 << 16, (80.0, 20.0)
BLOCKS = "bundle long, place int, data binary"
SENT = "bundle long, shard int, kind int, places binary, sizes binary, keys binary, counts binary"
ANSWERED = "bundle long, shard int, kind int, places binary, sizes binary, counts binary, tokens long, words long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
START_KEY, END_KEY = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Kinds of keys and the bits of each.
WORD, PAIR, TRIPLE, KEY_BITS = 1, 2, 3, {1: 64, 2: 48, 3: 48}


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = (left ^ (left >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25) + right
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


class Block:
    """Distinct words, pairs and triples of some documents, with hashes of them."""

    def __init__(self, texts: list[bytes]):
        ids: dict[bytes, int] = {}
        docs = [[ids.setdefault(w, len(ids)) for w in t.translate(LOWER).split()] for t in texts]
        self.end, self.start = len(ids), len(ids) + 1
        self.width = len(ids) + 2
        words = np.array([*map(xxhash.xxh3_64_intdigest, ids), END_KEY, START_KEY], dtype=np.uint64)
        self.lengths = np.array([len(d) + 1 for d in docs], dtype=np.int64)
        self.symbols = np.array([x for d in docs for x in (*d, self.end)], dtype=np.int64)
        self.firsts = np.cumsum(self.lengths) - self.lengths
        before = np.roll(self.symbols, 1)
        before[self.firsts] = self.start
        self.pairs, self.pair_at = np.unique(before * self.width + self.symbols, return_inverse=True)
        later = np.ones(len(self.symbols), dtype=bool)
        later[self.firsts] = False
        self.later = np.nonzero(later)[0]
        self.triples, first, self.triple_at = np.unique(self.pair_at[self.later - 1] * self.width + self.symbols[self.later], return_index=True, return_inverse=True)
        #: The pair of a triple's last two words.
        self.last_pair = self.pair_at[self.later[first]]
        pairs = _mixed(words[self.pairs // self.width], words[self.pairs % self.width])
        triples = _mixed(pairs[self.triples // self.width], words[self.triples % self.width])
        self.keys = {WORD: words, PAIR: pairs >> np.uint64(16), TRIPLE: triples >> np.uint64(16)}
        self.order = {k: np.argsort(v) for k, v in self.keys.items()}

    def counted(self, trains: np.ndarray) -> dict[int, np.ndarray]:
        """Counts in training documents by kind (the start counts once for each)."""
        weight = np.repeat(trains.astype(np.float64), self.lengths)
        counts = {
            WORD: np.bincount(self.symbols, weights=weight, minlength=self.width),
            PAIR: np.bincount(self.pair_at, weights=weight, minlength=len(self.pairs)),
            TRIPLE: np.bincount(self.triple_at, weights=weight[self.later], minlength=len(self.triples)),
        }
        counts[WORD][self.start] = trains.sum()
        return {k: v.astype(np.int64) for k, v in counts.items()}


def _to_planes(counts: np.ndarray) -> bytes:
    """Numbers byte by byte, lowest bytes first, as many as the largest needs; their number comes first."""
    wide = max(1, -(-int(counts.max(initial=0)).bit_length() // 8))
    return bytes([wide]) + counts.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8)[1:].reshape(data[0], -1)
    whole = np.zeros((planes.shape[1], 8), np.uint8)
    whole[:, : data[0]] = planes.T
    return whole.view("<i8").ravel()


def _edges(shards: int, kind: int) -> np.ndarray:
    """Where each shard's range of keys begins."""
    return np.array([(i << KEY_BITS[kind]) // shards for i in range(shards)], dtype=np.uint64)


def _fit(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _opened(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _texts(table: pa.Table) -> list[bytes]:
    return table.column("text").combine_chunks().cast(pa.binary()).to_pylist()


def _trains(table: pa.Table) -> np.ndarray:
    return np.array(table.column("trains").to_pylist(), dtype=bool)


def blocks_of(rows: DataFrame, block: int, bundle: int) -> DataFrame:
    """Blocks of rows(doc_id, text, trains) as compressed record batches, in the order of the rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def written() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            table = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
                out.write_table(table)
            data = sink.getvalue().to_pybytes()
            return pa.RecordBatch.from_pydict({"bundle": pa.array([task << 32 | number // bundle], pa.int64()), "place": pa.array([number % bundle], pa.int32()), "data": pa.array([data], pa.binary())})

        for batch in batches:
            at = 0
            sizes = np.array([len(t) for t in batch.column("text").cast(pa.binary()).to_pylist()], dtype=np.int64)
            while at < batch.num_rows:
                end = at + 1 + int(np.searchsorted(np.cumsum(sizes[at:]), block - size))
                end = min(end, batch.num_rows)
                held.append(batch.slice(at, end - at))
                size += int(sizes[at:end].sum())
                at = end
                if size >= block:
                    yield written()
                    number, held, size = number + 1, [], 0
        if held:
            yield written()

    return rows.mapInArrow(cut, BLOCKS)


def score(docs: DataFrame, is_held_out, block: int = BLOCK, mu: tuple[float, float] = MU, shard: int = SHARD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score. is_held_out: a condition on docs."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), (~is_held_out).alias("trains"))
    blocks = materialize(blocks_of(rows, block, BUNDLE))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, parts = None, {}

        def packed() -> pa.RecordBatch:
            out: dict[str, list] = {k: [] for k in ("shard", "kind", "places", "sizes", "keys", "counts")}
            for (kind, at), own in parts.items():
                places, keys, counts = zip(*own)
                columns = (at, kind, np.array(places, "<i4").tobytes(), np.array([len(k) for k in keys], "<i8").tobytes(), _to_planes(np.concatenate(keys)), _to_planes(np.concatenate(counts)))
                for name, value in zip(out, columns):
                    out[name].append(value)
            types = dict.fromkeys(out, pa.binary()) | {"shard": pa.int32(), "kind": pa.int32()}
            return pa.RecordBatch.from_pydict({"bundle": pa.array([bundle] * len(parts), pa.int64()), **{k: pa.array(v, types[k]) for k, v in out.items()}})

        for batch in batches:
            for number, place, data in zip(*(batch.column(c) for c in ("bundle", "place", "data"))):
                if number.as_py() != bundle:
                    if parts:
                        yield packed()
                    bundle, parts = number.as_py(), {}
                table = _opened(data.as_py())
                own = Block(_texts(table))
                numbers = own.counted(_trains(table))
                for kind, counts in numbers.items():
                    edges, keys = _edges(shards, kind), own.keys[kind][own.order[kind]]
                    bounds = [*np.searchsorted(keys, edges).tolist(), len(keys)]
                    counts = counts[own.order[kind]]
                    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        if a < b:
                            parts.setdefault((kind, i), []).append((place.as_py(), _fit(np.diff(keys[a:b], prepend=edges[i])), _fit(counts[a:b])))
                # freed before the next block is built
                del table, own, numbers, counts, keys
        if parts:
            yield packed()

    def answered(table: pa.Table) -> pa.Table:
        shard, kind = table.column("shard")[0].as_py(), table.column("kind")[0].as_py()
        steps = [_from_planes(k).view(np.uint64) for k in table.column("keys").to_pylist()]
        runs = np.concatenate([np.frombuffer(s, "<i8") for s in table.column("sizes").to_pylist()])
        # every run of differences starts anew from the shard's edge, which all keys leave out
        keys = np.cumsum(np.concatenate(steps))
        firsts = np.cumsum(runs) - runs
        keys -= np.repeat(np.where(firsts > 0, keys[firsts - 1], np.uint64(0)), runs)
        counts = np.concatenate([_from_planes(c) for c in table.column("counts").to_pylist()])
        keys, at = np.unique(keys, return_inverse=True)
        sums = np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)
        reply = np.split(sums[at], np.cumsum([len(s) for s in steps])[:-1])
        start = np.array([START_KEY], np.uint64) - _edges(shards, WORD)[shard]
        real = sums[keys != start] if kind == WORD else sums[:0]
        n = len(steps)
        return pa.table({
            "bundle": pa.array([*table.column("bundle").to_pylist(), -1], pa.int64()), "shard": pa.array([shard] * (n + 1), pa.int32()), "kind": pa.array([kind] * n + [0], pa.int32()),
            "places": pa.array([*table.column("places").to_pylist(), b""], pa.binary()), "sizes": pa.array([*table.column("sizes").to_pylist(), b""], pa.binary()),
            "counts": pa.array([*map(_to_planes, reply), b""], pa.binary()), "tokens": pa.array([0] * n + [int(real.sum())], pa.int64()), "words": pa.array([0] * n + [int((real > 0).sum())], pa.int64()),
        })

    answers = materialize(blocks.mapInArrow(sent, SENT).groupBy("shard", "kind").applyInArrow(answered, ANSWERED))
    tokens, distinct = answers.filter("kind = 0").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        told: dict[tuple[int, int], list[np.ndarray]] = {}
        for kind, places, sizes, counts in zip(*(right.sort_by([("kind", "ascending"), ("shard", "ascending")]).column(c).to_pylist() for c in ("kind", "places", "sizes", "counts"))):
            cuts = np.cumsum(np.frombuffer(sizes, "<i8"))[:-1]
            for place, part in zip(np.frombuffer(places, "<i4").tolist(), np.split(_from_planes(counts), cuts)):
                told.setdefault((place, kind), []).append(_fit(part))

        def of_block(place: int, data: bytes) -> pa.Table:
            table = _opened(data)
            trains = _trains(table)
            own = Block(_texts(table))
            counts = {}
            for kind, order in own.order.items():
                counts[kind] = np.zeros(len(order), np.int64)
                counts[kind][order] = np.concatenate([np.zeros(0, np.uint8), *told.pop((place, kind), [])])
            model = Automaton(own, counts, tokens, distinct, mu)
            n_known = np.add.reduceat((counts[WORD] > 0)[own.symbols].astype(np.int64), own.firsts)
            base = np.add.reduceat(np.array(model.root)[own.symbols], own.firsts)
            full = [model.traverse(a, a + n) for a, n in zip(own.firsts.tolist(), own.lengths.tolist())]
            return pa.table({"doc_id": table.column("doc_id"), "held_out": pa.array(~trains), "n_tokens": pa.array(own.lengths), "n_known": pa.array(n_known), "train_tokens": pa.array([tokens] * len(full), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(full, pa.float64())})

        # one block's automaton at a time is in memory
        return pa.concat_tables([of_block(place, data.as_py()) for place, data in zip(left.column("place").to_pylist(), left.column("data"))])

    return blocks.groupBy("bundle").cogroup(answers.filter("kind > 0").drop("tokens", "words").groupBy("bundle")).applyInArrow(scored, SCORED)


class Automaton:
    """The part of the model that a block's documents can reach.

    States are the block's counted pairs, by number, its words and the root. The arc of a pair's state for
    a word is the triple that both make, that of a word's state the pair: arcs are found by these numbers, and
    None is an arc that training documents don't have. A pair's state fails to that of its last word, a word's to the root.
    """

    def __init__(self, own: Block, counts: dict[int, np.ndarray], tokens: int, distinct: int, mu: tuple[float, float]):
        words, pairs, triples = counts[WORD], counts[PAIR], counts[TRIPLE]
        one = (words + 1) / (tokens + distinct + 1)
        before, symbol = own.pairs // own.width, own.pairs % own.width
        two = (pairs + mu[0] * one[symbol]) / (words[before] + mu[0])
        above = own.triples // own.width
        three = (triples + mu[1] * two[own.last_pair]) / (pairs[above] + mu[1])
        self.root = np.log10(one).tolist()
        self.pair_arcs, self.triple_arcs = (np.where(n > 0, np.log10(p), None).tolist() for n, p in ((pairs, two), (triples, three)))
        self.pair_fails, self.word_fails = (np.log10(m / (n + m)).tolist() for n, m in ((pairs, mu[1]), (words, mu[0])))
        triple_at = np.full(len(own.symbols), -1)
        triple_at[own.later] = own.triple_at
        self.places = own.pair_at, triple_at, before[own.pair_at], own.symbols

    def traverse(self, first: int, end: int) -> float:
        """Read the symbols at these places, from the start's state."""
        pair_arcs, triple_arcs, pair_fails, word_fails, root = self.pair_arcs, self.triple_arcs, self.pair_fails, self.word_fails, self.root
        total, state = 0.0, None  # a pair, or None at the state of the last word
        # in slices, so that a very long document isn't a list of all its symbols at once
        slices = ([x[at : min(end, at + SLICE)].tolist() for x in self.places] for at in range(first, end, SLICE))
        for pair, triple, word, symbol in chain.from_iterable(zip(*x) for x in slices):
            if state is not None:
                arc = triple_arcs[triple]
                if arc is not None:
                    total += arc
                    state = pair
                    continue
                total += pair_fails[state]
            arc = pair_arcs[pair]
            if arc is not None:
                total += arc
                state = pair
            else:
                total += word_fails[word] + root[symbol]
                state = None
        return total


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), held_out("doc_id", 7, 2))
