"""Mixing sources to target weights by Poisson replication (operator 9, DataFrame operations only).

Each source gets a mean repetition rate, so that its expected share of all characters is its target
weight. A document's number of copies is drawn by inverting the Poisson distribution with that mean
at a number in [0, 1) that a hash of seed and doc_id gives; then every copy gets a shuffle key from a
hash, copies are dealt out by it and sorted by it. No draw depends on order or place of the rows, so
a lost task gives the same rows again.

Rates above 32 are split into equal parts with one draw each (a sum of Poisson draws is one), which
keeps the tabulated distribution short and exact.

Sources without a weight of their own, null included, share the weight OTHER as one pool, so the
table of rates has one row for each weight and one more: its broadcast is bounded by the parameter.

Defined cases: a null or empty text has no characters; a null doc_id draws like the text "null";
repeated rows draw alike; a source of weight zero disappears; a source without characters gets rate 0.
Columns of the input named copy, copies or shuffle_key are replaced; any other rides along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oredock.llm.common import fold, materialize, read, text_of

OTHER, PART = "*", 32.0
#: Production weights: three times as much of the first five sources as of others.
WEIGHTS = {**{f"src{i}": 3.0 for i in range(5)}, **{f"src{i}": 1.0 for i in range(5, 20)}, OTHER: 1.0}
SEED = "mix-1"


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the md5 of the joined parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float], growth: float = 1.0) -> DataFrame:
    """Per weighted source: chars, rate (mean copies), draws and cdf (of one draw, to where it is 1)."""
    names = [k for k in weights if k != OTHER]
    pool = F.when(F.col("source").isin(names), F.col("source")).otherwise(OTHER)
    weight = F.element_at(F.create_map(*[F.lit(x) for k, v in ({OTHER: 0.0} | weights).items() for x in (k, float(v))]), F.col("pool"))
    sizes = docs.select(pool.alias("pool"), F.length(text_of()).cast("long").alias("n")).groupBy("pool").agg(F.sum("n").alias("chars"))
    sizes = sizes.withColumn("weight", weight)
    whole = sizes.agg(F.sum("chars").alias("all_chars"), F.sum(F.when(F.col("chars") > 0, F.col("weight"))).alias("all_weight"))
    rated = sizes.crossJoin(F.broadcast(whole)).select("pool", "chars", F.coalesce(F.lit(float(growth)) * F.col("all_chars") * F.col("weight") / F.col("all_weight") / F.col("chars"), F.lit(0.0)).alias("rate"))
    mean = F.col("rate") / F.col("draws")
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    first = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, j: Column) -> Column:
        p = acc["p"] * mean / j
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["cdf"], F.array(acc["c"] + p)).alias("cdf"))

    drawn = rated.withColumn("draws", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int"))
    return drawn.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), last), first, step)["cdf"])


def mix(docs: DataFrame, weights: dict[str, float] = WEIGHTS, seed: str = SEED, growth: float = 1.0) -> DataFrame:
    """The columns of docs, one row per copy, with copies, copy (from 1) and shuffle_key; order by shuffle_key."""
    names = [k for k in weights if k != OTHER]
    plain, unfold = fold(docs, "doc_id", "text", "source")
    table = materialize(rates(plain, weights, growth).select("pool", "rate", "draws", "cdf"))  # a row for each weight and one more
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    draws = F.transform(F.sequence(F.lit(1), F.col("draws")), lambda i: uniform(F.lit(seed), own, i.cast("string")))
    drawn = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter("cdf", lambda c: c <= u)))
    pool = F.when(F.col("source").isin(names), F.col("source")).otherwise(OTHER)
    rows = plain.withColumn("pool", pool).join(F.broadcast(table), "pool").withColumn("copies", drawn.cast("long")).filter("copies > 0")
    first, last = F.lit(1).cast("long"), F.col("copies")
    if (table.agg(F.max("rate")).first()[0] or 0) > PART:
        # a small source of a large weight: its rows are dealt out before they multiply, a few copies at a time
        rows = rows.withColumn("from", F.explode(F.sequence(first, last, F.lit(int(PART)).cast("long")))).repartition(F.xxhash64("doc_id", "text", "from"))
        first, last = F.col("from"), F.least(last, F.col("from") + int(PART) - 1)
    rows = rows.withColumn("copy", F.explode(F.sequence(first, last)))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), own, F.col("copy").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
    rows = rows.select(*plain.columns, "copies", "copy", key.alias("shuffle_key")).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return unfold(rows, {c: F.col(c) for c in ("copies", "copy", "shuffle_key")})


def op9_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


SQL = f"""
WITH w(pool, weight) AS (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in WEIGHTS.items())}),
d AS (SELECT *, coalesce((SELECT pool FROM w WHERE w.pool = source AND w.pool <> '{OTHER}'), '{OTHER}') AS pool FROM documents),
s AS (SELECT pool, sum(length(coalesce(text, '')))::DOUBLE AS chars FROM d GROUP BY pool),
r AS (SELECT s.pool, coalesce(sum(chars) OVER () * weight / (sum(CASE WHEN chars > 0 THEN weight END) OVER ()) / nullif(chars, 0), 0) AS rate FROM s JOIN w USING (pool)),
p AS (SELECT pool, greatest(ceil(rate / {PART}), 1)::INT AS draws, rate / greatest(ceil(rate / {PART}), 1) AS mean FROM r),
c AS (SELECT pool, draws, list_transform(range(0, ceil(mean + 12 * sqrt(mean) + 24)::INT + 1), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(j * ln(greatest(mean, 1e-300)) - mean - lgamma(j + 1))))) AS cdf FROM p),
e AS (SELECT d.*, list_sum(list_transform(range(1, draws + 1), lambda i: len(list_filter(cdf, lambda x: x <= ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || i), 1, 13))::BIGINT / 4503599627370496.0)))) AS copies FROM d JOIN c USING (pool)),
x AS (SELECT e.*, unnest(range(1, copies::BIGINT + 1)) AS copy FROM e WHERE copies > 0)
SELECT doc_id, text, lang, source, n_chars, copies::BIGINT AS copies, copy, ('0x' || substr(md5('{SEED}|order|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy), 1, 15))::BIGINT AS shuffle_key FROM x
"""
