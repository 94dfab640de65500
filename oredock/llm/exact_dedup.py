"""Exact deduplication by deterministic block naming (operator 7, DataFrame operations only).

A text, without white space, is cut into blocks of fixed size, which are written once to the shared
folder. Equal blocks get one integer name: the distinct blocks, found with partial aggregation, are
sorted and numbered. Then adjacent names are named in pairs, in the same way, until every document has
a single name.

Names are joined back by a 64-bit hash instead of by whole blocks. The hash decides nothing: values that
share a hash with another value are found when names are given, and are joined by value.

Skew: only distinct values are sorted, so a value costs as much as any other however often it occurs.
Joins are between written tables, so adaptive execution can split a hot name; nothing is broadcast
but what Spark itself finds small.

Defined cases: a null text counts as empty; empty texts are equal to each other; null ids are kept
and lose ties; repeated rows count one by one, and one of them stays; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oredock.llm.common import materialize, read, text_of

BLOCK = 2048


def code_of(value: str) -> Column:
    return F.xxhash64(value)


def name_values(rows: DataFrame, value: str) -> DataFrame:
    """rows, a written table with `value` and its `code`, with an integer `name` for it: equal values, and only they, share one."""
    numbered = rows.select("code", value).distinct().sortWithinPartitions(value).withColumn("name", F.monotonically_increasing_id())
    names = materialize(numbered.select("code", "name"))
    plain = rows.drop(value)
    shared = names.groupBy("code").count().filter("count > 1").select("code")
    if shared.isEmpty():
        return plain.join(names, "code").drop("code")
    shared = materialize(shared)
    mixed = rows.join(shared, "code", "left_semi")
    own = materialize(mixed.select(value).distinct().withColumn("name", -1 - F.monotonically_increasing_id()))
    return plain.join(shared, "code", "left_anti").join(names, "code").drop("code").unionByName(mixed.drop("code").join(own, value).drop(value))


def _arrays(named: DataFrame) -> DataFrame:
    """Per row its names in order."""
    return named.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("at", "name")))["name"].alias("names"))


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """rid (a number for each row), doc_id, n_chars, text_sha256, n_blocks and the final name."""
    bare = F.translate(text_of(), " \t\n\x0b\x0c\r", "")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.length(text_of()).cast("long").alias("n_chars"), bare.alias("bare"))
    cut = F.when(F.length("bare") <= block, F.array("bare")).otherwise(F.regexp_extract_all("bare", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
    rows = rows.select("rid", "doc_id", "n_chars", F.sha2("bare", 256).alias("sha"), F.posexplode(cut).alias("at", "block"))
    first = F.col("at") == 0
    rows = rows.select("rid", F.when(first, F.struct("doc_id", "n_chars", F.unhex("sha").alias("sha"))).alias("row"), "at", "block", code_of("block").alias("code"))
    blocks = materialize(rows)
    level = materialize(_arrays(name_values(blocks.drop("row"), "block")).withColumn("n_blocks", F.size("names")))
    done = level.filter("n_blocks = 1").select("rid", "n_blocks", F.get("names", F.lit(0)).alias("name"))
    size = level.agg(F.max("n_blocks")).first()[0] or 1
    sizes, level = level.select("rid", "n_blocks"), level.select("rid", "names")
    while size > 1:
        places = F.sequence(F.lit(0), ((F.size("names") - 1) / 2).cast("int"))
        pair = F.transform(places, lambda i: F.struct(F.get("names", 2 * i).alias("a"), F.get("names", 2 * i + 1).alias("b")))
        pairs = level.filter(F.size("names") > 1).select("rid", F.posexplode(pair).alias("at", "pair")).withColumn("code", code_of("pair"))
        level = materialize(_arrays(name_values(materialize(pairs), "pair")))
        whole = level.filter(F.size("names") == 1).select("rid", F.get("names", F.lit(0)).alias("name"))
        done = done.unionByName(whole.join(sizes, "rid").select("rid", "n_blocks", "name"))
        size = (size + 1) // 2
    heads = blocks.filter("at = 0").select("rid", "row.*")
    return heads.join(done, "rid").select("rid", "doc_id", "n_chars", F.lower(F.hex("sha")).alias("text_sha256"), "n_blocks", "name")


def exact_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (see the module's text)."""
    named = materialize(identities(docs, block))
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "rid"))
    groups = materialize(named.groupBy("n_blocks", "name").agg(best.alias("best"), F.count("*").alias("group_size")))
    rows = named.join(groups, ["n_blocks", "name"])
    return rows.select("doc_id", F.col("best.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
w AS (SELECT doc_id, bare, count(*) OVER (PARTITION BY bare) AS group_size, first_value(doc_id) OVER (PARTITION BY bare ORDER BY n DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM w
"""
