"""Quality rules and cross-document line frequency (operator 3, DataFrame operations only).

Rules on the text alone are computed within its row. Lines, normalised (white space folded, lower
case) and hashed, are counted per host (the source): the distinct texts that have them, so exact
copies of a document count once. A line in more than max(MOST, SHARE of the host's distinct texts)
of them is removed, and a document that keeps less than LEAST of its words is depleted.

Lines are written once, by 128-bit hashes of line and text.

Skew: lines are counted by (host, line) after partial aggregation. The removed lines, and the words that
each text loses, are written to the shared folder before they are joined back: with no aggregation between
shuffle and join, adaptive execution can split a hot line or a hot group of copies.

Defined cases: a null text has no words and fails; a null source is a host of its own; repeated rows and
copies get the same verdict; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oredock.llm.common import WHITE_CLASS, materialize, read, text_of

WORD_CLASS = r"[^\x20\x09-\x0D]"
MOST, SHARE, LEAST = 50, 0.05, 0.4
FEWEST_WORDS, REPEATED = 50, 50


def words_of(text: Column | str) -> Column:
    return F.array_remove(F.split(text, f"{WHITE_CLASS}+"), "")


def text_rules(docs: DataFrame) -> DataFrame:
    """doc_id, host, the text's hashes and the counts and base_failed of the rules on the text alone."""
    rows = docs.select("doc_id", F.xxhash64("source").alias("host"), text_of().alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(WORD_CLASS)))
    bare = F.regexp_replace("text", f"{WHITE_CLASS}+", "")
    plain = F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))
    rows = rows.select("doc_id", "host", *text_hashes("text"), words_of("text").alias("words"), lines.alias("lines"), F.length(bare).alias("word_chars"), plain.alias("n_symbols"))
    windows = F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    rows = rows.withColumn("n_dup_lines", F.size("lines") - F.size(F.array_distinct("lines"))).withColumn("windows", F.when(F.size("words") >= 3, windows).otherwise(F.array().cast("array<bigint>"))).withColumn("n_words", F.size("words")).drop("words", "lines")
    again = F.size("windows") > F.size(F.array_distinct("windows"))
    rows = rows.withColumn("sorted", F.when(again, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda k: F.get("sorted", k)["h"]
    twice = F.filter(F.transform("sorted", lambda s, k: F.when((s["h"] == at(k - 1)) | (s["h"] == at(k + 1)), s["i"])), lambda i: i.isNotNull())
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))
    rows = rows.withColumn("n_repeat_words", F.when(F.col("sorted").isNotNull(), covered).otherwise(0))
    counts = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return rows.select("doc_id", "host", "text_hash", "text_more", *counts).withColumn("base_failed", (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words")))


def lines_of(docs: DataFrame) -> DataFrame:
    """host, text_hash and, for each line with a word, line (two hashes of it) and words. A text without such lines has one row of nulls."""
    rows = docs.select(F.xxhash64("source").alias("host"), text_of().alias("text"))
    folded = F.transform(F.split("text", "\n"), lambda x: F.lower(F.trim(F.regexp_replace(x, f"{WHITE_CLASS}+", " "))))
    named = F.transform(folded, lambda x: F.struct(F.xxhash64(x).alias("one"), F.xxhash64(F.lit(1), x).alias("two"), F.when(x == "", 0).otherwise(F.size(F.split(x, " "))).alias("words")))
    found = F.filter(named, lambda s: s["words"] > 0)
    at = rows.select("host", *text_hashes("text"), F.posexplode_outer(found).alias("at", "s"))
    return at.select("host", "text_hash", "text_more", "at", F.when(F.col("s").isNotNull(), F.struct("s.one", "s.two")).alias("line"), "s.words").distinct()


def text_hashes(text: str) -> list[Column]:
    """128 bits that stand for a text: copies share them."""
    return [F.xxhash64(text).alias("text_hash"), F.xxhash64(F.lit(1), F.col(text)).alias("text_more")]


def removed_words(docs: DataFrame, most: int = MOST, share: float = SHARE) -> DataFrame:
    """(host, text_hash, text_more) and removed, the words of its lines that are too frequent at the host."""
    all_lines = materialize(lines_of(docs))
    lines = all_lines.filter("line IS NOT NULL")
    key = ["host", "text_hash", "text_more"]
    texts = all_lines.select(*key).distinct().groupBy("host").agg(F.greatest(F.lit(float(most)), share * F.count("*")).alias("most"))
    used = lines.select(*key, "line").distinct().groupBy("host", "line").agg(F.count("*").alias("texts")).filter(F.col("texts") > most)
    frequent = materialize(used.join(texts, "host").filter(F.col("texts") > F.col("most")).select("host", "line"))
    return lines.join(frequent, ["host", "line"]).groupBy(*key).agg(F.sum("words").alias("removed"))


def judge(docs: DataFrame, most: int = MOST, share: float = SHARE, least: float = LEAST) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, removed words and kept."""
    gone = materialize(removed_words(docs, most, share))
    rows = text_rules(docs).join(gone, ["host", "text_hash", "text_more"], "left").withColumn("n_removed_words", F.coalesce("removed", F.lit(0)).cast("long"))
    depleted = F.col("n_words") - F.col("n_removed_words") < F.lit(least) * F.col("n_words")
    return rows.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("host", "text_hash", "text_more", "removed")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
i AS (SELECT doc_id, host, text, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM i),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, host, text, lower(trim(regexp_replace(unnest(lines), '[\x20\x09-\x0D]+', ' ', 'g'))) AS line FROM w),
h AS (SELECT host, count(DISTINCT text) AS texts FROM d GROUP BY host),
f AS (SELECT host, line FROM l JOIN h USING (host) GROUP BY host, line, texts HAVING count(DISTINCT text) > greatest({MOST}, {SHARE} * texts)),
m AS (SELECT doc_id, sum(len(string_split(line, ' '))) AS removed FROM l JOIN f USING (host, line) GROUP BY doc_id),
b AS (SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed, 0)::BIGINT AS n_removed_words
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN m USING (doc_id)),
c AS (SELECT *, n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {REPEATED} * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND NOT n_words - n_removed_words < {LEAST} * n_words AS kept FROM c
"""
