"""License scans (operator 6, DataFrame operations only).

Candidates of a file are its lines, its blocks (runs of lines that aren't blank, with a cut where comment
marks begin or end: headers, wrapped or not) and its whole text (licence files). The sparse TF-IDF vector of
each is compared with the templates' by cosine: weights are (1 + log tf) * idf, with document frequencies of
the templates' terms over all files; any other term weighs as much as a term of no file. A file's own license
is its best candidate's best template of at least LEAST. A file of which licensed text makes up at
least FILE_SHARE of its words is a licence file of its directory. A file without a license of its own
inherits that of the licence file in the nearest directory above it.

Templates are notices and the full texts in the folder templates. Only candidates that can reach LEAST are
expanded into terms: of each template, `needed` takes the heaviest terms until what is left has a norm
below LEAST, so (by the Cauchy-Schwarz inequality) a candidate without any of them can't reach it. Nothing is lost.

Vectors are joined on terms, which come from the templates alone: the broadcast table has a row for each
(template, term) of a fixed list, and document frequencies have at most one row for each of its terms.
Directories, not files, are joined with their ancestors; each ancestor has one licence at most, so the
result of the path join is bounded by directories times depth, and no directory gathers its files. The
root, which is above all, is no key of that join.

Defined cases: a null text is empty; a null path is a file in the root without ancestors; ties go to the
higher cosine, then the first line, then block before file before line, then the template's name; licence files
of one directory tie by cosine, then the smallest doc_id; repeated rows are scanned alike; null ids are
kept; other columns are ignored.
"""

from __future__ import annotations

from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oredock.llm.common import let, materialize, read, text_of

# Usual one-line notices of public licenses.
NOTICES = {
    "AGPL-3.0": "this work is licensed under the gnu affero general public license version 3",
    "Apache-2.0": "licensed under the apache license version 2.0",
    "BSD-3-Clause": "redistribution and use in source and binary forms with or without modification are permitted under the bsd 3 clause license",
    "CC-BY-4.0": "licensed under cc by 4.0",
    "CC-BY-NC-4.0": "licensed under cc by nc 4.0",
    "CC-BY-SA-4.0": "licensed under cc by sa 4.0",
    "CC0-1.0": "released into the public domain under cc0 1.0 universal license",
    "GPL-2.0": "this work is licensed under the gnu general public license version 2",
    "GPL-3.0": "this work is licensed under the gnu general public license version 3",
    "ISC": "released under the isc license",
    "LGPL-3.0": "this work is licensed under the gnu lesser general public license version 3",
    "MIT": "released under the mit license",
    "MPL-2.0": "this source code form is subject to the terms of the mozilla public license version 2.0",
}
LEAST, FILE_SHARE = 0.7, 0.3
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
#: How lines of comments begin.
COMMENT = r"^[\x20\t]*(#|//|/\*|\*|;|--|%|<!--)"
PARTS = ["block", "file", "line"]


@cache
def templates() -> tuple[tuple[str, str, str], ...]:
    """(template, license, text): the notices, their short tags, and the texts of the folder templates."""
    files = {p.stem: p.read_text(encoding="utf-8") for p in sorted(Path(__file__).with_name("templates").glob("*.txt"))}
    names = sorted({*NOTICES, *(n.partition("_")[0] for n in files)})
    tags = {f"{n}_tag": f"spdx license identifier {n}" for n in names}
    found = {**{f"{n}_notice": t for n, t in NOTICES.items()}, **tags, **files}
    return tuple((k, k.partition("_")[0], found[k]) for k in sorted(found))


def terms_of(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _weight(tf: Column) -> Column:
    return 1.0 + F.log(tf.cast("double"))


def vectors(files: DataFrame, chosen: tuple[tuple[str, str, str], ...]) -> tuple[DataFrame, DataFrame, float]:
    """(template, license, term, w, size), (term, idf) and the idf of any other term, from the document frequencies over files."""
    spark = files.sparkSession
    given = spark.createDataFrame(list(chosen), "template string, license string, text string")
    counts = given.select("template", "license", F.explode(terms_of("text")).alias("term")).groupBy("template", "license", "term").agg(_weight(F.count("*")).alias("tf"))
    counts = materialize(counts)
    listed = counts.select("term").distinct()
    seen = files.select(F.explode(F.array_distinct(terms_of("text"))).alias("term")).join(F.broadcast(listed), "term").groupBy("term").count()
    n = files.count()
    idf = materialize(listed.join(seen, "term", "left").select("term", (1.0 + F.log((1.0 + n) / (1.0 + F.coalesce("count", F.lit(0))))).alias("idf")))
    known = materialize(counts.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf")))
    sizes = known.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    sized = known.join(F.broadcast(sizes), "template")
    other = files.sparkSession.range(1).select(1.0 + F.log(F.lit(1.0 + n))).first()[0]
    return materialize(sized.select("template", "license", "term", "w", "size")), idf, other


def needed(known: DataFrame, least: float) -> list[str]:
    """Terms of which a candidate must have one to reach `least`: of each template the heaviest, until the others' norm is below it."""
    found, left = set(), {}
    for r in known.orderBy(F.desc("w"), "term").collect():  # at most the terms of the templates
        before = left.get(r["template"], 0.0)
        if before <= 1 - least * least + 1e-6:
            found.add(r["term"])
        left[r["template"]] = before + (r["w"] / r["size"]) ** 2
    return sorted(found)


def blocks_of(lines: Column) -> Column:
    """(line, content) of each block: a maximal run of lines that aren't blank and all are, or all aren't, comments."""

    def kind(x: Column) -> Column:
        return F.when(F.rlike(x, F.lit(r"^[\x20\x09-\x0D]*$")), 0).when(F.rlike(x, F.lit(COMMENT)), 2).otherwise(1)

    def bounds(kinds: Column, step: int) -> Column:
        """Places where a block begins (step -1) or ends (step 1)."""
        places = F.sequence(F.lit(0), F.size(kinds) - 1)
        return F.filter(places, lambda i: (F.get(kinds, i) > 0) & (F.coalesce(F.get(kinds, i + step), F.lit(0)) != F.get(kinds, i)))

    def cut(all_lines: Column, kinds: Column) -> Column:
        return F.zip_with(bounds(kinds, -1), bounds(kinds, 1), lambda s, e: F.struct(s.alias("line"), F.array_join(F.slice(all_lines, s + 1, e - s + 1), "\n").alias("content")))

    return let(lines, lambda x: let(F.transform(x, kind), lambda kinds: cut(x, kinds)))


def candidates(files: DataFrame, must: list[str]) -> DataFrame:
    """doc_id, path, text_hash, n_terms, line, part and terms of each candidate that has one of the terms in `must`."""
    anchors = F.array(*map(F.lit, must)).cast("array<string>")
    whole = files.withColumn("terms", terms_of("text")).filter(F.arrays_overlap("terms", anchors))
    whole = whole.select("doc_id", "path", F.xxhash64("text").alias("text_hash"), F.size("terms").alias("n_terms"), "text", F.split("text", "\n").alias("lines"))
    lines = F.transform("lines", lambda x, i: F.struct(i.alias("line"), x.alias("content")))
    named = lambda part, found: F.transform(found, lambda x: F.struct(x["line"].alias("line"), F.lit(part).alias("part"), x["content"].alias("content")))
    all_parts = F.concat(named("block", blocks_of(F.col("lines"))), named("file", F.array(F.struct(F.lit(0).alias("line"), F.col("text").alias("content")))), named("line", lines))
    key = ["doc_id", "path", "text_hash", "n_terms"]
    rows = whole.select(*key, F.explode(all_parts).alias("x")).select(*key, "x.line", "x.part", terms_of("x.content").alias("terms"))
    return rows.filter(F.arrays_overlap("terms", anchors)).dropDuplicates(["doc_id", "path", "text_hash", "line", "part"])


def own_licenses(docs: DataFrame, chosen: tuple[tuple[str, str, str], ...] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, path, text_hash, license, cosine, line (from 0), part and licensed_share, for files with a license of their own; written once."""
    files = docs.select("doc_id", "path", text_of().alias("text"))
    known, idf, other = vectors(files, chosen or templates())
    key = ["doc_id", "path", "text_hash", "n_terms", "line", "part", "width"]
    terms = candidates(files, needed(known, least)).withColumn("width", F.size("terms")).select(*key, F.explode("terms").alias("term"))
    counted = terms.groupBy(*key, "term").agg(_weight(F.count("*")).alias("tf"))
    weighed = counted.join(F.broadcast(idf), "term", "left").withColumn("v", F.col("tf") * F.coalesce("idf", F.lit(other)))
    sizes = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"), F.collect_list(F.struct("term", "v")).alias("vector"))
    hits = sizes.withColumn("x", F.explode("vector")).select(*key, "length", "x.term", "x.v").join(F.broadcast(known), "term").groupBy(*key, "length", "license", "template", "size").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    scored = hits.withColumn("cosine", F.round(F.col("dot") / (F.col("length") * F.col("size")), 9)).filter(F.col("cosine") >= least)
    best = scored.groupBy(*key).agg(F.min(F.struct((-F.col("cosine")).alias("less"), "template", "license")).alias("b"))
    licensed = lambda part: F.coalesce(F.sum(F.when(F.col("part") == part, F.col("width"))), F.lit(0))
    ours = best.groupBy("doc_id", "path", "text_hash", "n_terms").agg(F.min(F.struct("b.less", "line", "part", "b.template", "b.license")).alias("b"), F.greatest(*map(licensed, PARTS)).alias("licensed"))
    return materialize(ours.select("doc_id", "path", "text_hash", F.col("b.license").alias("license"), (-F.col("b.less")).alias("cosine"), "b.line", "b.part", (F.col("licensed") / F.col("n_terms")).alias("licensed_share")))


def directory(path: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(path, F.lit("")), r"/?[^/]*$", "")


def inherit(docs: DataFrame, own: DataFrame, file_share: float = FILE_SHARE) -> DataFrame:
    """One row per file: doc_id, path, license, cosine, line, part, inherited_from and final_license."""
    holders = own.filter(F.col("licensed_share") >= file_share).groupBy(directory("path").alias("above")).agg(F.min(F.struct((-F.col("cosine")).alias("less"), F.col("doc_id").alias("id"), "license")).alias("b"))
    holders = materialize(holders.select("above", F.col("b.license").alias("license")))
    root = holders.filter("above = ''").first()  # one row at most
    places = docs.select(directory("path").alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    ups = places.filter("dir <> ''").select("dir", F.posexplode(above).alias("depth", "above"))
    # written before it is joined, so that adaptive execution can split the files of a hot directory
    nearest = materialize(ups.join(holders, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "license")).alias("n")))
    rows = docs.select("doc_id", "path", F.xxhash64(text_of()).alias("text_hash"), directory("path").alias("dir"))
    mine = own.select(F.col("doc_id").alias("own_id"), F.col("path").alias("own_path"), "text_hash", "license", "cosine", "line", "part")
    same = rows["doc_id"].eqNullSafe(mine["own_id"]) & rows["path"].eqNullSafe(mine["own_path"]) & (rows["text_hash"] == mine["text_hash"])
    joined = rows.join(mine, same, "left").drop(mine["text_hash"]).join(nearest, "dir", "left")
    nearest_above = F.coalesce(F.col("n.above"), F.lit("" if root else None).cast("string"))
    inherited = F.coalesce(F.col("n.license"), F.lit(root["license"] if root else None).cast("string"))
    return joined.select("doc_id", "path", "license", "cosine", "line", "part", F.when(F.col("license").isNull(), nearest_above).alias("inherited_from"), F.coalesce("license", inherited).alias("final_license"))


def with_paths(docs: DataFrame) -> DataFrame:
    """The documents as files: source/lang/thousands of the id/id.txt."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in ("source", "lang")]
    return docs.select("doc_id", "text", F.concat_ws("/", *parts, F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt"))).alias("path"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = with_paths(read(spark, sf_dir, "documents"))
    return inherit(files, own_licenses(files))


def _values() -> str:
    quoted = [tuple(x.replace("'", "''") for x in row) for row in templates()]
    return ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in quoted)


SQL = rf"""
WITH t(template, license, notice) AS (VALUES {_values()}),
tt AS (SELECT template, license, term, 1 + ln(count(*)) AS tf FROM (SELECT template, license, unnest(regexp_extract_all(lower(notice), '{TERM}')) AS term FROM t) GROUP BY ALL),
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || (doc_id // 1000) || '/' || doc_id || '.txt' AS path FROM documents),
n AS (SELECT count(*) AS files FROM d),
w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '{TERM}') AS terms FROM d),
s AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(terms) AS term FROM w) WHERE term IN (SELECT term FROM tt) GROUP BY term),
i AS (SELECT term, 1 + ln((1.0 + files) / (1.0 + coalesce(df, 0))) AS idf FROM (SELECT DISTINCT term FROM tt) LEFT JOIN s USING (term), n),
k AS (SELECT template, license, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS size FROM tt JOIN i USING (term)),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM d),
y AS (SELECT *, CASE WHEN regexp_matches(content, '^[\x20\x09-\x0D]*$') THEN 0 WHEN regexp_matches(content, '{COMMENT}') THEN 2 ELSE 1 END AS kind FROM l),
g AS (SELECT *, CASE WHEN kind > 0 AND kind <> coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY line), 0) THEN 1 ELSE 0 END AS first FROM y),
q AS (SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY line) AS block FROM g),
a AS (SELECT doc_id, min(line) AS line, 'block' AS part, string_agg(content, chr(10) ORDER BY line) AS content FROM q WHERE kind > 0 GROUP BY doc_id, block
  UNION ALL SELECT doc_id, 0, 'file', text FROM d UNION ALL SELECT doc_id, line, 'line', content FROM l),
m AS (SELECT doc_id, line, part, regexp_extract_all(lower(content), '{TERM}') AS terms FROM a),
c AS (SELECT doc_id, line, part, len(terms) AS width, term, 1 + ln(count(*)) AS tf FROM (SELECT *, unnest(terms) AS term FROM m) GROUP BY ALL),
v AS (SELECT c.*, tf * coalesce(idf, 1 + ln(1.0 + files)) AS v FROM c LEFT JOIN i USING (term), n),
z AS (SELECT doc_id, line, part, sqrt(sum(v * v)) AS length FROM v GROUP BY ALL),
x AS (SELECT doc_id, line, part, width, template, license, sum(v * w) AS dot, any_value(size) AS size FROM v JOIN k USING (term) GROUP BY ALL),
h AS (SELECT x.*, round(dot / (length * size), 9) AS cosine FROM x JOIN z USING (doc_id, line, part)),
b AS (SELECT * FROM h WHERE cosine >= {LEAST} QUALIFY row_number() OVER (PARTITION BY doc_id, line, part ORDER BY cosine DESC, template) = 1),
e AS (SELECT doc_id, max(licensed) AS licensed FROM (SELECT doc_id, part, sum(width) AS licensed FROM b GROUP BY ALL) GROUP BY doc_id),
o AS (SELECT doc_id, license, cosine, line, part, licensed / len(terms) AS licensed_share FROM b JOIN e USING (doc_id) JOIN w USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, line, part, template) = 1),
p AS (SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, license, cosine, line, part, licensed_share FROM d LEFT JOIN o USING (doc_id)),
f AS (SELECT dir AS above, license AS holder FROM p WHERE licensed_share >= {FILE_SHARE} QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, doc_id, license) = 1),
u AS (SELECT dir, above, holder FROM (SELECT DISTINCT dir FROM p) JOIN f ON above = '' OR dir = above OR starts_with(dir, above || '/') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(above) DESC) = 1)
SELECT doc_id, path, license, cosine, line::INT AS line, part, CASE WHEN license IS NULL THEN above END AS inherited_from, coalesce(license, holder) AS final_license FROM p LEFT JOIN u USING (dir)
"""
