"""Secret scans (operator 1, DataFrame operations only).

Patterns give the base spans. Besides, candidate strings (all runs of 20 or more letters, digits and
+ / _ = -) are scanned with a sliding window: the counts c of its characters and the sum of c * log2(c) are
carried from step to step, and a step only changes those of the character that leaves and of the one that
enters: a candidate costs time in proportion to its length. Windows above the threshold of the candidate's
character class (hex digits, or all of the run's characters) join into spans. Only windows that lie in
a base span or in a part of the run on the allow-list, or that have eight equal characters in a row, don't
count: what a run has besides them is found.

Each document is one row from end to end: no shuffle, so there is nothing to skew.

Defined cases: a null or empty text has no spans; offsets are code points with exclusive ends; ties of
start are ordered by kind as listed; repeated rows and null ids are scanned like others; other columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oredock.llm.common import let, read, text_of

# The patterns of the base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Parts of runs that are no secrets: placeholders, UUIDs, named digests. A part starts where no letter or digit is before it.
ALLOWED = (
    r"(?i)(?<![A-Za-z0-9])(?:(?:example|sample|dummy|placeholder|changeme|your[_-]|xxxx|0123456789|abcdefgh)[A-Za-z0-9]*"
    r"|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![A-Za-z0-9])"
    + "".join(rf"|{name}[-=_](?:[0-9a-f]{{{size}}}(?![A-Za-z0-9])|[A-Za-z0-9+/]{{1,{-(-size // 6) * 4}}}={{0,2}})" for name, size in (("sha1", 40), ("sha256", 64), ("sha384", 96), ("sha512", 128), ("md5", 32)))
    + ")"
)
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_base64"]
WINDOW, LIMITS = 20, {"entropy_hex": 2.8, "entropy_base64": 3.8}
SPANS = "array<struct<start:int,kind:int,end:int>>"
#: Code points of the first and the last character that a candidate may have; windows in a tile; units of c * log2(c).
FIRST, LAST, TILE, SCALE = ord("+"), ord("z"), 256, 1 << 32


def _places(text: Column, pattern: str, found: Column) -> Column:
    """start, end and match of each of the found matches of pattern, from the gaps between them."""

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gaps"])
        end = start + F.length(pair["match"])
        item = F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("match"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(item)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out"))
    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gaps"), found.alias("match"))
    return F.when(F.size(found) > 0, F.aggregate(pairs, zero, step)["out"]).otherwise(zero["out"])


def _windows(match: Column, most: Column, window: int) -> Column:
    """Starts within match, in order, of the windows of which the sum of c * log2(c) is at most `most` and that have no eight equal characters in a row.

    The characters go by once, in tiles that overlap by a window less one. The state is the counts of the
    window's characters, packed into a few longs, the sum, and where eight equal characters last ended.
    """
    bits = window.bit_length()
    per = 63 // bits
    longs = -(-(LAST - FIRST + 1) // per)
    terms = F.array(*[F.lit(round(c * math.log2(c) * SCALE) if c else 0).cast("long") for c in range(window + 2)])
    shift = lambda v, n: F.call_function("shiftleft", v, n)

    def coded(c: Column) -> Column:
        place = F.ascii(c) - FIRST
        return F.struct(F.floor(place / per).cast("int").alias("at"), (place % per * bits).alias("by"), shift(F.lit(1).cast("long"), place % per * bits).alias("one"))

    def alike(a: Column, b: Column) -> Column:
        return F.coalesce((a["at"] == b["at"]) & (a["by"] == b["by"]), F.lit(False))

    def of(counts: Column, c: Column) -> Column:
        return F.call_function("shiftrightunsigned", F.get(counts, c["at"]), c["by"]).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

    def term(n: Column) -> Column:
        return F.get(terms, n)

    def step(acc: Column, item: Column) -> Column:
        x, y, i = item["x"], item["y"], item["i"]  # the character that enters, the one that leaves if any, and the index of x
        leaves, enters = of(acc["counts"], y), of(acc["counts"], x) - alike(x, y).cast("int")
        total = acc["total"] + F.coalesce(term(leaves - 1) - term(leaves), F.lit(0)) + term(enters + 1) - term(enters)
        counts = F.transform(acc["counts"], lambda v, j: v + F.when(j == x["at"], x["one"]).otherwise(0) - F.when(j == y["at"], y["one"]).otherwise(0))
        equal = F.when(alike(x, item["before"]), acc["equal"] + 1).otherwise(1)
        return F.struct(counts.alias("counts"), total.cast("long").alias("total"), equal.alias("equal"), F.when(equal >= 8, i).otherwise(acc["dull"]).alias("dull"), acc["out"].alias("out"))

    def marked(acc: Column, i: Column, start: Column) -> Column:
        good = (i >= window - 1) & (acc["total"] <= most) & (acc["dull"] < i - window + 8)
        out = F.when(good, F.concat(acc["out"], F.array(start + i - window + 1))).otherwise(acc["out"])
        return F.struct(*[acc[c].alias(c) for c in ("counts", "total", "equal", "dull")], out.alias("out"))

    def scanned(codes: Column, start: Column) -> Column:
        def item(x: Column, i: Column) -> Column:
            return F.struct(x.alias("x"), F.get(codes, start + i - window).alias("y"), F.get(codes, start + i - 1).alias("before"), i.alias("i"))

        # within a tile, nothing has left or gone before its start
        inside = lambda x, i: F.struct(x.alias("x"), F.when(i >= window, item(x, i)["y"]).alias("y"), F.when(i > 0, item(x, i)["before"]).alias("before"), i.alias("i"))
        items = F.transform(F.slice(codes, start + 1, F.lit(TILE + window - 1)), inside)
        zero = F.struct(F.array_repeat(F.lit(0).cast("long"), longs).alias("counts"), F.lit(0).cast("long").alias("total"), F.lit(0).alias("equal"), F.lit(-window).alias("dull"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(items, zero, lambda acc, x: let(step(acc, x), lambda a: marked(a, x["i"], start)))["out"]

    def over(codes: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(codes) - window, F.lit(TILE)), lambda start: scanned(codes, start)))

    codes = F.transform(F.filter(F.split(match, ""), lambda c: c != ""), coded)
    return F.when(F.length(match) >= window, let(codes, over)).otherwise(F.array().cast("array<int>"))


def _joined_windows(starts: Column, window: int) -> Column:
    """(s, e) of the windows at these starts, those that touch or overlap as one."""

    def joined(m: Column) -> Column:
        first = F.filter(m, lambda v, k: F.coalesce(v - F.get(m, k - 1) > window, F.lit(True)))
        last = F.filter(m, lambda v, k: F.coalesce(F.get(m, k + 1) - v > window, F.lit(True)))
        return F.zip_with(first, last, lambda s, e: F.struct(s.alias("s"), (e + window).alias("e")))

    return let(starts, joined)


def scan(docs: DataFrame, window: int = WINDOW, limits: dict[str, float] = LIMITS, allowed: str = ALLOWED, beside_base: bool = False) -> DataFrame:
    """One row per document: doc_id and spans, an array of (start, kind: its number in KINDS, end) by start, then kind.

    Runs that a base span overlaps are scanned only with beside_base, as the query does.
    """
    rows = docs.select("doc_id", text_of().alias("text"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "run": CANDIDATE}
    rows = rows.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"{k}_found") for k, p in patterns.items()], F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)).alias("values"))
    rows = rows.select("doc_id", "values", *[_places(F.col("text"), p, F.col(f"{k}_found")).alias(k) for k, p in patterns.items()])
    long_enough = F.filter(F.arrays_zip("assign", "values"), lambda x: F.length(x["values"]) >= 8)

    def of_kind(places: Column | str, kind: int) -> Column:
        return F.transform(places, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    base = F.concat(of_kind(F.transform(long_enough, lambda x: x["assign"]), 0), of_kind("access", 1), of_kind("hex", 2))
    rows = rows.select("doc_id", "run", F.array_sort(base.cast(SPANS)).alias("base"))

    def within(places: Column, start: Column, end: Column) -> Column:
        """Those that can hold a window and overlap a run."""
        return F.filter(places, lambda q: (q["end"] - q["start"] >= window) & (q["start"] < end) & (start < q["end"]))

    def spans_of(r: Column) -> Column:
        is_hex = F.rlike(r["match"], F.lit("^([0-9a-f]+|[0-9A-F]+)$"))
        kind = F.when(is_hex, KINDS.index("entropy_hex")).otherwise(KINDS.index("entropy_base64"))
        bound = lambda k: F.lit(math.floor(((math.log2(window) - limits[k]) * window + 1e-7) * SCALE)).cast("long")
        most = F.when(is_hex, bound("entropy_hex")).otherwise(bound("entropy_base64"))
        own = lambda places: F.transform(places, lambda q: F.struct((q["start"] - r["start"]).alias("start"), (q["end"] - r["start"]).alias("end")))

        def spoken(starts: Column, quiet: Column) -> Column:
            return F.filter(starts, lambda i: ~F.exists(quiet, lambda q: (q["start"] <= i) & (i + window <= q["end"])))

        def found(starts: Column) -> Column:
            known = F.filter(_places(r["match"], allowed, F.regexp_extract_all(r["match"], F.lit(allowed), F.lit(0))), lambda q: q["end"] - q["start"] >= window)
            quiet = F.concat(own(within(F.col("base"), r["start"], r["end"])), F.transform(known, lambda q: F.struct(q["start"].alias("start"), q["end"].alias("end"))))
            spans = _joined_windows(let(quiet, lambda q: spoken(starts, q)), window)
            return let(kind, lambda k: F.transform(spans, lambda s: F.struct((r["start"] + s["s"]).alias("start"), k.alias("kind"), (r["start"] + s["e"]).alias("end")))).cast(SPANS)

        starts = let(most, lambda bound: _windows(r["match"], bound, window))
        return let(starts, lambda m: F.when(F.size(m) > 0, found(m)).otherwise(F.array().cast(SPANS)))

    run = F.col("run") if beside_base else F.filter("run", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    more = F.when(F.size("run") > 0, F.flatten(F.transform(run, spans_of))).otherwise(F.array().cast(SPANS))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def _joined(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"), beside_base=True)

    def count_of(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    counts = [count_of(k) for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
