"""Quality classifier: a sparse rule ensemble compiled into column expressions (operator 2).

1. Statistics of whole texts, all numbers that don't depend on other documents.
2. A random forest of shallow trees is fitted on labelled rows; every path from a root to a node is a
   conjunctive rule over the statistics.
3. Logistic regression with lasso weights on the rules (and on nothing else) keeps few of them.
4. The rules with weight become one Spark column expression, which scores all documents.

Labelled rows: those of a bounded sample (SAMPLE rows at most in expectation, the ids of which have the
smallest hashes) whose crc32(doc_id) mod 5 is not 0. Only the fit is bounded; scores cover every row.
Labels, lang, source and doc_id are never statistics.

Defined cases: null and empty texts have all statistics 0 and get a score; labels that are null or
repeated with different values are averaged and rounded; without labels of both classes the score is
the share of label 1 (1 where there are no labels); repeated rows and null ids are scored like any other;
other columns ride along, but for held_out, score and predicted, which are replaced.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oredock.llm.common import fold, held_out, materialize, read, text_of

SAMPLE, TREES, DEPTH, LASSO, CUT = 20_000, 24, 3, 0.001, 0.3
STATS = ["words", "chars_per_word", "symbols", "upper", "digits", "marks", "bars", "ends", "distinct_words", "same_as_last", "words_per_line", "distinct_lines", "wide", "long_words"]


def statistics(text: bytes) -> list[float]:
    """The numbers of STATS for one text, shares of its bytes, words or lines."""
    words = text.split()
    if not words:
        return [0.0] * len(STATS)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n, size = len(words), len(text)
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    same = sum(a == b for a, b in zip(words, words[1:]))
    total = sum(map(len, words))
    return [
        float(n), total / n, float(seen[list(b"#*$%&<>@~^")].sum()) / size, upper / max(1, upper + lower), float(seen[48:58].sum()) / size,
        float(seen[list(b"!?")].sum()) / n, float(seen[124]) / n, float(seen[46]) / n, len(set(words)) / n, same / n,
        n / max(1, len(lines)), len(set(lines)) / max(1, len(lines)), float(seen[128:].sum()) / size, sum(len(w) > 25 for w in words) / n,
    ]


@F.arrow_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATS]))
def statistics_of(texts: pa.Array) -> pa.Array:
    table = np.array([statistics(t) for t in texts.cast(pa.binary()).to_pylist()], dtype=float).reshape(-1, len(STATS))
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in table.T], STATS)


def rules_of(forest_text: str) -> list[tuple[tuple[str, str, float], ...]]:
    """Conjunctions (statistic, operator, bound), one for each path from a root to a node, distinct and sorted."""
    rules, path = set(), []
    for line in forest_text.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)", line)
        if re.match(r"\s*Tree \d+", line):
            path = []
        if m:
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, (STATS[int(m[2])], m[3], float(m[4])))]
            rules.add(tuple(sorted({p[1] for p in path})))
    return sorted(rules)


def as_column(rule: tuple[tuple[str, str, float], ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(s) <= v if op == "<=" else F.col(s) > v for s, op, v in rule])


class RuleModel:
    """An intercept and weighted rules."""

    def __init__(self, intercept: float, weights: list[tuple[tuple[tuple[str, str, float], ...], float]]):
        self.intercept, self.weights = intercept, weights

    def score(self) -> Column:
        """The probability of label 1 as an expression over the columns STATS."""
        linear = reduce(lambda a, b: a + b, [F.when(as_column(r), w).otherwise(0.0) for r, w in self.weights], F.lit(self.intercept))
        return 1.0 / (1.0 + F.exp(-linear))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleModel:
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.round(F.avg("quality")).alias("label")).filter(~held_out("doc_id", 5, 0))
    code = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    marks = materialize(marks.withColumn("code", code))
    share = min(1.0, sample / max(1, marks.count()))
    limit = int(share * (1 << 30))
    chosen = marks.filter(F.col("code") < limit).select("doc_id", "label")
    # the sample bounds the broadcast, so whole texts aren't shuffled
    rows = docs.filter(code < limit).select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("label", statistics_of("text").alias("s")).select("label", "s.*")
    rows = materialize(VectorAssembler(inputCols=STATS, outputCol="features").transform(rows).select("label", *STATS, "features"))
    n, ones = rows.agg(F.count("label"), F.sum("label")).first()
    if not n or ones in (0, n):
        return RuleModel(40.0 if not n or ones else -40.0, [])
    forest = RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="onethird", seed=7).fit(rows)
    rules = rules_of(forest.toDebugString)
    if not rules:
        return RuleModel(float(np.log(ones / (n - ones))), [])
    names = [f"r{i}" for i in range(len(rules))]
    held = rows.select("label", *[as_column(r).cast("double").alias(c) for c, r in zip(names, rules)])
    held = materialize(VectorAssembler(inputCols=names, outputCol="x").transform(held).select("label", "x"))
    line = LogisticRegression(labelCol="label", featuresCol="x", elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=True).fit(held)
    return RuleModel(float(line.intercept), [(r, float(w)) for r, w in zip(rules, line.coefficients.toArray()) if w])


def scored(docs: DataFrame, model: RuleModel, cut: float = CUT) -> DataFrame:
    """The columns of docs, held_out, score and predicted."""
    folded, unfold = fold(docs, "doc_id", "text")
    inner = RuleModel(model.intercept, [(tuple((f"s.{s}", op, v) for s, op, v in r), w) for r, w in model.weights])
    rows = folded.withColumn("s", statistics_of(text_of())).withColumn("score", inner.score())
    return unfold(rows, {"held_out": held_out("doc_id", 5, 0), "score": F.col("score"), "predicted": (F.col("score") >= cut).cast("int")})


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", "held_out", "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The columns of docs, without the documents that the classifier rejects."""
    folded, unfold = fold(docs, "doc_id", "text")
    return unfold(scored(folded, fit(docs, labels), cut).filter("predicted = 1"), {})
