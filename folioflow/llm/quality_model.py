"""Quality classifier: a sparse ensemble of rules, compiled to Spark columns.

Shallow boosted trees are grown on text statistics; every path from a root to a node becomes a conjunction of thresholds; a
logistic regression with an L1 penalty weighs the conjunctions, and those of weight 0 are forgotten. What is left is one Spark
expression: the sigmoid of a sum of CASE terms, which runs inside whole-stage code generation over any number of documents.

Cases: null and empty texts have all statistics 0 and get a score like any other; with labels of one kind only (or none) the score
is that kind's smoothed share everywhere; repeated rows get equal scores, and ties on a threshold go to its lower side; a text of any
length is measured whole; an empty table gives no rows; only the named key and text columns are read, and the key may have any name
but that of a statistic.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the statistics of each whole text, all double."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    wide = docs.select(F.col(f"`{key}`").alias("key"), t.alias("t")).withColumns({
        "w": F.filter(F.split("t", SPACE + "+"), lambda x: x != ""),
        "l": F.filter(F.split("t", "\n"), lambda x: x != ""),
        "n": F.length("t").cast("double"),
        "sym": F.regexp_count("t", F.lit(r"[#*$%&|<>!]")).cast("double"),
        "up": F.regexp_count("t", F.lit(r"\p{Lu}+")).cast("double"),
        "no_upper": F.length(F.regexp_replace("t", r"\p{Lu}+", "")).cast("double"),
        "stops": F.regexp_count("t", F.lit(r"[.?;:]")).cast("double"),
        "digits": F.regexp_count("t", F.lit(r"[0-9]")).cast("double"),
    })
    wide = wide.withColumns({"nw": F.size("w").cast("double"), "nl": F.size("l").cast("double"), "uw": F.size(F.array_distinct("w")).cast("double"), "ul": F.size(F.array_distinct("l")).cast("double")})
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = F.col
    return wide.select(
        F.col("key").alias(key),
        F.log1p("n").alias("log_chars"), F.log1p("nw").alias("log_words"), share(c("n"), c("nw")).alias("chars_per_word"), share(c("sym"), c("nw")).alias("symbols_per_word"),
        share(c("n") - c("no_upper"), c("n")).alias("upper_share"), share(c("up"), c("nw")).alias("capitals_per_word"), share(c("stops"), c("nw")).alias("stops_per_word"), share(c("digits"), c("n")).alias("digit_share"),
        share(c("uw"), c("nw")).alias("distinct_words"), share(c("ul"), c("nl")).alias("distinct_lines"), share(c("nw"), c("nl")).alias("words_per_line"), F.log1p("uw").alias("log_distinct_words"),
    )


STATISTICS = ("log_chars", "log_words", "chars_per_word", "symbols_per_word", "upper_share", "capitals_per_word", "stops_per_word", "digit_share", "distinct_words", "distinct_lines", "words_per_line", "log_distinct_words")


@dataclass(frozen=True)
class RuleModel:
    """Conjunctions of (statistic, above, threshold) with their weights."""

    intercept: float
    rules: tuple[tuple[tuple[tuple[str, bool, float], ...], float], ...]

    def score(self) -> Column:
        """The probability of label 1 as an expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(condition(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def condition(rule: tuple[tuple[str, bool, float], ...]) -> Column:
    out = F.lit(True)
    for name, above, threshold in rule:
        out = out & (F.col(name) > threshold if above else F.col(name) <= threshold)
    return out


SPLIT = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def paths(tree: str) -> set[tuple[tuple[str, bool, float], ...]]:
    """All conjunctions from the root of a tree, given as the text that Spark prints of it, to its nodes.

    Conditions on one statistic and side are merged into the tightest.
    """
    out, so_far = set(), []
    for found in filter(None, map(SPLIT.match, tree.splitlines())):
        depth, above, at = len(found[1]), found[3] == ">", float(found[4])
        so_far = [x for x in so_far if x[0] < depth] + [(depth, STATISTICS[int(found[2])], above, at)]
        tight: dict[tuple[str, bool], float] = {}
        for _, name, above, at in so_far:
            old = tight.get((name, above))
            tight[name, above] = at if old is None else (max if above else min)(old, at)
        out.add(tuple((name, above, at) for (name, above), at in sorted(tight.items())))
    return out


def fit(rows: DataFrame, label: str = "quality", trees: int = 12, depth: int = 3, penalty: float = 2e-4, max_rows: int = 20_000, seed: int = 7) -> RuleModel:
    """Learns from about max_rows labelled rows of statistics (chosen by a hash of the whole row)."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from .common import sampled

    few = sampled(rows.filter(F.col(label).isNotNull()), max_rows)
    # dealt and sorted by a hash of the whole row: a partition that is lost and made again is the same, and so is the model of every run
    dealt = few.select(*STATISTICS, F.col(label).cast("double").alias("label"), F.xxhash64(*[F.col(f"`{c}`") for c in few.columns]).alias("at")).repartition(8, "at")
    labelled = dealt.sortWithinPartitions("at", *STATISTICS).select(*STATISTICS, "label").cache()
    try:
        counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
        ones, every = counts.get(1.0, 0), sum(counts.values())
        if len(counts) < 2:
            return RuleModel(math.log((ones + 1) / (every - ones + 1)), ())
        assembled = VectorAssembler(inputCols=list(STATISTICS), outputCol="x").transform(labelled).select("x", "label")
        grown = GBTClassifier(featuresCol="x", maxIter=trees, maxDepth=depth, maxBins=64, subsamplingRate=0.7, seed=seed).fit(assembled)
        rules = sorted(set().union(*[paths(tree.toDebugString) for tree in grown.trees]))
        names = [f"r{i}" for i in range(len(rules))]
        ruled = labelled.select("label", *[condition(r).cast("double").alias(n) for r, n in zip(rules, names, strict=True)])
        binary = VectorAssembler(inputCols=names, outputCol="x").transform(ruled).select("x", "label").cache()
        lasso = LogisticRegression(featuresCol="x", elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(binary)
        binary.unpersist()
        return RuleModel(float(lasso.intercept), tuple((r, float(w)) for r, w in zip(rules, lasso.coefficients, strict=True) if abs(w) > 1e-6))
    finally:
        labelled.unpersist()
