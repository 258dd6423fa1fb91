"""Mixing documents to target weights, with soft membership of domains.

A multinomial classifier over hashed words learns domains from a labelled table and gives every document a posterior p over them.
With t tokens in a document and a rate r of using it, the expected tokens of domain k are E_k = sum(r * t * p_k). Projected-gradient
least squares fits the rates so that E meets the targets T. Gradients are summed up and projected onto r >= 0 as one, so that the
rates nearest to 1 (by tokens) are found: r = max(0, 1 - p . g). A step adds to g the misfit E - T, scaled by the K x K Gram matrix
of the documents in use (shortened, if need be) or by the domains' tokens, whichever leads further down the objective. It is one
aggregation over the documents, and as the rates follow from g, no state of documents is kept between steps. Steps go on until every
E_k is within the tolerance of T_k; if PATIENCE steps on end bring E no nearer, no rates reach the targets, and `met` says so.

Cases: null and empty texts have 0 tokens and the posterior of no words; domains without any tokens take no part; targets are
scaled to sum 1; without labelled rows all documents share one domain; repeated rows get equal rates; texts of any length are hashed
whole; an empty table gives no rows; columns of the input named like an added one are replaced, all others pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sampled, spare

SPACE = r"[\x20\x09-\x0D]"
#: What may end a word and is not part of it.
ENDS = r"[.,;:!?]"


def words(text: Column) -> Column:
    """Words without the full stops and commas behind them; white space at the text's ends makes none."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"^{SPACE}+|{ENDS}*{SPACE}*\z", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{ENDS}*{SPACE}+"))


def labelled_rows(docs: DataFrame, labels: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", domain: str = "domain", max_rows: int = 12_000) -> DataFrame:
    """Columns t and d of about max_rows labelled documents (all, if there are fewer).

    Labels are chosen first, by a hash of their row and max_rows at most, so what is broadcast is bounded and no text is shuffled.
    """
    few = sampled(labels.filter(F.col(domain).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(domain).alias("d")), max_rows).orderBy(F.xxhash64("k", "d"), "k", "d").limit(max_rows)
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).join(F.broadcast(few), "k")
    return sampled(scratch.park(rows), max_rows).select("t", "d")


def fit_posteriors(rows: DataFrame, features: int = 1 << 13) -> tuple[object, tuple[str, ...]]:
    """A classifier of domains, from rows (t, d) of a bounded sample, and the domains' names."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    names = tuple(sorted(r["d"] for r in rows.select("d").distinct().collect()))
    if len(names) < 2:
        return None, names or ("all",)
    number = F.coalesce(*[F.when(F.col("d") == n, F.lit(float(i))) for i, n in enumerate(names)])
    hashed = HashingTF(inputCol="w", outputCol="x", numFeatures=features, binary=True).transform(rows.select(words(F.col("t")).alias("w"), number.alias("label"))).select("x", "label").repartition(8).cache()
    try:
        return LogisticRegression(featuresCol="x", family="multinomial", maxIter=25, regParam=2e-3).fit(hashed), names
    finally:
        hashed.unpersist()


def posteriors(docs: DataFrame, model: object, names: tuple[str, ...], text: str = "text") -> DataFrame:
    """The documents with n_tokens (words) and p, an array of the domains' posteriors in the order of `names`."""
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    docs = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in ("n_tokens", "p")])
    kept = [f"`{c}`" for c in docs.columns]
    w, x, y = (spare(docs, c) for c in ("w", "x", "y"))
    found = docs.withColumn(w, words(F.col(f"`{text}`")))
    n = F.size(w).cast("long").alias("n_tokens")
    if model is None:
        return found.select(*kept, n, F.array(F.lit(1.0)).alias("p"))
    hashed = HashingTF(inputCol=w, outputCol=x, numFeatures=model.numFeatures, binary=True).transform(found)
    model = model.copy({model.featuresCol: x, model.probabilityCol: y, model.predictionCol: "", model.rawPredictionCol: ""})
    return model.transform(hashed).select(*kept, n, vector_to_array(y).alias("p"))


#: So many steps may pass without a smaller misfit before the targets count as out of reach.
PATIENCE = 20


@dataclass(frozen=True)
class Mix:
    """The summed gradients, from which a document's rate follows. `met`: every target is within the tolerance."""

    gradient: tuple[float, ...]
    totals: tuple[float, ...]
    targets: tuple[float, ...]
    expected: tuple[float, ...]
    steps: int
    met: bool

    def rate(self, p: Column) -> Column:
        return rate(p, self.gradient)


def rate(p: Column, gradient: tuple[float, ...]) -> Column:
    """max(0, 1 - p . g)"""
    return F.greatest(F.lit(0.0), sum((-F.get(p, F.lit(i)) * float(g) for i, g in enumerate(gradient)), F.lit(1.0)))


def _measured(docs: DataFrame, candidates: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each g: the expected tokens E, the Gram matrix sum(t * p_i * p_j) of documents with a rate above 0, and sum(t * r * r) / 2."""
    k = len(candidates[0])
    p, t = [F.get("p", F.lit(i)) for i in range(k)], F.col("n_tokens")
    rated = docs.select("n_tokens", "p", *[rate(F.col("p"), tuple(g.tolist())).alias(f"r{c}") for c, g in enumerate(candidates)])
    sums = []
    for c in range(len(candidates)):
        r = F.col(f"r{c}")
        sums += [F.sum(t * r * r / 2), *[F.sum(t * p[i] * r) for i in range(k)], *[F.sum(F.when(r > 0, t * p[i] * p[j])) for i in range(k) for j in range(i, k)]]
    row = np.array([x or 0.0 for x in rated.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()])
    out, upper = [], np.triu_indices(k)
    for part in np.split(row, len(candidates)):
        gram = np.zeros((k, k))
        gram[upper] = part[k + 1 :]
        out.append((part[1 : k + 1], gram + np.triu(gram, 1).T, float(part[0])))
    return out


def fit_rates(docs: DataFrame, weights: tuple[float, ...], tolerance: float = 1e-3) -> Mix:
    """Fits the rates of documents (n_tokens, p) so that the domains' shares of expected tokens are `weights`."""
    g = np.zeros(len(weights))
    ((expected, gram, _),) = _measured(docs, [g])
    totals, wanted = expected, np.where(expected > 0, np.array(weights, dtype=float), 0.0)
    live = totals > 0
    targets = wanted / wanted.sum() * totals.sum() if wanted.sum() > 0 else np.zeros_like(totals)
    allowed = np.where(targets > 0, tolerance * targets, 1e-6 * totals.sum())
    misfit = lambda e: float((((e - targets) ** 2)[live] / totals[live]).sum())
    met = lambda e: bool((abs(e - targets) <= allowed)[live].all())
    steps, nearest, since = 0, (misfit(expected), g, expected), 0
    while not met(expected) and since < PATIENCE and wanted.sum() > 0:
        plain, scaled = np.zeros_like(g), np.zeros_like(g)
        plain[live] = (expected - targets)[live] / totals[live]
        scaled[live] = np.linalg.lstsq(gram[np.ix_(live, live)], (expected - targets)[live], rcond=1e-12)[0]
        tried = [g + scaled, g + scaled / 2, g + scaled / 8, g + plain]
        found = _measured(docs, tried)
        best = min(range(len(tried)), key=lambda i: found[i][2] + float(tried[i] @ targets))
        g, (expected, gram, _) = tried[best], found[best]
        steps, since = steps + 1, 0 if misfit(expected) < (1 - 1e-3) * nearest[0] else since + 1
        if misfit(expected) < nearest[0]:
            nearest = misfit(expected), g, expected
    if not met(expected):
        _, g, expected = nearest
    return Mix(*(tuple(x.tolist()) for x in (g, totals, targets, expected)), steps, met(expected))


def realised(docs: DataFrame, k: int) -> tuple[float, ...]:
    """The shares of the k domains in the tokens that are drawn, from documents (n_tokens, p, copies): what came of the expected ones."""
    drawn = F.col("n_tokens") * F.col("copies")
    row = docs.agg(*[F.sum(drawn * F.get("p", F.lit(i))).alias(f"s{i}") for i in range(k)]).first()
    total = sum(x or 0.0 for x in row)
    return tuple((x or 0.0) / total if total else 0.0 for x in row)


def copies(rate: Column, key: Column, seed: str = "mix") -> Column:
    """How often a document is used: its rate, rounded up or down by a hash of its key so that the mean is the rate."""
    return (F.floor(rate) + F.when(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 24)) < (rate - F.floor(rate)) * (1 << 24), 1).otherwise(0)).cast("int")
