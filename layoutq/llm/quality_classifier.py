"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Class means and covariances come from sums of products (a map-side-combined aggregate, so one hot source costs nothing), are
shrunk towards the pooled covariance and a scaled identity, and are factored once; a score is the difference of two Mahalanobis log densities, put on a 0 to 1 scale by a
logistic fit on the training rows. Everything per row is a JVM expression.

Edge cases: null and empty texts have all counts zero and get a score like any other; without labels of both classes every score
is the share of label 1 (0.5 without any); repeated label rows count as often as they appear; null labels are ignored; label,
language, source and id are never inputs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored
from .quality_rules import measured

FEATURES = ("length", "word_length", "symbols", "duplicate_lines", "repeated_words", "stop_words", "upper", "exclaimed", "words_a_line")


def features(q: Column) -> dict[str, Column]:
    """Log-like transforms of ratios, so that classes are nearer to normal."""
    n, chars, lines = (F.greatest(q[k], F.lit(1)).cast("double") for k in ("n_words", "word_chars", "n_lines"))
    logged = lambda x, scale: F.log1p(x * float(scale))
    return {
        "length": F.log1p(q["n_words"].cast("double")),
        "word_length": logged(q["word_chars"] / n, 1),
        "symbols": logged(q["n_symbols"] / n, 20),
        "duplicate_lines": logged(q["n_dup_lines"] / lines, 10),
        "repeated_words": logged(q["n_repeat_words"] / n, 10),
        "stop_words": logged(q["n_stop_words"] / F.sqrt(n), 2),
        "upper": logged(q["n_upper"] / chars, 20),
        "exclaimed": logged(q["n_exclaimed"] / n, 20),
        "words_a_line": logged(n / lines, 1),
    }


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


class Discriminant:
    """Both classes' means, inverse Cholesky factors and log determinants, and the logistic scale; ``margin`` and ``score`` are Columns."""

    def __init__(self, n: np.ndarray, sums: np.ndarray, products: np.ndarray, shrink: float = 0.2, ridge: float = 0.05):
        self.n, d = n, sums.shape[1]
        self.usable = bool((n >= 2).all())
        if not self.usable:
            return
        self.mean = sums / n[:, None]
        covs = [products[c] / n[c] - np.outer(self.mean[c], self.mean[c]) for c in (0, 1)]
        pooled = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
        self.inverse, self.log_det = [], []
        for c in (0, 1):
            cov = (1 - shrink) * covs[c] + shrink * pooled
            cov += np.eye(d) * (ridge * max(np.trace(pooled) / d, 1e-6))
            factor = np.linalg.cholesky(cov)
            self.inverse.append(np.linalg.inv(factor))
            self.log_det.append(2 * float(np.log(np.diag(factor)).sum()))
        self.slope, self.shift = 1.0, 0.0

    def margin(self, x: list[Column]) -> Column:
        """log density of class 1 less that of class 0."""
        parts = []
        for c in (0, 1):
            total = F.lit(self.log_det[c])
            for row in self.inverse[c]:
                z = F.lit(0.0)
                for j, w in enumerate(row):
                    if w != 0:
                        z = z + (x[j] - F.lit(float(self.mean[c][j]))) * F.lit(float(w))
                total = total + z * z
            parts.append(total)
        return (parts[0] - parts[1]) * 0.5

    def calibrate(self, bins: list[tuple[float, int, int]]) -> None:
        """Logistic slope and shift by Newton steps over (margin, label, count) bins; a weak prior keeps separable data finite."""
        m, y, w = (np.array(v, dtype=float) for v in zip(*bins, strict=True))
        ab = np.array([0.1, 0.0])
        x = np.stack([m, np.ones_like(m)], 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ ab, -35, 35)))
            grad = x.T @ (w * (p - y)) + np.array([1.0, 0.01]) * ab
            hess = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag([1.0, 0.01])
            step = np.linalg.solve(hess, grad)
            ab = ab - step / max(1.0, np.abs(step).max() / 2)
        self.slope, self.shift = max(float(ab[0]), 1e-3), float(ab[1])

    def score(self, margin: Column) -> Column:
        z = F.least(F.greatest(margin * self.slope + self.shift, F.lit(-35.0)), F.lit(35.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fitted(train: DataFrame, names: tuple[str, ...] = FEATURES) -> Discriminant:
    """From rows with the features and a 0/1 column ``y``: one aggregate of sums and products, one of margin bins."""
    sums = [F.sum(k).alias(f"s_{i}") for i, k in enumerate(names)]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"p_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j <= i]
    rows = {r["y"]: r for r in train.groupBy("y").agg(F.count("*").alias("n"), *sums, *products).collect()}
    d = len(names)
    n, s, p = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for c in (0, 1):
        if c in rows:
            n[c], s[c] = rows[c]["n"], [rows[c][f"s_{i}"] for i in range(d)]
            for i in range(d):
                for j in range(i + 1):
                    p[c, i, j] = p[c, j, i] = rows[c][f"p_{i}_{j}"]
    model = Discriminant(n, s, p)
    if model.usable:
        m = F.least(F.greatest(model.margin([F.col(k) for k in names]), F.lit(-200.0)), F.lit(200.0))
        model.calibrate([(float(r["m"]), r["y"], r["count"]) for r in train.groupBy(F.round(m, 0).alias("m"), "y").count().collect()])
    return model


def classified(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs; docs has doc_id and text, labels has doc_id and quality."""
    f = features(F.col("quality"))
    x = stored(measured(docs.select(F.col("doc_id"), "text")).select("doc_id", *[f[k].alias(k) for k in FEATURES]), "features")
    train = labels.where("quality in (0, 1)").select(F.col("doc_id"), F.col("quality").cast("int").alias("y")).where(~held_out(F.col("doc_id"))).join(x, "doc_id").select("y", *FEATURES)
    model = fitted(train)
    share = float(model.n[1] / model.n.sum()) if model.n.sum() else 0.5
    score = model.score(model.margin([F.col(k) for k in FEATURES])) if model.usable else F.lit(share)
    return x.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= least).cast("int"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
