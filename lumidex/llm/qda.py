"""Quality classifier: regularised quadratic discriminant (operator 7).

Statistics of a whole text (lengths, shares of kinds of characters and words, repeated
lines) are transformed to be roughly normal. Each class has a mean and a covariance;
the covariance is shrunk towards the pooled one and that towards its diagonal. Scores
are the logistic of the difference of log densities, by Mahalanobis distances from
Cholesky factors that are computed once on the driver and cached in the tasks.

Scale: one pass over the texts gives a written table of features, a row of numbers a
document; labels join these rows, not texts. Class moments are summed within tasks and
then by (class, entry): the driver gets 2 * (1 + d + d * d) numbers, whatever the data.
All labelled rows outside the held-out fold are used.

Defined results: null and empty texts have the statistics of no words and a score like
any other; very long texts count whole; repeated rows each give a row; a null doc_id is
not held out and has no label; labels that are null are left out, a doc_id labelled
twice counts twice. Without two rows of both classes the score is the share of ones
among the labels, with one added to both. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.llm.common import saved, table

#: Shares of the pooled covariance in each class's, and of the diagonal in the pooled one.
SHRINK_CLASS, SHRINK_DIAGONAL = 0.1, 0.05
THRESHOLD = 0.3
FOLDS = 5

_SYMBOLS = np.frombuffer(b"#*$%&<>", np.uint8)
FEATURES = ("words", "chars", "word_length", "symbols", "bars", "exclaims", "upper", "digits", "stops", "other", "high", "distinct", "short", "lines", "dup_lines", "longest_word")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics FEATURES of a text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), len(data)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if size else np.zeros(256, np.int64)
    upper, lower, digits = int(count[65:91].sum()), int(count[97:123].sum()), int(count[48:58].sum())
    high, symbols = int(count[128:].sum()), int(count[_SYMBOLS].sum())
    blank = int(count[9:14].sum() + count[32])
    other = size - blank - upper - lower - digits - high - symbols - int(count[124] + count[33] + count[46])
    lines = [x for x in data.split(b"\n") if x.strip()]
    rate = lambda k, of: float(np.log((k + 2) / (max(of - k, 0) + 5)))
    per = lambda k: float(np.log((k + 1) / (n + 20)))
    lengths = sorted(map(len, words))
    return [
        float(np.log1p(n)), float(np.log1p(size)), float(np.log((size - blank + 25) / (n + 5))),
        per(symbols), per(int(count[124])), per(int(count[33])), rate(upper, upper + lower), per(digits), per(int(count[46])), per(max(other, 0)), rate(high, size),
        float(np.log((len(set(words)) + 5) / (n + 5))), rate(int(np.searchsorted(lengths, 4)), n), float(np.log((len(lines) + 2) / (n + 20))),
        float(np.log((len(lines) - len(set(lines)) + 1) / (len(lines) + 5))), float(np.log1p(lengths[-1] if n else 0)),
    ]


def featured(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id and x, the array of a text's statistics."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "x": [statistics(t) for t in pdf["text"]]})

    return docs.mapInPandas(describe, f"doc_id {kind}, x array<double>")


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Of rows (x, label): label to (rows, sum of x, sum of outer products)."""
    d = len(FEATURES)

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 + d + d * d))
        for pdf in frames:
            x = np.array(pdf["x"].tolist(), float).reshape(-1, d)
            for k in (0, 1):
                own = x[(pdf["label"] == k).to_numpy()]
                total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pd.DataFrame({"label": np.repeat([0, 1], total.shape[1]), "entry": np.tile(np.arange(total.shape[1]), 2), "value": total.ravel()})

    sums = rows.select("x", "label").mapInPandas(add, "label int, entry int, value double").groupBy("label", "entry").agg(F.sum("value").alias("value"))
    out = np.zeros((2, 1 + d + d * d))
    for r in sums.collect():
        out[r["label"], r["entry"]] = r["value"]
    return {k: (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for k, v in enumerate(out)}


class Discriminant:
    """Class densities; score(x) is the probability of label 1."""

    def __init__(self, found: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> None:
        self.counts = [found[k][0] for k in (0, 1)]
        self.classes = None
        if min(self.counts) < 2:
            return
        means = [found[k][1] / found[k][0] for k in (0, 1)]
        scatter = [found[k][2] - found[k][0] * np.outer(m, m) for k, m in zip((0, 1), means, strict=True)]
        pooled = sum(scatter) / sum(self.counts)
        pooled = (1 - SHRINK_DIAGONAL) * pooled + SHRINK_DIAGONAL * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(pooled))
        self.classes = []
        for n, mean, s in zip(self.counts, means, scatter, strict=True):
            factor = np.linalg.cholesky((1 - SHRINK_CLASS) * s / n + SHRINK_CLASS * pooled)
            constant = np.log(n / sum(self.counts)) - np.log(np.diag(factor)).sum()
            self.classes.append((mean, np.linalg.inv(factor), constant))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), (self.counts[1] + 1) / (sum(self.counts) + 2))
        density = [c - 0.5 * (((x - mean) @ whiten.T) ** 2).sum(axis=1) for mean, whiten, c in self.classes]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def score_quality(documents: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted of each document, by labels outside the held-out fold."""
    spark = documents.sparkSession
    rows = saved(featured(documents, id_col), "features")
    known = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out("l_id"))
    model = spark.sparkContext.broadcast(Discriminant(moments(rows.join(known, F.col("doc_id") == F.col("l_id")))))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x = np.array(pdf["x"].tolist(), float).reshape(-1, len(FEATURES))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "score": model.value.score(x)})

    scored = rows.mapInPandas(judge, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
