"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Every text gives a short vector of statistics, transformed (logs, square roots) towards a normal shape. A fit adds
up the moments of each class over all labelled rows, shrinks the class covariances towards their pooled covariance
and towards a multiple of the identity, and keeps one Cholesky factor for each class. A score is the logistic of the
difference of the two Mahalanobis log densities.

Edge cases: a null or empty text has the statistics of no words and is scored like any other; rows are scored one by
one, so repeated rows and ties get equal scores; without labels every score is 0.5, with one class only the share of
that class; a null label or id is not learnt from; texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import map_batches

#: Shrinkage of a class covariance towards the pooled one, and of the result towards a multiple of the identity.
TO_POOLED, TO_IDENTITY = 0.05, 0.01

#: Log-density differences are divided by this: the statistics are not independent of each other beyond their covariance.
TEMPERATURE = 2.0

STATISTICS = (
    "log_words", "word_length", "word_length_sd", "long_words", "symbols", "exclamations", "marks", "upper",
    "digits", "distinct", "adjacent", "top_word", "repeat_lines", "line_length", "short_words", "pipes",
)


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a text, in the order of STATISTICS."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    chars = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, n)
    mean = lengths.mean()
    counts = Counter(words)
    adjacent = sum(map(bytes.__eq__, words, words[1:]))
    lines = [line for line in data.split(b"\n") if line.strip()]
    capitals = int(chars[65:91].sum())
    letters = capitals + int(chars[97:123].sum())
    symbols = int(chars[[35, 36, 37, 38, 42, 60, 62]].sum())
    root = lambda part, whole: math.sqrt(part / max(whole, 1))
    return [
        math.log1p(n),
        math.log(mean),
        math.log1p(lengths.std()),
        root(int((lengths > 14).sum()), n),
        root(symbols, n),
        root(int(chars[33]), n),
        root(int(chars[44] + chars[46]), n),
        root(capitals, letters),
        root(int(chars[48:58].sum()), len(data)),
        math.log(len(counts)) / math.log(n) if n > 1 else 1.0,
        root(adjacent, n),
        root(max(counts.values()) - 1, n + 20),
        root(len(lines) - len(set(lines)), len(lines)),
        math.log1p(n / max(len(lines), 1)),
        root(int((lengths < 4).sum()), n),
        root(int(chars[124]), n),
    ]


def with_statistics(documents: DataFrame) -> DataFrame:
    """doc_id and x, the vector of statistics."""

    def measure(batches):
        for batch in batches:
            rows = [statistics(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return map_batches(documents.select("doc_id", "text"), measure, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, x array<double>")


@dataclass
class Discriminant:
    """A fitted model: for each class its mean, its Cholesky factor, and its log normaliser."""

    prior: float
    means: tuple[np.ndarray, ...] = ()
    factors: tuple[np.ndarray, ...] = ()
    constant: tuple[float, ...] = ()
    temperature: float = TEMPERATURE

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of x."""
        if not self.means:
            return np.full(len(x), self.prior)
        density = [c - 0.5 * (np.linalg.solve(factor, (x - m).T) ** 2).sum(axis=0) for m, factor, c in zip(self.means, self.factors, self.constant)]
        margin = (density[1] - density[0]) / self.temperature + math.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def fit(vectors: DataFrame, labels: DataFrame, *, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
    """vectors: doc_id, x. labels: doc_id, label (0 or 1). All labelled rows count: each batch adds up its moments, and
    only sums of a fixed size reach the driver."""
    d = len(STATISTICS)

    def moments(batches):
        for batch in batches:
            y = batch.column("label").to_numpy(zero_copy_only=False)
            x = np.array(batch.column("x").to_pylist(), dtype=np.float64).reshape(len(y), d)
            for label in (0, 1):
                own = x[y == label]
                values = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), label)), pa.array(np.arange(len(values))), pa.array(values)], names=["label", "i", "v"])

    rows = map_batches(vectors.join(labels, "doc_id").select("x", "label"), moments, "label bigint, i bigint, v double").groupBy("label", "i").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros((2, 1 + d + d * d))
    for row in rows:
        sums[row["label"], row["i"]] = row["v"]
    n = sums[:, 0]
    prior = float((n[1] + 1) / (n.sum() + 2))
    if n.min() < 2:
        return Discriminant(prior)
    means = [sums[k, 1 : d + 1] / n[k] for k in (0, 1)]
    scatter = [sums[k, d + 1 :].reshape(d, d) / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (n[0] * scatter[0] + n[1] * scatter[1]) / n.sum()
    factors, constant = [], []
    for k in (0, 1):
        cov = (1 - to_pooled) * scatter[k] + to_pooled * pooled
        cov = (1 - to_identity) * cov + to_identity * (np.trace(pooled) / d + 1e-9) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        factors.append(factor)
        constant.append(-float(np.log(np.diag(factor)).sum()))
    return Discriminant(prior, tuple(means), tuple(factors), tuple(constant))


def score(vectors: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score, the probability of class 1."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # a few KB, whatever the input

    def run(batches):
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), dtype=np.float64).reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(x))], names=["doc_id", "score"])

    return map_batches(vectors.select("doc_id", "x"), run, f"doc_id {vectors.schema['doc_id'].dataType.simpleString()}, score double")
