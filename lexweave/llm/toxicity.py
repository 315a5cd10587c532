"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has a logistic score over hashed features of its words (the word, its
beginnings and its ends, so that unseen forms of a known stem count); the score of the document is the noisy-or of
its sentences, 1 - prod(1 - p). Only documents have labels: the gradient of the bag likelihood flows to each
sentence in proportion to its responsibility, so the fit learns which sentences offend, and the operator locates
them.

Edge cases: null and empty texts have no sentence and score 0; a text of one endless sentence is one instance; rows
are scored one by one, so repeated rows and ties get equal scores; without labels of both classes every sentence
scores 0; texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import map_batches

#: Labelled documents that a fit learns from, at most, half of them of each class where there are as many: the fit
#: runs on the driver, which holds this many texts.
MAX_TRAINING = 4_000

#: Code points of those texts altogether, at most, so that long texts cannot fill the driver: half for each class, and what
#: one class leaves over goes to the other. Texts are taken whole, in the order of the sample; one that does not fit is
#: passed over. If none of a class fits, its shortest one is taken all the same, beyond the bound.
MAX_TRAINING_CHARS = 20_000_000

EPOCHS, RATE = 60, 0.15

#: L1 penalty on the weights for MAX_TRAINING documents, larger for fewer (by the power 1.5 of their number): features that
#: do not tell documents apart get weight 0.
PENALTY = 1e-4

#: Log odds of a sentence without features.
BIAS = -11.0

#: Words whose weight a worker remembers, at most.
REMEMBERED = 400_000

#: Sentences with this probability or more are reported as offending.
OFFENDING = 0.5

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")


def features(word: str) -> list[int]:
    """Hashes (32 bits) of the features of a lower-case word: itself, its beginnings of 4 to 6 characters and its end of 4."""
    parts = {"=" + word, "<" + word[:4], "<" + word[:5], "<" + word[:6], ">" + word[-4:]} if len(word) > 3 else {"=" + word}
    return [zlib.crc32(part.encode("utf-8", "surrogatepass")) for part in sorted(parts)]


@dataclass
class NoisyOr:
    """Weights other than 0 of a fitted model, by the hash of the feature; None: there was nothing to learn from."""

    weights: dict[int, float] | None
    bias: float = BIAS

    def scorer(self):
        """A function from a text to (document score, offending [(start, end, score)]), with a memory for words."""
        if self.weights is None:
            return lambda text: (0.0, [])
        weight = self.weights.get

        class Memory(dict):
            def __missing__(self, word: str) -> float:
                if len(self) >= REMEMBERED:
                    self.clear()
                value = self[word] = sum(weight(f, 0.0) for f in features(word))
                return value

        memory, bias = Memory(), self.bias

        def score(text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
            if not text:
                return 0.0, []
            lower = text.lower()
            known = len(lower) == len(text)  # else lower case moved positions
            whole = text if known else lower
            clean, found = 0.0, []
            for m in SENTENCE.finditer(whole):
                words = WORD.findall(m[0].lower() if known else m[0])
                if not words:
                    continue
                z = bias + sum(map(memory.__getitem__, set(words)))
                p = 1 / (1 + math.exp(-min(max(z, -700.0), 700.0)))
                clean += math.log1p(-min(p, 1 - 1e-12))
                if p >= OFFENDING:
                    found.append((m.start(), m.end(), p))
            return -math.expm1(clean), found if known else _aligned(text, found, lower)

        return score


def _aligned(text: str, found: list[tuple[int, int, float]], lower: str) -> list[tuple[int, int, float]]:
    """Spans of the lower-case text as spans of the text, where lower case changes lengths."""
    if not found:
        return []
    at = np.cumsum([0, *(len(c.lower()) for c in text)])
    return [(int(np.searchsorted(at, start)), min(len(text), int(np.searchsorted(at, end))), p) for start, end, p in found]


def fitting(sizes: list[tuple[str, int, int]], max_chars: int) -> list[tuple[str, int]]:
    """(id, label) of the texts to learn from, of (id, label, code points) in the order of the sample; see MAX_TRAINING_CHARS."""
    total = {label: sum(chars for _, own, chars in sizes if own == label) for label in (0, 1)}
    out = []
    for label in (1, 0):
        left = max(max_chars // 2, max_chars - total[1 - label])
        own = [(doc_id, chars) for doc_id, of, chars in sizes if of == label]
        taken = []
        for doc_id, chars in own:
            if chars <= left:
                left -= chars
                taken.append(doc_id)
        if own and not taken:
            taken.append(min(own, key=lambda r: r[1])[0])
        out += [(doc_id, label) for doc_id in taken]
    return out


def training_sample(documents: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING, max_chars: int = MAX_TRAINING_CHARS) -> list[tuple[str, int]]:
    """At most limit labelled (text, label) of max_chars code points altogether, half of them of each class, in an order
    that a hash of the id fixes."""
    chosen = None
    for label in (1, 0):
        own = labels.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit // 2)
        chosen = own if chosen is None else chosen.unionByName(own)
    # ids and labels of the sample: limit rows at most
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sizes = rows.groupBy("doc_id", "label").agg(F.sum(F.char_length("text")).alias("chars"))
    sizes = [tuple(r) for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]  # limit rows at most
    taken = set(fitting(sizes, max_chars))
    if len(taken) < len(sizes):
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        rows = rows.join(F.broadcast(documents.sparkSession.createDataFrame([*taken], f"doc_id {kinds['doc_id']}, label {kinds['label']}")), ["doc_id", "label"], "left_semi")
    out = [(row["doc_id"], row["text"], row["label"]) for row in rows.select("doc_id", "text", "label").toLocalIterator()]
    return [(text, label) for _, text, label in sorted(out, key=lambda r: (r[0], r[1]))]


def fit(sample: list[tuple[str, int]], *, epochs: int = EPOCHS, rate: float = RATE, penalty: float = PENALTY) -> NoisyOr:
    """Proximal gradient ascent (Adam steps, then soft thresholding) on the noisy-or likelihood of the documents' labels."""
    y = np.array([label for _, label in sample], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return NoisyOr(None)
    memory: dict[str, list[int]] = {}
    slots: list[int] = []
    ends: list[int] = []
    bag: list[int] = []
    for i, (text, _) in enumerate(sample):
        for m in SENTENCE.finditer(text.lower()):
            words = set(WORD.findall(m[0]))
            if words:
                for word in words:
                    if word not in memory:
                        memory[word] = features(word)
                    slots += memory[word]
                ends.append(len(slots))
                bag.append(i)
    used, column = np.unique(np.array(slots, dtype=np.uint32), return_inverse=True)
    del slots, memory
    column = column.astype(np.int32)
    starts = np.array([0, *ends[:-1]])
    row = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff([0, *ends]))
    bag_of = np.array(bag)
    w, bias = np.zeros(len(used)), BIAS
    penalty *= max(1.0, (MAX_TRAINING / len(y)) ** 1.5)
    m1, m2, b1, b2 = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    class_weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for t in range(1, epochs + 1):
        z = np.add.reduceat(w[column], starts) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        p = np.clip(p, 1e-12, 1 - 1e-9)
        clean = np.bincount(bag_of, np.log1p(-p), len(y))
        whole = np.clip(-np.expm1(clean), 1e-9, 1.0)
        # d log-likelihood / dz: label 1: p (1 - P) / P; label 0: -p
        g = np.where(y[bag_of] == 1, p * (1 - whole[bag_of]) / whole[bag_of], -p) * class_weight[bag_of] / len(y)
        grad = np.bincount(column, g[row], len(used))
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        step = rate / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-4)
        w += step * m1 / (1 - 0.9**t)
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        gb = g.sum()
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb**2
        bias += rate * (b1 / (1 - 0.9**t)) / (np.sqrt(b2 / (1 - 0.99**t)) + 1e-8)
    kept = np.flatnonzero(w)
    return NoisyOr(dict(zip(used[kept].tolist(), w[kept].tolist())), float(bias))


def score(documents: DataFrame, model: NoisyOr) -> DataFrame:
    """doc_id, score and offending: array of (start, end, score), the sentences that offend, in code points."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # no more than the features of the training sample

    def run(batches):
        of = shared.value.scorer()
        for batch in batches:
            found = [of(text) for text in batch.column("text").to_pylist()]
            spans = [[{"start": a, "end": b, "score": p} for a, b, p in f[1]] for f in found]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "offending"])

    return map_batches(documents.select("doc_id", "text"), run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, score double, offending array<struct<start:bigint,end:bigint,score:double>>")
