"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

A text's tokens are runs of letters, of digits and of other marks. Its features are all runs of one, two and three
tokens, hashed into a fixed number of weights: by the words, in lower case, and by form (how a word is capitalised,
whether it repeats the one before, the marks themselves); a feature's value is the root of its share. Training makes
a few passes over a sample of labelled documents, bounded in number (``SAMPLE``) and bytes, in the driver; scoring is a
sparse dot product with the weights, which have a fixed size and are sent to the workers once.

Defined results: null and empty texts have no features and get the score of the bias alone; without labels of both
kinds every score is the share of label 1 (0.5 without any label); repeated rows are scored one by one; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices
from .training import fold, labelled_sample

#: Bounds: labelled documents to learn from, weights, and words that a worker remembers.
SAMPLE, WEIGHTS, MEMORY = 8_000, 1 << 18, 300_000
_TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def _code(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


class Features:
    """A text's hashed n-grams: (indices of weights, ascending, and values)."""

    def __init__(self):
        self.memory: dict[str, tuple[int, int]] = {}

    def _token(self, token: str) -> tuple[int, int]:
        if len(self.memory) > MEMORY:
            self.memory.clear()
        if token[0].isalpha():
            form = "U" if token.isupper() and len(token) > 1 else "T" if token[0].isupper() else "l" if token.islower() else "m"
        else:
            form = "9" if token[0].isdigit() else token[:8]
        found = self.memory[token] = (_code("w" + token.lower()), _code("f" + form))
        return found

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        tokens = _TOKENS.findall(text)
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(0)
        get, make = self.memory.get, self._token
        codes = np.array([get(t) or make(t) for t in tokens], np.int64)
        words, forms = codes[:, 0], codes[:, 1].copy()
        forms[1:][words[1:] == words[:-1]] ^= 0x5BD1E995
        runs = [words % WEIGHTS, forms % WEIGHTS]
        for k, codes in enumerate((words, forms)):
            two = (codes[:-1] * 31 + codes[1:] + 1 + 2 * k) * 0x9E3779B1 >> 7
            three = ((codes[:-2] * 31 + codes[1:-1]) * 31 + codes[2:] + 2 + 2 * k) * 0x9E3779B1 >> 7
            runs += [two % WEIGHTS, three % WEIGHTS]
        index, n = np.unique(np.concatenate(runs), return_counts=True)
        return index, np.sqrt(n / len(tokens))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-min(35.0, max(-35.0, x))))


@dataclass
class Ftrl:
    """Follow-the-regularised-leader for logistic loss, each weight with a learning rate of its own."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1

    def __post_init__(self):
        self.z, self.n = np.zeros(WEIGHTS + 1), np.zeros(WEIGHTS + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (_sigmoid(float(w @ x)) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def train(sample: list[tuple[str, int]], passes: int = 3) -> np.ndarray:
    """The weights, the bias last, of labelled texts."""
    share = sum(y for _, y in sample) / len(sample) if sample else 0.5
    if share in (0.0, 1.0) or not sample:
        out = np.zeros(WEIGHTS + 1)
        out[-1] = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return out
    features, model = Features(), Ftrl()
    rows = [(np.append(i, WEIGHTS), np.append(x, 1.0), y) for (i, x), y in ((features(t), y) for t, y in sample)]
    for turn in range(passes):
        for k in np.random.Generator(np.random.PCG64(turn)).permutation(len(rows)).tolist():
            model.update(*rows[k])
    return model.weights()


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of each row of ``docs`` (doc_id, text)."""
    at = np.flatnonzero(weights)
    sparse = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), weights[at]))  # WEIGHTS + 1 numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(WEIGHTS + 1)
        where, values = sparse.value
        w[where] = values
        features = Features()
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                out = []
                for text in batch.column(1).slice(lo, hi - lo).to_pylist():
                    index, x = features(text or "")
                    out.append(_sigmoid(float(w[index] @ x) + w[WEIGHTS]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document, by a model of the labels outside the held-out fold."""
    weights = train(labelled_sample(docs, labels, "quality", folds, held_out, sample))
    return score(docs, weights).select("doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
