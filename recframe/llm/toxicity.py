"""Toxicity by maximum-scoring segments.

Each token has a log-odds score, of occurring in toxic against other documents, with a Dirichlet prior that is
proportional to the token's share of all labelled documents, drawn towards 0 by two of its standard errors: what is
within them counts as 0. Of a word's stems (its first four, five and six letters) and the word itself, the one furthest
from 0 speaks for it. A small drift is taken off every token. A linear-time scan then finds all maximal-scoring segments.
Under chance the best score of a
document follows an extreme-value law; its two parameters are fitted to the documents labelled as not toxic, so that
a segment's score becomes the logarithm of how many as good would be expected by chance in a text of that length.
Segments that are significant add up, and a logistic curve fitted to the labelled documents turns their sum to a
score from 0 to 1.

The model is fitted to a sample of labelled documents, bounded in number (``SAMPLE``) and bytes, in one task; the driver gets
its weights alone. Scanning is row-wise, over
whole texts, without a shuffle.

Defined results: null and empty texts have no segment and get the score of no evidence; without labels of both kinds
nothing is toxic (score 0); repeated rows are scored one by one; rows with a null doc_id are scored too; other columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices
from .training import fold, labelled_rows

#: Bounds: labelled documents to learn from, and words that a worker remembers.
SAMPLE, MEMORY = 8_000, 100_000
_WORDS = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)


def _tokens(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def _forms(word: str) -> list[str]:
    return [word[:k] + "-" for k in STEMS if len(word) >= k] + [word]


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (from, to, score) of a sequence: no segment can be extended or split without loss, each
    within the one before's rest.

    In linear time: each segment points at the last one before it whose left sum is smaller, which is all that a later
    one needs to look at; what a search has passed lies behind its result and isn't passed again unless it is merged.
    """
    begin: list[int] = []
    end: list[int] = []
    low: list[float] = []  # sum of all scores before a segment
    high: list[float] = []  # and up to its end
    smaller: list[int] = []
    total = 0.0
    for k, s in enumerate(scores):
        before = total
        total += s
        if s <= 0:
            continue
        lo, left, j = k, before, len(begin) - 1
        while True:
            while j >= 0 and low[j] >= left:
                j = smaller[j]
            if j < 0 or high[j] >= total:
                break
            lo, left = begin[j], low[j]
            back = smaller[j]
            for column in (begin, end, low, high, smaller):
                del column[j:]
            j = back
        for column, x in zip((begin, end, low, high, smaller), (lo, k + 1, left, total, j), strict=True):
            column.append(x)
    return [(a, b, r - x) for a, b, x, r in zip(begin, end, low, high, strict=True)]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    drift: float = 0.2
    rate: float = 1.0  # of the extreme-value law
    chance: float = 1.0
    slope: float = 0.0
    bias: float = -20.0
    memory: dict[str, float] = field(default_factory=dict)

    def token(self, word: str) -> float:
        if len(self.memory) > MEMORY:
            self.memory.clear()
        found = [self.weights[f] for f in _forms(word) if f in self.weights]
        s = self.memory[word] = max(found, key=abs, default=0.0) - self.drift
        return s

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """(number of words, all maximal segments)."""
        words = _tokens(text)
        get, make = self.memory.get, self.token
        scores = np.array([s if (s := get(w)) is not None else make(w) for w in words])
        if not len(words) or not (scores > 0).any():
            return len(words), []
        # runs of one sign act as one step
        up = scores > 0
        start = np.flatnonzero(np.concatenate(([True], up[1:] != up[:-1])))
        ends = np.append(start[1:], len(words))
        found = segments(np.add.reduceat(scores, start).tolist())
        return len(words), [(int(start[a]), int(ends[b - 1]), s) for a, b, s in found]

    def surprise(self, segment: float, words: int) -> float:
        """Minus the logarithm of the expected number of segments as good by chance."""
        return self.rate * segment - math.log(self.chance * max(words, 1))

    def evidence(self, text: str) -> float:
        words, found = self.passages(text)
        return sum(e for _, _, s in found if (e := self.surprise(s, words)) > 0)

    def score(self, text: str) -> float:
        x = self.slope * math.log1p(self.evidence(text)) + self.bias
        return 1 / (1 + math.exp(-min(35.0, max(-35.0, x))))


def log_odds(toxic: int, other: int, n1: int, n0: int, prior: float, errors: float) -> float:
    """How much likelier a token is in toxic documents: the logarithm of the odds of its two shares, drawn towards 0 by some
    standard errors. It is in ``toxic`` of ``n1`` and ``other`` of ``n0`` documents; the prior puts it in both alike."""
    share = (toxic + other) / (n1 + n0)
    a, b = toxic + prior * share, other + prior * share
    delta = math.log(a / max(n1 + prior - a, 1e-9)) - math.log(b / max(n0 + prior - b, 1e-9))
    return math.copysign(max(abs(delta) - errors * math.sqrt(1 / a + 1 / b), 0.0), delta)


def fit(sample: list[tuple[str, int]], prior: float = 500.0, errors: float = 2.0) -> Model:
    """The model of labelled texts; equal texts count once. ``prior``: weight of the Dirichlet prior, in documents."""
    sample = list(dict.fromkeys(sample))
    toxic, other = Counter(), Counter()
    for text, y in sample:
        (toxic if y else other).update({f for w in set(_tokens(text)) for f in _forms(w)})
    n1 = sum(y for _, y in sample)
    n0 = len(sample) - n1
    model = Model()
    if not n1 or not n0:
        return model
    found = ((f, log_odds(toxic[f], other[f], n1, n0, prior, errors)) for f in toxic.keys() | other.keys())
    model.weights = {f: x for f, x in found if x}
    # The extreme-value law of the best segments of texts that aren't toxic.
    rows = [(max((s for _, _, s in found), default=0.0), n, y) for (n, found), y in ((model.passages(t), y) for t, y in sample)]
    calm = np.array([(s, n) for s, n, y in rows if not y and n], float).reshape(-1, 2)
    if len(calm) > 1:
        excess = calm[:, 0]
        model.rate = float(np.clip(math.pi / math.sqrt(6) / max(float(excess.std()), 1e-3), 0.5, 4.0))
        centre = float(excess.mean()) - 0.5772 / model.rate
        model.chance = max(math.exp(model.rate * centre) / float(np.mean(calm[:, 1])), 1e-4)
    x = np.array([math.log1p(model.evidence(t)) for t, _ in sample])
    y = np.array([y for _, y in sample], float)
    w = np.zeros(2)
    z = np.stack((x, np.ones(len(x))), 1)
    for _ in range(60):  # Newton steps with a little shrinkage
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(2), z.T @ (y - p) - 0.5 * w * [1, 0])
        w = w + np.clip(step, -2, 2)
    model.slope, model.bias = max(float(w[0]), 0.0), float(w[1])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # as many weights as the sample's bound allows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                out = [own.score(t or "") for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns, whatever their names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            column = batch.column(at)
            yield batch.filter(pa.array([own.score(t or "") < threshold for lo, hi in slices(column) for t in column.slice(lo, hi - lo).to_pylist()], pa.bool_()))

    numbered = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return map_arrow(numbered, run, numbered.schema).toDF(*docs.columns)


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, first_word, words, score, surprise) of every significant passage."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, found = own.passages(text or "")
                out += [(doc_id, a, b - a, s, e) for a, b, s in found if (e := own.surprise(s, n)) > 0]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "first_word", "words", "score", "surprise"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, first_word long, words long, score double, surprise double")


def learn(docs: DataFrame, labels: DataFrame | None, folds: int = 5, held_out: int = 0, sample: int = SAMPLE) -> Model:
    """The model of the labels outside the held-out fold; without a table of labels, one to which nothing is toxic."""
    if labels is None:
        return Model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)), key=lambda x: x[:2])
        model = fit([(text, int(y)) for _, _, y, text in rows])
        model.memory.clear()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    made = map_arrow(labelled_rows(docs, labels, "toxic", folds, held_out, sample), run, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else Model()


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document, by a model of the labels outside the held-out fold."""
    model = learn(docs, labels, folds, held_out, sample)
    return score(docs, model).select("doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
