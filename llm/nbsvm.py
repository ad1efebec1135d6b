"""Quality classifier: naive Bayes log-count ratios scale n-gram indicators of a linear hinge-loss model.

An n-gram is a word, or one to three steps of a text's shape: a step is the word's pattern of letters,
capitals, digits and signs, or a mark that it repeats the word before. Indicators are hashed, multiplied
by the log ratio of their counts in good and bad documents, and scaled to length one. A word of more than
PIECE characters counts as consecutive words of that length, so all of it gives steps. Dual coordinate
descent fits the weights; a logistic curve, fitted on rows kept back, turns margins into probabilities.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame

from llm.common import by_batch, documents
from llm.labelled import ROWS, sample
from llm.tokens import Table

BITS, COST, EPOCHS, SHARE, PIECE = 18, 1.0, 12, 5, 64
_RUNS = re.compile(r"(.)\1+")


def _shape(word: str) -> str:
    out = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return _RUNS.sub(r"\1", out)


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


# Hashes of a word and of its shape; common words come from the table.
_words = Table(lambda w: (_digest("w" + w.lower()), _digest("s" + _shape(w))), limit=400_000)
_SAME, _FIRST, _PRIME = _digest("same"), _digest("first"), 0x9E3779B97F4A7C15


def indicators(text: str, bits: int = BITS) -> np.ndarray:
    """Sorted places of the n-grams that occur in the whole text."""
    words = [w[i:i + PIECE] for w in text.split() for i in range(0, len(w), PIECE)]
    if not words:
        return np.array([_FIRST & ((1 << bits) - 1)], np.int64)
    pairs = np.array(list(map(_words.__getitem__, words)), np.uint64)
    word, step = pairs[:, 0], pairs[:, 1].copy()
    step[1:][word[1:] == word[:-1]] = _SAME
    prime = np.uint64(_PRIME)
    two = step[:-1] * prime + step[1:]
    three = two[:-1] * prime + step[2:]
    places = np.concatenate([word, step, two ^ np.uint64(2), three ^ np.uint64(3)]) * prime
    return np.unique((places >> np.uint64(64 - bits)).astype(np.int64))


@dataclass
class Classifier:
    """weights: already times the count ratios; ratios are kept to scale each text to length one."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, places: np.ndarray) -> float:
        size = np.sqrt(np.square(self.ratios[places]).sum())
        return float(self.weights[places].sum() / (size or 1.0)) + self.bias

    def score(self, text: str) -> float:
        z = self.slope * self.margin(indicators(text)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int,
            epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last is the bias) of the hinge-loss model: one dual variable is solved at a time."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + w[size]) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                w[size] += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margin to probability, by Newton steps."""
    good = labels.sum()
    t = np.where(labels == 1, (good + 1) / (good + 2), 1 / (len(labels) - good + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        h = p * (1 - p) + 1e-9
        g = np.array([((p - t) * margins).sum(), (p - t).sum()])
        m = np.array([[(h * margins ** 2).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(m, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def fit_rows(places: list[np.ndarray], labels: np.ndarray, bits: int = BITS) -> Classifier:
    """Every SHARE-th row is kept back for the curve. Without rows of both labels: the label's share."""
    size = 1 << bits
    if len(set(labels.tolist())) < 2:
        good = float(labels.sum())
        return Classifier(np.zeros(size, np.float32), np.ones(size, np.float32), 0.0, 1.0,
                          float(np.log((good + 1) / (len(labels) - good + 1))))
    back = np.arange(len(labels)) % SHARE == 0
    if len(set(labels[back].tolist())) < 2 or len(set(labels[~back].tolist())) < 2:
        back = np.zeros(len(labels), bool)
    counts = np.ones((2, size))
    for i in np.flatnonzero(~back):  # rows kept back must not have made the features that their margins rest on
        counts[labels[i], places[i]] += 1
    seen = counts.sum(0) > 3  # an n-gram of one document says nothing of others
    ratios = np.where(seen, np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum()), 0.0)
    learn = np.flatnonzero(~back)
    rows, values = [places[i] for i in learn], [ratios[places[i]] for i in learn]
    values = [v / (np.sqrt(v @ v) or 1.0) for v in values]
    y = labels[learn] * 2.0 - 1
    share = labels[learn].mean()
    cost = COST * np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    w = descend(rows, values, y, cost, size)
    made = Classifier((w[:size] * ratios).astype(np.float32), ratios.astype(np.float32), float(w[size]), 1.0, 0.0)
    check = np.flatnonzero(back) if back.any() else learn
    made.slope, made.shift = curve(np.array([made.margin(places[i]) for i in check]), labels[check])
    return made


def fit(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, rows: int = ROWS) -> Classifier:
    """Fit on at most ``rows`` labelled documents; their indicators are made in tasks, the weights here."""

    def work(batch):
        places = [indicators(t).astype(np.int32).tobytes() for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "label": batch.column(2), "places": pa.array(places, pa.binary())}

    known = by_batch(sample(docs, labels, label, learn_from, rows).select("doc_id", "text", "label"),
                     work, "doc_id long, label int, places binary").collect()
    known.sort(key=lambda r: r["doc_id"])
    return fit_rows([np.frombuffer(r["places"], np.int32).astype(np.int64) for r in known],
                    np.array([int(r["label"] == 1) for r in known], np.int64))


def scored(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id and score of each whole text (null: empty). Rows with a null id are left out; repeated rows are
    scored each. The classifier's size does not depend on the data."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def work(batch):
        use = shared.value
        return {"doc_id": batch.column(0), "score": pa.array([use.score(t) for t in batch.column(1).to_pylist()], pa.float64())}

    return by_batch(documents(docs), work, "doc_id long, score double")
