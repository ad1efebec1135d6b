"""Toxicity: a lexicon learnt from labels, matched with spelling errors, weighed by its context.

Terms are words, or stems that many words share, which mark toxic documents. They form a trie. Each word
of a text runs through the union of the terms' Levenshtein automata, intersected with that trie: a state
is the set of trie nodes within reach, each with its least number of errors. States are made when first
reached and kept, so common words cost a look-up. A window around each match tells quotation from abuse:
matches between quotation marks, or next to other matches. A logistic model scores what was counted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import by_batch, documents, store
from llm.labelled import ROWS, sample
from llm.tokens import Table

#: Bounds of the lexicon, of the words cleared of suspicion, and of automaton states kept.
TERMS, CLEARED, STATES = 1_000, 20_000, 100_000
LEAST, STEM, CONTEXT, CAP = 2, (4, 8), 10, 6
# A digit or sign may stand for a word's first letter.
_WORD = re.compile(r"(?:[^\W\d_]|(?<![^\W_])[\d@$*!|](?=[^\W\d_]))(?:[^\W_]|['’@$*!|](?=[^\W\d_]))*|[\"“”„«»]|\n")
_QUOTES = set("\"“”„«»")
#: Counts that the model weighs: plain and misspelt matches, both within quotation marks, and neighbours.
FEATURES = ("exact", "near", "quoted_exact", "quoted_near", "close", "likely")
#: What a word may be.
NONE, EXACT, NEAR, LIKELY, QUOTE, LINE = range(6)
#: A misspelt likely term; it counts as likely.
FAINT = 6
_RANK = {kind: i for i, kind in enumerate((NONE, FAINT, NEAR, LIKELY, EXACT))}


def allowed(term: str) -> int:
    """Errors that a term may be misspelt with: short terms none, long ones two."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class Lexicon:
    """words match whole words, stems match beginnings, both with the errors of their length; likely terms
    are the weaker of both; cleared are words of clean documents, which are no misspelt terms; first: errors
    may be at the first letter, too."""

    words: list[str]
    stems: list[str]
    likely: frozenset[str] = frozenset()
    cleared: frozenset[str] = frozenset()
    first: bool = False
    trie: list[dict[str, int]] = field(default_factory=list)
    limit: list[int] = field(default_factory=list)  # most errors that any term below a node allows
    word_at: dict[int, int] = field(default_factory=dict)  # node -> errors allowed
    stem_at: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.trie, self.limit = [{}], [0]
        self.weak: set[int] = set()
        for term, ends in [*((w, self.word_at) for w in self.words), *((s, self.stem_at) for s in self.stems)]:
            node, errors = 0, allowed(term)
            self.limit[0] = max(self.limit[0], errors)
            for c in term:
                if (after := self.trie[node].get(c)) is None:
                    after = self.trie[node][c] = len(self.trie)
                    self.trie.append({})
                    self.limit.append(0)
                node = after
                self.limit[node] = max(self.limit[node], errors)
            ends[node] = errors
            if term in self.likely:
                self.weak.add(node)
        self.start()

    def start(self) -> None:
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.ends: list[int] = []  # what a word is that ends in the state
        self.begun: list[int] = []  # what a stem is that ends in the state
        self.steps: dict[tuple[int, str], int] = {}
        self.root = self.state({0: 0})

    def __getstate__(self) -> tuple:
        return self.words, self.stems, self.likely, self.cleared, self.first

    def __setstate__(self, state: tuple) -> None:
        self.words, self.stems, self.likely, self.cleared, self.first = state
        self.word_at, self.stem_at = {}, {}
        self.__post_init__()

    def state(self, reach: dict[int, int]) -> int:
        """The number of a set of nodes with errors, after adding what skipped letters of terms reach."""
        todo = list(reach)
        while todo:
            if not (node := todo.pop()) and not self.first:
                continue
            for after in self.trie[node].values():
                errors = reach[node] + 1
                if errors <= self.limit[after] and errors < reach.get(after, 99):
                    reach[after] = errors
                    todo.append(after)
        key = tuple(sorted(reach.items()))
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            for kinds, at in ((self.ends, self.word_at), (self.begun, self.stem_at)):
                ends = [(FAINT if e else LIKELY) if n in self.weak else NEAR if e else EXACT for n, e in key if e <= at.get(n, -1)]
                kinds.append(max(ends, key=_RANK.get, default=NONE))
        return self.states[key]

    def step(self, at: int, c: str) -> int:
        reach: dict[int, int] = {}
        for node, errors in self.sets[at]:
            more = errors + 1
            if not node and not self.first:
                if c in self.trie[0]:
                    reach[self.trie[0][c]] = errors
                continue
            if more <= self.limit[node]:  # a letter too many
                reach[node] = min(more, reach.get(node, 99))
            for letter, after in self.trie[node].items():
                e = errors if letter == c else more  # a wrong letter
                if e <= self.limit[after]:
                    reach[after] = min(e, reach.get(after, 99))
        return self.state(reach)

    def kind(self, word: str) -> int:
        """What a lower-cased word is by its letters alone: EXACT, LIKELY, NEAR, FAINT or NONE."""
        if len(self.sets) > STATES:
            self.start()
        at, found = self.root, NONE
        for c in word:
            if (to := self.steps.get((at, c))) is None:
                to = self.steps[at, c] = self.step(at, c)
            at = to
            found = max(found, self.begun[at], key=_RANK.get)
            if found == EXACT or not self.sets[at]:
                return found
        return max(found, self.ends[at], key=_RANK.get)

    def match(self, word: str) -> int:
        """What a lower-cased word is: EXACT, LIKELY, NEAR or NONE."""
        found = self.kind(word)
        if found in (NEAR, FAINT) and word in self.cleared:
            return NONE
        return LIKELY if found == FAINT else found


class Counter:
    """Counts of one text's matches; a table holds what words were found to be."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.table = Table(self._kind, limit=400_000)

    def _kind(self, word: str) -> int:
        if word in _QUOTES:
            return QUOTE
        if word == "\n":
            return LINE
        word = word.lower()
        # A leading digit or sign stands before a word, or for its first letter.
        return (NONE if word[0].isalpha() else self.lexicon.match(word[1:])) or self.lexicon.match(word)

    def features(self, text: str) -> list[int]:
        kinds = np.array(list(map(self.table.__getitem__, _WORD.findall(text))), np.int8)
        likely = int((kinds == LIKELY).sum())
        at = np.flatnonzero((kinds == EXACT) | (kinds == NEAR))
        if not len(at):
            return [0] * (len(FEATURES) - 1) + [likely]
        # Within a line, a word is quoted after an odd number of marks, if one more follows.
        marks, line = np.cumsum(kinds == QUOTE), np.cumsum(kinds == LINE)
        first = np.searchsorted(line, line[at], "left")
        last = np.searchsorted(line, line[at], "right") - 1
        before = marks[at] - np.where(kinds[first] == QUOTE, marks[first] - 1, marks[first])
        quoted = (before % 2 == 1) & (marks[last] > marks[at])
        exact = kinds[at] == EXACT
        close = np.diff(at) <= CONTEXT
        return [int((exact & ~quoted).sum()), int((~exact & ~quoted).sum()), int((exact & quoted).sum()),
                int((~exact & quoted).sum()), int(close.sum()), likely]


def learn_lexicon(rows: DataFrame, least: int = 5, odds: float = 20.0, sure: float = 100.0,
                  clear: float = 3.0) -> Lexicon:
    """Terms from text and label (0 or 1) of a bounded sample.

    A word or stem (a word's first 4 to 8 letters) is a term if at least ``least`` toxic documents have it
    and its share among toxic documents is ``odds`` times that among clean ones; with less than ``sure``
    times it is only likely. Words of clean documents within the errors of a term are cleared if their share
    among toxic documents is less than ``clear`` times that among clean ones. All lists are bounded, the most
    frequent first.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= LEAST))
    starts = F.transform(F.sequence(F.lit(STEM[0]), F.lit(STEM[1])), lambda n: F.struct(
        F.substring("w", 1, STEM[1]).substr(F.lit(1), n).alias("t"), (F.length("w") > n).alias("ok")))
    per_doc = rows.select(F.monotonically_increasing_id().alias("d"), "label", F.explode(words).alias("w"))
    # Stems carry a mark, so that a word and a stem of the same letters are counted apart.
    terms = per_doc.select("d", "label", F.explode(F.concat(F.array(F.col("w")), F.transform(
        F.filter(starts, lambda s: s["ok"]), lambda s: F.concat(s["t"], F.lit("*"))))).alias("t")).distinct()
    both = rows.agg(F.sum("label").alias("toxic"), F.count("*").alias("all")).first()
    toxic, clean = both["toxic"] or 0, (both["all"] or 0) - (both["toxic"] or 0)
    if not toxic or not clean:
        return Lexicon([], [])
    counts = terms.groupBy("t").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    ratio = (F.col("a") / toxic) / ((F.col("b") + 0.5) / clean)
    strong = counts.where(F.col("a") >= least).select("t", "a", ratio.alias("r")).where(F.col("r") >= odds)
    found = strong.orderBy(F.desc("a"), "t").limit(TERMS * 8).collect()
    # Of stems that begin with one another the shortest holds, sure ones first. Words stay beside their stems,
    # as they may be misspelt in more letters. A stem of a single word is left to that word.
    words_ = [(r["t"], r["r"] >= sure) for r in found if not r["t"].endswith("*")]
    stems: dict[str, bool] = {}
    for stem, certain in sorted(((r["t"][:-1], r["r"] >= sure) for r in found if r["t"].endswith("*")), key=lambda x: (not x[1], len(x[0]), x[0])):
        if sum(w.startswith(stem) for w, _ in words_) != 1 and not any(stem.startswith(s) for s in stems):
            stems[stem] = certain
    terms_ = [dict(sorted(words_, key=lambda x: not x[1])[:TERMS]), dict(list(stems.items())[:TERMS])]
    weak = frozenset(t for d in terms_ for t, certain in d.items() if not certain)
    lexicon = Lexicon(sorted(terms_[0]), sorted(terms_[1]), weak, first=True)

    def near(batch):
        found = pa.array([lexicon.kind(w) in (NEAR, FAINT) for w in batch.column(0).to_pylist()], pa.bool_())
        return {"w": batch.column(0).filter(found), "b": batch.column(1).filter(found)}

    seen = counts.where("b > 0 AND NOT endswith(t, '*')").where((F.col("a") / toxic) < clear * (F.col("b") / clean))
    cleared = by_batch(seen.select("t", "b"), near, "w string, b long").orderBy(F.desc("b"), "w").limit(CLEARED).collect()
    return Lexicon(lexicon.words, lexicon.stems, weak, frozenset(r["w"] for r in cleared), True)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Weights (the last is the bias) by Newton steps; a small ridge keeps separable data finite."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.diag([ridge] * (len(w) - 1) + [1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + keep @ w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -3, 3)
        if abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, features: list[int]) -> float:
        z = np.minimum(features, CAP) @ self.weights[:-1] + self.weights[-1]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, rows: int = ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents.

    Two variants of each toxic document stand for what labels hold too rarely: its matches misspelt (still
    toxic) and its matches quoted (not toxic); they count a tenth. No toxic or no clean rows: share only.
    """
    known = store(sample(docs, labels, label, learn_from, rows).select("text", (F.col("label") == 1).cast("int").alias("label")), "toxic")
    lexicon = learn_lexicon(known)

    def work(batch):
        count = Counter(lexicon)
        return {"label": batch.column(1), "f": pa.array([count.features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.int32()))}

    # Kinds of rows, not rows: counts beyond CAP are alike.
    kinds = by_batch(known, work, "label int, f array<int>").groupBy(
        "label", F.transform("f", lambda v: F.least(v, F.lit(CAP))).alias("f")).count().collect()
    if not kinds:
        return Model(lexicon, np.array([0.0] * len(FEATURES) + [-2.0]))
    x, y, n = (np.array(c, float) for c in zip(*[(r["f"], r["label"], r["count"]) for r in sorted(kinds, key=lambda r: (r["label"], r["f"]))]))
    toxic = (y == 1) & (x[:, 0] > 0)
    misspelt, quoted = x[toxic][:, [1, 0, 3, 2, 4, 5]], x[toxic][:, [2, 3, 0, 1, 4, 5]]
    x = np.vstack([x, misspelt, quoted])
    y = np.concatenate([y, np.ones(len(misspelt)), np.zeros(len(quoted))])
    return Model(lexicon, logistic(x, y, np.concatenate([n, n[toxic] / 10, n[toxic] / 10])))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the counts of each whole text (null: empty, no match).

    Rows with a null id are left out; repeated rows are scored each. The model's size is bounded.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held: dict[str, Counter] = {}

    def work(batch):
        use = shared.value
        count = held.get("counter") or held.setdefault("counter", Counter(use.lexicon))
        found = [count.features(t) for t in batch.column(1).to_pylist()]
        columns = {n: pa.array([f[i] for f in found], pa.int64()) for i, n in enumerate(FEATURES)}
        return {"doc_id": batch.column(0), "score": pa.array([use.score(f) for f in found], pa.float64()), **columns}

    return by_batch(documents(docs), work, "doc_id long, score double, " + ", ".join(f"{n} long" for n in FEATURES))
