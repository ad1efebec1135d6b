"""Encoding and decoding with a byte-pair piece model, by a table of each prefix's last token.

Of all ways to cut a prefix of a word into pieces, merging leaves exactly one. Its last piece is found among
the pieces that end there (an automaton lists them): the one that may stand beside the last piece of the
prefix before it. Two pieces may stand side by side if merging their joined text gives the two again. The
table of last pieces is filled from left to right; read from its end backwards, it gives the word's ids.

Words are what no piece reaches across: a run of marks with the characters after it, or a line break.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from llm.common import by_batch, documents
from llm.tokens import Table

MARK = "▁"
PART, PAIRS, WORDS = 1 << 20, 400_000, 300_000


class Model:
    """A model file without a normalisation of its own: spaces become marks, and one mark is put before."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.scores = {names[i]: sp.get_score(i) for i in plain}
        self.ids = {names[i]: i for i in plain}
        self.names = names
        self.bytes = {int(names[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.text = [b"" if sp.is_control(i) or sp.is_unknown(i) else names[i].replace(MARK, " ").encode() for i in range(n)]
        for b, i in self.bytes.items():
            self.text[i] = bytes([b])
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("pieces with a mark or line break inside are not taken")
        self.chars = {c for p in self.ids for c in p if c in self.ids}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if set(p) <= self.chars:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.word = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        self.pairs: dict[int, bool] = {}  # by a * 2**32 + b
        self.table = Table(lambda w: np.array(self.word_ids(w), "<u4").tobytes(), WORDS)

    def merged(self, text: str) -> list[str]:
        """Merging itself: the best neighbours join first, of equal ones the leftmost."""
        part = list(text)
        left, right = list(range(-1, len(part) - 1)), [*range(1, len(part)), -1]
        heap: list = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (score := self.scores.get(joined := part[a] + part[b])) is not None:
                heapq.heappush(heap, (-score, a, b, len(joined), joined))

        for a in range(len(part) - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, size, joined = heapq.heappop(heap)
            if not part[a] or not part[b] or len(part[a]) + len(part[b]) != size or right[a] != b:
                continue
            part[a], part[b] = joined, ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in part if p]

    def beside(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a."""
        if (known := self.pairs.get(a << 32 | b)) is None:
            known = self.merged(self.names[a] + self.names[b]) == [self.names[a], self.names[b]]
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[a << 32 | b] = known
        return known

    def run_ids(self, run: str) -> list[int]:
        """Ids of characters that all are pieces, without two marks in a row."""
        last: list = [None] * (len(run) + 1)
        pairs = self.pairs
        for end, (piece, size) in self.automaton.iter(run):
            end += 1
            if last[end] is None:
                start = end - size
                if not start:
                    last[end] = piece
                elif (before := last[start]) is not None:
                    ok = pairs.get(before << 32 | piece)
                    if self.beside(before, piece) if ok is None else ok:
                        last[end] = piece
        out, at = [], len(run)
        while at:
            piece = last[at]
            out.append(piece)
            at -= len(self.names[piece])
        return out[::-1]

    def word_ids(self, word: str) -> list[int]:
        if word in self.ids and len(word) == 1:
            return [self.ids[word]]
        if MARK * 2 in word:  # runs of marks score alike, and pieces then depend on more than neighbours
            return [i for p in self.merged(word) for i in self._piece(p)]
        out: list[int] = []
        at = 0
        for i, c in enumerate(word):
            if c not in self.chars:
                out += self.run_ids(word[at:i]) if i > at else []
                out += self._piece(c)
                at = i + 1
        return out + (self.run_ids(word[at:]) if at < len(word) else [])

    def _piece(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.bytes.get(b, self.unknown) for b in piece.encode()]

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, as little-endian unsigned 32-bit bytes."""
        out = [np.array([self.begin], "<u4").tobytes()]
        if text:
            text = MARK + text.replace(" ", MARK)
        at = 0
        while at < len(text):
            to = len(text)
            if to - at > PART and (cut := text.find(MARK, at + PART)) >= 0:
                while text[cut - 1] == MARK and cut > at + 1:  # before the whole run of marks
                    cut -= 1
                to = cut if cut > at + 1 else to
            out.append(b"".join(map(self.table.__getitem__, self.word.findall(text[at:to]))))
            at = to
        out.append(np.array([self.end], "<u4").tobytes())
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Text of ids: marks are spaces, the one put before is taken away."""
        text = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return text.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=4)
def model(path: str) -> Model:
    return Model(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit, with begin and end) of each whole text; null: empty.

    Rows with a null id are left out; repeated rows are encoded each.
    """

    def work(batch):
        use = model(path)
        return {"doc_id": batch.column(0), "ids": pa.array([use.encode(t) for t in batch.column(1).to_pylist()], pa.binary())}

    return by_batch(documents(docs), work, "doc_id long, ids binary")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and text from doc_id and ids."""

    def work(batch):
        use = model(path)
        return {"doc_id": batch.column(0), "ids": batch.column(1), "text": pa.array([use.decode(x) for x in batch.column(1).to_pylist()])}

    return by_batch(ids.select("doc_id", "ids"), work, "doc_id long, ids binary, text string")


