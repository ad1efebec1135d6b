"""Alignment of two tokenizers' tokens over the same texts, by pointer jumping.

Both tokenizers cut the bytes of one text. Every token points to the farthest-right token that overlaps it, the
first tokenizer's where two end alike. Doubling the pointers (each takes its target's target, all at once) ends
at one token of each connected component, the first tokenizer's last: its number labels the group.

Between two neighbouring token ends lies exactly one overlapping pair, so links are as many as distinct ends.
Counts of linked id pairs go over the whole corpus: a task notes them once for each chunk of CHUNK bytes of text,
with each document's links as numbers of the chunk's pairs. Chunks then get their pairs' counts, so neither texts
nor tokens are shuffled or made twice, and a pair that most documents have is one row a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import pieces, tokens
from llm.common import ROWS, documents, store

#: Bytes of text aligned at once, and of one chunk of pair counts (more where one text is longer).
PART, CHUNK = 1 << 20, 8 << 20


class Pair:
    """Two tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = tokens.encoder(a_path), pieces.Model(b_path)
        library = sentencepiece.SentencePieceProcessor(model_file=b_path)

        def word_ids(word: str) -> bytes:
            """A word behind one mark is what the library takes for a text of its own; others go by merging."""
            alone = len(word) > 1 and word[0] == pieces.MARK and pieces.MARK not in word[1:]
            return np.array(library.encode(word[1:]) if alone else self.b.word_ids(word), "<u4").tobytes()

        self.b.table = tokens.Table(word_ids, pieces.WORDS)
        chars = tokens._byte_chars()
        names = {i: n for n, i in self.a.library.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = pa.array([bytes(chars[c] for c in names.get(i, "")) if set(names.get(i, "")) <= chars.keys() else b""
                                 for i in range(max(names) + 1)], pa.binary())
        self.b_bytes = pa.array(self.b.text, pa.binary())

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(self.a.encode(" " + text), "<u4"), np.frombuffer(self.b.encode(text), "<u4")[1:-1]


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


class Aligned(NamedTuple):
    """Tokens of several texts one after another: ids, ends in bytes, groups, and links by place of both tokens."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    a_at: np.ndarray  # first A token of each text, and one more; likewise below
    b_at: np.ndarray
    group_at: np.ndarray
    link_at: np.ndarray


def labels(a_ends: np.ndarray, b_ends: np.ndarray, a_over: np.ndarray, b_over: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last A token of each token's component; ``a_over`` and ``b_over`` give the token over each byte."""
    n = len(a_ends)
    to_b = b_over[a_ends - 1]
    pointer = np.concatenate([np.where(b_ends[to_b] > a_ends, n + to_b, np.arange(n)), a_over[b_ends - 1]])
    while True:
        further = pointer[pointer]
        if np.array_equal(further, pointer):
            return pointer[:n], pointer[n:]
        pointer = further


def _starts(sizes: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int64)


_NONE = np.zeros(0, "<u4")


def _joined(use: Pair, found: list[tuple]) -> list[tuple]:
    """Of both tokenizers: all ids, each text's first, ends in the bytes that the tokens join to, and these bytes."""
    out = []
    for side, values in enumerate((use.a_bytes, use.b_bytes)):
        ids = np.concatenate([_NONE, *(f[side] for f in found)])
        got = values.take(pa.array(ids.astype(np.int64)))
        ends = np.frombuffer(got.buffers()[1], np.int32, len(ids) + 1)[1:].astype(np.int64) if len(ids) else ids.astype(np.int64)
        out.append((ids, _starts([len(f[side]) for f in found]), ends, memoryview(got.buffers()[2]).cast("B") if len(ids) else memoryview(b"")))
    return out


def _covers(joined: list[tuple], k: int, text: bytes) -> bool:
    """Whether the tokens of the k-th text join to these bytes, by both tokenizers."""
    for _, at, ends, raw in joined:
        lo, hi = (int(ends[i - 1]) if i else 0 for i in (at[k], at[k + 1]))
        if raw[lo:hi] != text:
            return False
    return True


def align(use: Pair, texts: list[str | None]) -> Aligned:
    """Tokens, groups and links of texts. Texts that are empty, or whose tokens do not join to them, have none."""
    found = [use.ids(text) if text else (_NONE, _NONE) for text in texts]
    joined = _joined(use, found)
    bad = [k for k, text in enumerate(texts) if text and not _covers(joined, k, b" " + text.encode())]
    if bad:
        for k in bad:
            found[k] = (_NONE, _NONE)
        joined = _joined(use, found)
    (a, a_at, a_ends, _), (b, b_at, b_ends, _) = joined
    size = int(a_ends[-1]) if len(a_ends) else 0
    a_over, b_over = (np.repeat(np.arange(len(e)), np.diff(e, prepend=0)) for e in (a_ends, b_ends))
    a_label, b_label = labels(a_ends, b_ends, a_over, b_over)
    last = a_label == np.arange(len(a))
    number = np.cumsum(last) - 1
    end = np.zeros(size, bool)
    end[a_ends - 1] = end[b_ends - 1] = True
    links = np.flatnonzero(end)
    groups_before = np.concatenate([[0], np.cumsum(last)])
    bytes_at = np.concatenate([[0], a_ends])[a_at]
    return Aligned(a, b, a_ends, b_ends, number[a_label], number[b_label], a_over[links], b_over[links], a_at, b_at,
                   groups_before[a_at], np.searchsorted(links, bytes_at))


def written(x: Aligned) -> tuple[bytes, np.ndarray]:
    """Groups as ``a1,a2|b1;a3|b2,b3`` with a separator after each text too, and where each text begins."""
    n_groups = int(x.group_at[-1])
    a_many, b_many = (np.cumsum(np.bincount(g, minlength=n_groups)) for g in (x.a_group, x.b_group))
    at = np.concatenate([np.arange(len(x.a)) + np.concatenate([[0], b_many])[x.a_group], np.arange(len(x.b)) + a_many[x.b_group]])
    ids = np.empty(len(at), np.int64)
    ids[at] = np.concatenate([x.a, x.b])
    mark = np.empty(len(at), np.uint8)
    a_last, b_last = (np.diff(g, append=-1) != 0 for g in (x.a_group, x.b_group))
    mark[at] = np.concatenate([np.where(a_last, ord("|"), ord(",")), np.where(b_last, ord(";"), ord(","))])
    wide = max(1, len(str(int(ids.max())))) if len(ids) else 1
    powers = 10 ** np.arange(wide - 1, -1, -1)
    digits = np.maximum(1, np.searchsorted(10 ** np.arange(wide + 1), ids, side="right"))
    table = np.empty((len(ids), wide + 1), np.uint8)
    table[:, :wide] = ids[:, None] // powers % 10 + ord("0")
    table[:, wide] = mark
    size = np.concatenate([[0], np.cumsum(digits + 1)])
    out = table[np.arange(wide + 1) >= wide - digits[:, None]].tobytes()
    return out, size[x.a_at + x.b_at]


def _parts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list]]:
    """doc_ids and texts of about ``size`` characters together."""
    ids, texts, full = [], [], 0
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids.append(doc)
                texts.append(text)
                full += len(text)
                if full >= size or len(ids) >= ROWS:
                    yield ids, texts
                    ids, texts, full = [], [], 0
    if ids:
        yield ids, texts


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, ids of both tokenizers, and arrays of each group's end: bytes of space and text, A and B tokens before it.

    As `aligned` on nulls, empty and other texts without tokens: empty arrays. One map pass.
    """
    part_size = PART

    def run(batches):
        use = pair(a_path, b_path)
        for ids, texts in _parts(batches, part_size):
            x = align(use, texts)
            cols: dict[str, list] = {k: [] for k in ("a_ids", "b_ids", "ends", "a_ends", "b_ends")}
            for k in range(len(ids)):
                (a0, a1), (b0, b1) = x.a_at[k:k + 2], x.b_at[k:k + 2]
                a_last, b_last = (np.flatnonzero(np.diff(g, append=-1)) for g in (x.a_group[a0:a1], x.b_group[b0:b1]))
                base = x.a_ends[a0 - 1] if a0 else 0
                for name, v in zip(cols, (x.a[a0:a1], x.b[b0:b1], x.a_ends[a0:a1][a_last] - base, a_last + 1, b_last + 1)):
                    cols[name].append(v.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(v, pa.list_(pa.int64())) for v in cols.values())], ["doc_id", *cols])

    return documents(docs).mapInArrow(run, "doc_id long, a_ids array<long>, b_ids array<long>, ends array<long>, a_ends array<long>, b_ends array<long>")


_NOTES = ("chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
          "groups_sha256 array<string>, links binary, pairs array<long>, times array<long>")


def noted(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row a chunk: its documents' figures, its id pairs (A id * 2 ** 32 + B id) with their links, and links by pair."""
    part_size, chunk_size = PART, CHUNK

    def run(batches):
        use = pair(a_path, b_path)
        names = [f.split()[0] for f in _NOTES.split(", ")]
        task, done = TaskContext.get().partitionId(), 0
        held: list[list] = [[] for _ in range(6)]
        codes: list[np.ndarray] = []

        def row():
            pairs, place, times = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")  # common pairs get small numbers, which pack well
            number = np.empty(len(order), np.uint32)
            number[order] = np.arange(len(order), dtype=np.uint32)
            links = zstandard.compress(number[place].tobytes(), 3)
            values = [task << 32 | done, *held, links, pairs[order].tolist(), times[order].tolist()]
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), pa.binary(), *[pa.list_(pa.int64())] * 2]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        full = 0
        for ids, texts in _parts(batches, part_size):
            x = align(use, texts)
            raw, at = written(x)
            digests = [hashlib.sha256(raw[lo:hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(at[:-1].tolist(), at[1:].tolist())]
            for column, values in zip(held, (ids, *(np.diff(v).tolist() for v in (x.a_at, x.b_at, x.group_at, x.link_at)), digests)):
                column += values
            codes.append(x.a[x.link_a].astype(np.int64) << 32 | x.b[x.link_b])
            full += len(raw) // 2 + 64 * len(ids)
            if full >= chunk_size:
                yield row()
                done, full, codes = done + 1, 0, []
                held = [[] for _ in range(6)]
        if held[0]:
            yield row()

    return documents(docs).mapInArrow(run, _NOTES)


def _answered(notes: pa.Table, counts: pa.Table) -> pa.Table:
    """Figures of a chunk's documents, with the counts of their links."""
    note = {c: notes.column(c)[0] for c in notes.column_names}
    docs = {c: note[c].values for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    links = np.frombuffer(zstandard.decompress(note["links"].as_py()), np.uint32)
    number = counts.column("number").to_numpy()
    count, best = (np.zeros(len(number), np.int64) for _ in range(2))
    count[number], best[number] = counts.column("links").to_numpy(), counts.column("best").to_numpy()
    at = _starts(docs["n_links"].to_pylist())
    sums = [np.diff(np.concatenate([[0], np.cumsum(v[links])])[at]) for v in (best, count)]
    return pa.table({**docs, "n_best": sums[0], "count_sum": sums[1]})


def pair_counts(notes: DataFrame) -> DataFrame:
    """a_id, b_id and links of every linked id pair, from `noted`."""
    each = notes.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy("pairs").agg(F.sum("times").alias("links"))
    return each.select(F.shiftright("pairs", 32).alias("a_id"), F.col("pairs").bitwiseAND(0xFFFFFFFF).alias("b_id"), "links")


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row with a doc_id.

    ``a_path`` is a byte-level tokenizer of space and text, ``b_path`` a piece model of the text. Texts that are
    null, empty, or whose tokens do not join to space and text (marks of the piece model in a text) have zeros and
    ''. n_best: links whose pair is, over all documents, the most frequent of its B id, with all ties; count_sum:
    sum over links of their pair's count. Repeated rows count each and come back each; rows without a doc_id are
    left out; an empty table gives an empty result; other columns are ignored. A text is aligned whole, in some
    60 bytes of memory a byte of text.
    """
    notes = store(noted(docs, a_path, b_path), "aligned")
    counts = store(pair_counts(notes), "pairs")
    # At most one row for each id of the second tokenizer.
    most = F.broadcast(counts.groupBy("b_id").agg(F.max("links").alias("most")))
    known = counts.join(most, "b_id").select(
        (F.shiftleft("a_id", 32) + F.col("b_id")).alias("pair"), "links", (F.col("links") == F.col("most")).cast("long").alias("best"))
    each = notes.select("chunk", F.posexplode("pairs").alias("number", "pair"))
    answers = each.join(known, "pair").select("chunk", "number", "links", "best")
    rows = notes.drop("pairs", "times").withColumnRenamed("chunk", "own")  # its own name: both sides stem from one table
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return rows.groupBy("own").cogroup(answers.groupBy("chunk")).applyInArrow(_answered, schema)
