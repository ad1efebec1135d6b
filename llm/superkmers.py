"""Removal of word windows that an earlier document has, by super-k-mers dealt to buckets of their minimiser.

A window is WINDOW consecutive words. Its minimiser is the least hash of its GRAM-word parts, a function of the
window's words alone, so equal windows have equal minimisers. Consecutive windows of one minimiser travel as one
string of words to the minimiser's bucket. There words become numbers, and ranks of 1, 2, 4, 8 words by sorting,
two of which make a window's rank: equal ranks are equal windows, exactly. A window goes if its rank has a
smaller doc_id.

What keeps it bounded:

* A task works on CHUNK bytes of text at once. Of equal strings in a chunk only those of the least doc_id are
  dealt out; the others are known to go. A passage in any number of copies sends one string a chunk.
* A first pass adds up the bytes of each minimiser. One of more than a quarter of a bucket is hot: its windows are
  dealt out singly, by their own hash. There are at most four such minimisers a bucket, so their list, which
  tasks get, is 32 bytes a bucket. A minimiser that no chunk holds twice is not counted, as it has one string a chunk.
* Buckets are as many as BUCKET bytes of strings need. One bucket is in memory at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import ROWS, documents

WINDOW, GRAM = 13, 3
#: Bytes of text that a task cuts at once, and bytes of strings of one bucket; a cluster may raise both.
CHUNK, BUCKET = 8 << 20, 16 << 20

_GAP = re.compile(rb"[ \t-\r]")
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_STRINGS, _KNOWN = 0, 1  # kinds of packs


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _B
    return h ^ (h >> np.uint64(29))


def _eight(data: bytes, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))[at]


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number of each word, from its first and last eight bytes and its length; only spreads, never decides."""
    size = (ends - starts).astype(np.uint64)
    padded = bytes(8) + data + bytes(8)
    short = np.minimum(size, np.uint64(8))
    first = _eight(padded, starts + 8) & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.maximum(short, np.uint64(1))))
    last = np.where(size > 8, _eight(padded, ends), np.uint64(0))
    return _mixed(first * _A + _mixed(last + size * _C))


def _along(h: np.ndarray, size: int) -> np.ndarray:
    """A number of each ``size`` consecutive words."""
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _A + h[k:k + n]
    return _mixed(out)


def _least(g: np.ndarray, size: int) -> np.ndarray:
    """Least of each ``size`` consecutive values, by doubling."""
    have = 1
    while have * 2 <= size:
        g, have = np.minimum(g[:-have], g[have:]), have * 2
    return np.minimum(g[:len(g) - (size - have)], g[size - have:]) if have < size else g


def _pieces(text: bytes, window: int, size: int) -> Iterator[tuple[int, bytes]]:
    """A text's words in pieces with the number of their first word; neighbours share window - 1 words."""
    carry, base, at = [], 0, 0
    while at < len(text):
        end = len(text)
        if end - at > size and (gap := _GAP.search(text, at + size)):
            end = gap.start()
        words = carry + text[at:end].split()
        if len(words) >= window:
            yield base, b" ".join(words)
        carry = words[max(0, len(words) - window + 1):]
        base, at = base + len(words) - len(carry), end


def _chunks(batches: Iterator[pa.RecordBatch], window: int, size: int) -> Iterator[list[tuple]]:
    """Pieces (doc_id, row, number of the first word, words) of about ``size`` bytes together.

    A row that a chunk already has (equal doc_id and text) is taken once.
    """
    held, full, seen = [], 0, set()
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            for doc, row, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                if (doc, row) in seen:
                    continue
                seen.add((doc, row))
                for base, words in _pieces(text, window, size):
                    held.append((doc, row, base, words))
                    full += len(words)
                    if full >= size:
                        yield held
                        held, full, seen = [], 0, {(doc, row)}
    if held:
        yield held


class _Cut:
    """Super-k-mers of a chunk: string, owner, first word, windows and route of each."""

    def __init__(self, pieces: list[tuple], window: int, hot: np.ndarray):
        self.data = data = b"\n".join(p[3] for p in pieces) + b"\n"
        buf = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero((buf == 32) | (buf == 10))
        starts = np.concatenate([[0], ends[:-1] + 1])
        ended = buf[ends] == 10
        piece = np.cumsum(ended) - ended
        h = word_hashes(data, starts, ends)
        gram = min(GRAM, window)
        least = _least(_along(h, gram), window - gram + 1)
        inside = np.flatnonzero(piece[:len(least)] == piece[window - 1:])
        mini = least[inside]
        single = np.isin(mini, hot)
        new = np.ones(len(inside), bool)
        apart = (inside[1:] != inside[:-1] + 1) | (piece[inside[1:]] != piece[inside[:-1]])
        new[1:] = apart | (mini[1:] != mini[:-1]) | single[1:] | single[:-1]
        at = np.flatnonzero(new)
        self.n = np.diff(np.append(at, len(inside)))
        first = inside[at]
        self.mini = mini[at]
        self.route = _mixed(self.mini + _C)
        if (alone := single[at]).any():
            self.route[alone] = _along(h, window)[first[alone]]
        self.a, self.b = starts[first], ends[first + self.n + window - 2]
        owner = piece[first]
        self.doc, self.row, base = (np.array([p[i] for p in pieces], np.int64)[owner] for i in range(3))
        self.at = base + first - np.flatnonzero(np.concatenate([[True], ended[:-1]]))[owner]

    def dealt(self) -> np.ndarray:
        """Whether each string is that of the least document of the chunk that has it."""
        out = np.zeros(len(self.n), bool)
        seen: dict[bytes, int] = {}
        order = np.argsort(self.doc, kind="stable")
        for i, a, b, doc in zip(order.tolist(), self.a[order].tolist(), self.b[order].tolist(), self.doc[order].tolist()):
            out[i] = seen.setdefault(self.data[a:b], doc) == doc
        return out


def _sizes(docs: DataFrame, window: int) -> DataFrame:
    """Bytes of strings by minimiser, where a chunk has more than one, and of all (null)."""
    chunk = CHUNK

    def run(batches):
        none = np.zeros(0, np.uint64)
        for pieces in _chunks(batches, window, chunk):
            cut = _Cut(pieces, window, none)
            size = cut.b - cut.a
            order = np.argsort(cut.mini, kind="stable")
            mini = cut.mini[order]
            first = np.flatnonzero(np.concatenate([[True], mini[1:] != mini[:-1]]))
            many = np.diff(np.append(first, len(mini))) > 1
            minis = mini[first].view(np.int64)[many].tolist()
            sums = np.add.reduceat(size[order], first)[many].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([None, *minis], pa.int64()), pa.array([int(size.sum()), *sums], pa.int64())], ["mini", "bytes"])

    return docs.mapInArrow(run, "mini long, bytes long").groupBy("mini").agg(F.sum("bytes").alias("bytes"))


def _pack(parts: list) -> bytes:
    return zstandard.compress(b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts), 6)


def _dealt(docs: DataFrame, window: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """Packs of super-k-mers by bucket: kind, number of strings, and compressed columns."""
    chunk = CHUNK

    def run(batches):
        for pieces in _chunks(batches, window, chunk):
            cut = _Cut(pieces, window, hot)
            bucket = (cut.route % np.uint64(buckets)).astype(np.int64)
            dealt = cut.dealt()
            out = []
            known = np.flatnonzero(~dealt)
            if len(known):
                pack = _pack([cut.doc[known], cut.row[known], cut.at[known], cut.n[known]])
                out.append((int(bucket[known[0]]), _KNOWN, len(known), pack))
            use = np.flatnonzero(dealt)
            use = use[np.argsort(bucket[use], kind="stable")]
            edges = np.flatnonzero(np.diff(bucket[use], prepend=-1, append=-1))
            tag = (cut.route >> np.uint64(32)).astype(np.uint32)
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                i = use[lo:hi]
                words = b"".join([cut.data[a:b] + b"\n" for a, b in zip(cut.a[i].tolist(), cut.b[i].tolist())])
                out.append((int(bucket[i[0]]), _STRINGS, len(i), _pack([cut.doc[i], cut.row[i], cut.at[i], tag[i], words])))
            cols = [list(c) for c in zip(*out)]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["bucket", "kind", "n", "pack"])

    return docs.mapInArrow(run, "bucket long, kind int, n int, pack binary")


def ranks(words: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Ranks of the windows at places ``at`` of a row of word numbers: equal ranks, equal words."""
    def both(a, b):
        return np.unique(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64), return_inverse=True)[1]

    have = 1
    while have * 2 <= window:
        words, have = both(words[:-have], words[have:]), have * 2
    return both(words[at], words[at + window - have]) if have < window else words[at]


def _numbers(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Number of each word of lines of words (equal words, equal numbers), and each line's first word."""
    buf = np.frombuffer(text, np.uint8)
    line = buf == 10
    ends = np.flatnonzero(line | (buf == 32))
    offsets = pa.py_buffer(np.concatenate([[0], ends + 1]).astype(np.int64))
    column = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, offsets, pa.py_buffer(text.replace(b"\n", b" "))])
    firsts = np.flatnonzero(np.concatenate([[True], line[ends][:-1]]))
    return column.dictionary_encode().indices.to_numpy(), firsts


def _spans(table: pa.Table, window: int) -> pa.Table:
    """Runs of windows (doc_id, row, first window, number) of one bucket that a smaller document has too."""
    found, known, texts = [], [], []
    for kind, n, pack in zip(*(table.column(c).to_pylist() for c in ("kind", "n", "pack"))):
        raw = zstandard.decompress(pack)
        doc, row, at = (np.frombuffer(raw, np.int64, n, 8 * n * i) for i in range(3))
        if kind == _KNOWN:
            known.append((doc, row, at, np.frombuffer(raw, np.int64, n, 24 * n)))
        else:
            found.append((doc, row, at, np.frombuffer(raw, np.uint32, n, 24 * n)))
            texts.append(raw[28 * n:])
    out = [known]
    if found:
        doc, row, at, tag = (np.concatenate(c) for c in zip(*found))
        _, same, times = np.unique(tag, return_inverse=True, return_counts=True)
        use = np.flatnonzero(times[same] > 1)  # a minimiser of one string has no window of two documents
        if len(use):
            lines = b"".join(texts).split(b"\n")
            words, firsts = _numbers(b"\n".join([lines[i] for i in use.tolist()]) + b"\n")
            count = np.diff(np.append(firsts, len(words))) - window + 1
            owner = np.repeat(np.arange(len(use)), count)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            rank = ranks(words, firsts[owner] + step, window)
            docs = doc[use][owner]
            least = np.full(rank.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, rank, docs)
            gone = np.flatnonzero(docs > least[rank])
            if len(gone):
                new = np.concatenate([[True], (np.diff(gone) != 1) | (np.diff(owner[gone]) != 0)])
                edge = np.flatnonzero(new)
                lead, size = gone[edge], np.diff(np.append(edge, len(gone)))
                which = use[owner[lead]]
                out.append([(doc[which], row[which], at[which] + step[lead], size)])
    runs = [r for part in out for r in part]
    cols = [np.concatenate(c) for c in zip(*runs)] if runs else [np.zeros(0, np.int64)] * 4
    return pa.table(dict(zip(("doc_id", "row", "at", "n"), cols)))


def _kept(batch: pa.RecordBatch, window: int) -> dict[str, list]:
    out: dict[str, list] = {"doc_id": batch.column(0).to_pylist(), "n_words": [], "n_removed": [], "kept": []}
    for text, runs in zip(batch.column(1).to_pylist(), batch.column(2)):
        words = zstandard.decompress(text).split()
        lost = 0
        if runs.is_valid:
            at, n = (runs.values.field(i).to_numpy() for i in range(2))
            edge = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + n + window - 1, minlength=len(words) + 1)
            stay = np.cumsum(edge[:-1]) == 0
            lost = len(words) - int(stay.sum())
            words = [words[i] for i in np.flatnonzero(stay).tolist()]
        out["n_words"].append(len(words) + lost)
        out["n_removed"].append(lost)
        out["kept"].append(b" ".join(words))
    return out


def _shrunk(rows: DataFrame) -> DataFrame:
    """The rows with compressed texts, as the join that cuts them moves all texts."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                texts = pa.array([zstandard.compress(t, 6) for t in part.column(2).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], ["doc_id", "row", "text"])

    return rows.mapInArrow(run, "doc_id long, row long, text binary")


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept (words joined by one space) of each row with a doc_id.

    A word goes if a window over it also starts in a document with a smaller doc_id, as the texts were given.
    Words are runs of characters other than space and \\t-\\r; null texts have none, and texts of fewer words than
    a window lose none. Texts of any length are worked on in pieces. Repeated rows (equal doc_id) never take words
    from each other; each gets its own row. Rows without a doc_id are left out and take nothing. An empty table
    gives an empty result. Other columns are ignored.
    """
    rows = documents(docs).select("doc_id", F.xxhash64("text").alias("row"), F.col("text").cast("binary").alias("text"))
    limit = BUCKET // 4
    # At most (bytes of all strings) / limit minimisers exceed it.
    sizes = _sizes(rows, window).where((F.col("bytes") > limit) | F.col("mini").isNull()).collect()
    total = sum(r["bytes"] for r in sizes if r["mini"] is None)
    hot = np.array([r["mini"] for r in sizes if r["mini"] is not None], np.int64).view(np.uint64)
    packs = _dealt(rows, window, max(1, -(-total // BUCKET)), np.sort(hot))
    runs = packs.groupBy("bucket").applyInArrow(lambda t: _spans(t, window), "doc_id long, row long, at long, n long")
    # A set: rows repeated in other chunks give the same runs again.
    runs = runs.groupBy("doc_id", "row").agg(F.collect_set(F.struct("at", "n")).alias("runs"))
    both = _shrunk(rows).join(runs, ["doc_id", "row"], "left").select("doc_id", "text", "runs")

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                out = _kept(batch.slice(a, ROWS), window)
                kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], list(kinds))

    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary").withColumn("kept", F.col("kept").cast("string"))
