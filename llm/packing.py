"""Packing token sequences into windows by non-negative least squares on their length histogram.

A document's ids are cut into whole windows and a rest. All ways to fill a window with two or three rests
are enumerated; a non-negative least-squares fit says how often to use each so that the counts of the
histogram come out; the fit is rounded, and what it leaves over is packed greedily, cut at window ends.

Only histogram and plan, whose sizes depend on the window alone, pass through the driver.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import by_batch, documents, store
from llm.tokens import encoder

STEPS = 6_000


def shapes(window: int) -> np.ndarray:
    """All multisets of two or three lengths that fill a window, ascending, unused places 0."""
    two = np.arange(1, window // 2 + 1)
    rows = [np.stack([np.zeros_like(two), two, window - two], 1)]
    for a in range(1, window // 3 + 1):
        b = np.arange(a, (window - a) // 2 + 1)
        rows.append(np.stack([np.full_like(b, a), b, window - a - b], 1))
    return np.concatenate(rows)


def fit(histogram: np.ndarray, ways: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeats of each way, >= 0, by coordinate descent on |uses @ x - histogram|^2, steepest way first.

    histogram[l]: pieces of length l; place 0 stays empty. A way's norm counts equal lengths together.
    """
    left = histogram.astype(float)
    left[0] = 0
    x = np.zeros(len(ways))
    flat = ways.ravel()
    order = np.argsort(flat, kind="stable")
    users = np.split(order // ways.shape[1], np.cumsum(np.bincount(flat, minlength=len(left)))[:-1])
    same = sum(((ways[:, i] == ways[:, j]) & (ways[:, i] > 0)) * 2.0 for i, j in ((0, 1), (0, 2), (1, 2)))
    norm = (ways > 0).sum(1) + same
    root = np.sqrt(norm)
    gradient = left[ways].sum(1)
    for _ in range(steps):
        gain = np.maximum(gradient / norm, -x)
        best = int(np.argmax(np.abs(gain) * root))
        step = gain[best]
        if abs(step) < 0.5:
            break
        x[best] += step
        for length in ways[best][ways[best] > 0]:
            np.subtract.at(gradient, users[length], step)
    return x


@dataclass
class Plan:
    """Slots of each length: pieces number first..first+n-1 go to sequences from ``sequence`` on, at ``offset``."""

    window: int
    slots: dict[int, np.ndarray]  # length -> rows (first, sequence, offset), by first
    taken: np.ndarray  # pieces of each length that ways take
    rest_at: np.ndarray  # where in the stream of left-over pieces each length starts
    rest_base: int  # the sequence in which that stream starts

    def place(self, length: int, number: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, tokens) of the parts of the piece with this number within its length."""
        if number < self.taken[length]:
            rows = self.slots[length]
            first, sequence, offset = rows[np.searchsorted(rows[:, 0], number, "right") - 1]
            return [(int(sequence + number - first), int(offset), length)]
        at = int(self.rest_at[length]) + (number - int(self.taken[length])) * length
        row, offset = divmod(at, self.window)
        head = min(length, self.window - offset)
        out = [(self.rest_base + row, offset, head)]
        return out if head == length else [*out, (self.rest_base + row + 1, 0, length - head)]


def plan(histogram: np.ndarray, window: int) -> Plan:
    """histogram[l] for l = 1..window; whole windows come first, then the ways, then the stream of the rest."""
    ways = shapes(window)
    x = fit(histogram[:window], ways)
    left = histogram.astype(np.int64).copy()
    left[0] = left[window] = 0
    sequence, numbers = int(histogram[window]), np.zeros(window + 1, np.int64)
    slots: dict[int, list] = {}
    for j in np.argsort(-x, kind="stable")[: int((x >= 0.5).sum())]:
        lengths, uses = np.unique(ways[j][ways[j] > 0], return_counts=True)
        n = min(int(np.rint(x[j])), int((left[lengths] // uses).min()))
        if n <= 0:
            continue
        offset = 0
        for length in ways[j][ways[j] > 0][::-1]:
            slots.setdefault(int(length), []).append((int(numbers[length]), sequence, offset))
            numbers[length] += n
            offset += int(length)
        left[lengths] -= n * uses
        sequence += n
    at = np.zeros(window + 1, np.int64)
    size = left[::-1] * np.arange(window, -1, -1)  # longest first
    at[::-1] = np.cumsum(size) - size
    return Plan(window, {k: np.array(v, np.int64) for k, v in slots.items()}, numbers, at, sequence)


def cut(docs: DataFrame, tokenizer: str, window: int, end_id: int) -> DataFrame:
    """Per document: its whole windows' checksums, its rest's ids, and numbers within the task's lengths."""

    def run(batches):
        encode = encoder(tokenizer).encode
        end = np.array([end_id], "<u4").tobytes()
        seen = np.zeros(window + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) + end
                whole, rest = divmod(len(ids) // 4, window)
                sums = [zlib.crc32(ids[4 * window * k:4 * window * (k + 1)]) for k in range(whole)]
                rows.append((doc_id, len(ids) // 4, part, sums, int(seen[window]), rest, int(seen[rest]), ids[4 * window * whole:]))
                seen[window] += whole
                seen[rest] += rest > 0
            names = ["doc_id", "doc_tokens", "part", "sums", "first", "rest", "number", "ids"]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    schema = "doc_id long, doc_tokens long, part int, sums array<long>, first long, rest int, number long, ids binary"
    return documents(docs).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """doc_id, start, doc_tokens, ids (little-endian unsigned 32-bit; null for whole windows), ids_crc32,
    length, sequence_id, offset of every piece.

    Null and empty texts are the end id alone. Rows with a null id are left out. Repeated rows are packed as
    often as they come. Pieces of equal length are alike, so ties fall by task and place. No rows: no pieces.
    Sequences are filled to the window; only the very last may be shorter.
    """
    pieces = store(cut(docs, tokenizer, window, end_id), "pieces")
    counts = pieces.where("rest > 0").groupBy("part", F.col("rest").alias("length")).agg(F.count("*").alias("n")).unionByName(
        pieces.where("size(sums) > 0").groupBy("part").agg(F.sum(F.size("sums")).alias("n")).withColumn("length", F.lit(window)))
    counts = store(counts, "counts")
    histogram = np.zeros(window + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    made = plan(histogram, window)
    # Pieces of a length before each task's own: one row per task and length, whatever the rows.
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    bases = bases.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "base"))).alias("bases"))
    ready = pieces.join(bases, "part").select(
        "doc_id", "doc_tokens", "sums", "rest", "ids", (F.col("first") + F.coalesce(F.col("bases")[window], F.lit(0))).alias("first"),
        (F.col("number") + F.coalesce(F.col("bases")[F.col("rest")], F.lit(0))).alias("number"))

    def work(batch):
        out = []
        for r in batch.to_pylist():
            for k, crc in enumerate(r["sums"]):
                out.append((r["doc_id"], k * window, window, crc, r["doc_tokens"], r["first"] + k, 0, None))
            at = 0
            for sequence, offset, n in made.place(r["rest"], r["number"]) if r["rest"] else ():
                ids = r["ids"][4 * at:4 * (at + n)]
                out.append((r["doc_id"], len(r["sums"]) * window + at, n, zlib.crc32(ids), r["doc_tokens"], sequence, offset, ids))
                at += n
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return {n: pa.array(c, pa.int64() if n != "ids" else pa.binary()) for n, c in zip([*names, "ids"], zip(*out))}

    return by_batch(ready, work, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
