"""Near-duplicates by SimHash fingerprints, with pigeonring filtering of candidate pairs.

A fingerprint of B bits is cut into m segments, read as a ring. If two fingerprints differ in at most t
bits, some segment starts a chain whose first l segments differ in at most l * t / m bits, for every l.
Candidates are found by probing the first segment (or two) with all values within its budget; the longer
chains prune them before the full distance is taken.

Equal fingerprints are one node from the start. Tasks hand on spanning links of what they found, never
all pairs; ``graph.components`` joins these up.

``alike`` takes the pairs that this search finds in wide fingerprints, and where it ends those that bands of least
hashes add; the shingle sets themselves decide.
"""

from __future__ import annotations

import itertools
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import by_batch, documents, store
from llm.graph import components

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
# Odd multipliers and shifts that derive further 64-bit hashes from the first (fixed values).
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Pairs that a task looks at together, rows of a block, and rows that a task should get.
PAIRS, BLOCK, ROWS = 1 << 20, 1 << 15, 1 << 17
#: Bytes of shingle sets that weigh as much as one row of a block, and weight of a block of sets.
UNIT, SET_BLOCK = 1 << 10, 1 << 12
#: Bands of least hashes by which sets meet, and hashes of a band.
BANDS, BAND_ROWS = 20, 4
_SEEDS = np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Ring:
    """Segments of a fingerprint of ``words`` 64-bit words, of at most ``limit`` differing bits."""

    words: int
    segments: int
    limit: int

    @property
    def spans(self) -> list[tuple[int, int, int]]:
        """(word, first bit, bits) of each segment; no segment crosses a word."""
        each = self.segments // self.words
        cuts = [round(64 * i / each) for i in range(each + 1)]
        return [(w, a, b - a) for w in range(self.words) for a, b in itertools.pairwise(cuts)]

    def budget(self, length: int) -> int:
        return length * self.limit // self.segments

    def segment(self, prints: np.ndarray, i: int) -> np.ndarray:
        w, a, n = self.spans[i % self.segments]
        return (prints[:, w] >> np.uint64(a)) & np.uint64((1 << n) - 1)

    def near(self, x: np.ndarray, i: int) -> np.ndarray:
        """Which rows of differing bits pass the chains from segment i, then the full distance."""
        keep = np.arange(len(x))
        total = np.zeros(len(x), np.int64)
        for length in range(1, self.segments + 1):
            w, a, n = self.spans[(i + length - 1) % self.segments]
            total += np.bitwise_count((x[keep, w] >> np.uint64(a)) & np.uint64((1 << n) - 1))
            ok = total <= self.budget(length)
            keep, total = keep[ok], total[ok]
        return keep


def masks(bits: int, errors: int) -> list[int]:
    return [sum(1 << b for b in c) for k in range(errors + 1) for c in itertools.combinations(range(bits), k)]


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included; A-Z are lower-cased."""
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower())
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    at = list(itertools.accumulate(map(len, words), lambda p, n: p + n + 1, initial=0))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b - 1], 42) for a, b in zip(at, at[shingle:])], np.uint64)


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """A bit is 1 if it is set in over half the hashes; no hashes: zero."""
    out = np.zeros(words, np.uint64)
    for w in range(words if len(hashes) else 0):
        h = hashes
        if w:
            h = hashes * np.uint64(_MIX[w - 1])
            h ^= h >> np.uint64(31)
            h *= np.uint64(_MIX[w % 3])
            h ^= h >> np.uint64(29)
        ones = np.zeros((8, 8), np.int64)
        for a in range(0, len(h), 1 << 16):
            b = h[a:a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256, dtype=np.uint16)
            ones += np.bincount(b.ravel(), minlength=2048).reshape(8, 256) @ _BITS
        out[w] = np.packbits((2 * ones > len(h)).ravel(), bitorder="little").view("<u8")[0]
    return out


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 4, words: int = 1) -> DataFrame:
    """doc_id, fp (big-endian bytes), size (distinct shingles) of each document; null text counts as empty."""

    def work(batch):
        hashes = (shingle_hashes(t, shingle) for t in batch.column(1).to_pylist())
        found = [(fingerprint(h, words), len(np.unique(h))) for h in hashes]
        return {"doc_id": batch.column(0), "fp": pa.array([f.astype(">u8").tobytes() for f, _ in found], pa.binary()),
                "size": pa.array([n for _, n in found], pa.int64())}

    return by_batch(documents(docs), work, "doc_id long, fp binary, size long")


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the ends of each pair one label, the least row number of what hangs together."""
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _links(ring: Ring, group: np.ndarray, prints: np.ndarray, side: np.ndarray, starts, deep: bool) -> np.ndarray:
    """Labels of rows: near ones of a group share one. Rows of side 0 ask; the others are only found.

    starts: segment from which each row's group is searched (one number, or all). deep: the first segment
    is equal within a group already, and the second is probed.
    """
    label = np.arange(len(group))
    for i in starts:
        j = i + 1 if deep else i
        bits = ring.spans[j % ring.segments][2]
        value = ring.segment(prints, j).astype(np.int64)
        key = (group << bits) | value
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        for mask in masks(bits, ring.budget(2) if deep else ring.budget(1)):
            want = key ^ mask
            ask = np.flatnonzero(side == 0)
            lo, hi = np.searchsorted(sorted_, want[ask], "left"), np.searchsorted(sorted_, want[ask], "right")
            ask, lo, hi = (c[hi > lo] for c in (ask, lo, hi))
            # Partners are order[lo:own] and order[more:hi]; rows of the asker's own label need no look.
            own = more = hi
            while len(ask):
                if (hi - lo).sum() > PAIRS:
                    order = order[np.lexsort((label[order], sorted_))]
                    run = np.searchsorted(sorted_, sorted_, "left") * len(label) + label[order]
                    own, more = (np.searchsorted(run, lo * len(label) + label[ask], side) for side in ("left", "right"))
                n = own - lo + hi - more
                # As many askers as fit the block; one with more partners than that goes alone.
                to = max(1, int(np.searchsorted(np.cumsum(n), PAIRS, "right")))
                m = n[:to]
                a = np.repeat(ask[:to], m)
                b = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m - lo[:to], m)
                b = order[np.where(b < np.repeat(own[:to], m), b, b + np.repeat((more - own)[:to], m))]
                new = (a != b) & (label[a] != label[b])
                a, b = a[new], b[new]
                ok = ring.near(prints[a] ^ prints[b], i)
                _merge(label, a[ok], b[ok])
                ask, lo, hi, own, more = (c[to:] for c in (ask, lo, hi, own, more))
    return label


def _numbers(column: pa.Array, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)


def _spread(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / ROWS)), *keys)


def _search(cells: DataFrame, ring: Ring, deep: bool) -> DataFrame:
    """Links (u, v) from rows (seg, cell, part, side, fp): near fingerprints of equal (seg, cell, part)."""

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        seg, side = (t.column(c).to_numpy() for c in ("seg", "side"))
        where = np.stack([t.column(c).to_numpy() for c in ("seg", "cell", "part")], 1)
        _, group = np.unique(where, axis=0, return_inverse=True)
        prints = _numbers(t.column("fp"), ring.words)
        for s in np.unique(seg):
            own = np.flatnonzero(seg == s)
            starts = [int(s)] if deep else range(ring.segments)
            label = _links(ring, group[own].ravel(), prints[own], side[own], starts, deep)
            moved = np.flatnonzero(label != np.arange(len(label)))
            if len(moved):
                yield pa.RecordBatch.from_arrays(
                    [t.column("fp").take(pa.array(own[x])).combine_chunks() for x in (moved, label[moved])], ["u", "v"])

    return cells.mapInArrow(run, "u binary, v binary")


def _blocks(cells: DataFrame, weight: Column | None = None, node: str = "fp", block: int | None = None) -> DataFrame:
    """Cells of more than ``block`` (BLOCK) rows as pairs of blocks, so that each pair of rows meets in some part.

    The part of a pair of blocks a <= b holds both. The table of large cells has at most rows / block rows.
    weight: what a row counts instead of 1.
    """
    block = min(BLOCK, block or BLOCK)
    large = cells.groupBy("seg", "cell").agg((F.count("*") if weight is None else F.sum(weight)).alias("n")).where(F.col("n") > block)
    names = [c for c in cells.columns if c not in ("seg", "cell")]
    cells = cells.join(large, ["seg", "cell"], "left")
    k = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64(node), k).cast("int")
    many = F.transform(F.sequence(F.lit(0), k - 1), lambda o: F.least(o, F.col("own")) * k + F.greatest(o, F.col("own")))
    cells = cells.select("*", own.alias("own"))
    part = F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(many))
    return cells.select("seg", "cell", part.alias("part"), *names)


def links(prints: DataFrame, ring: Ring) -> DataFrame:
    """Spanning links (u, v) between distinct fingerprints within the limit.

    With limit < segments (the first segment of some chain is equal) rows meet by that segment's value.
    Otherwise each meets all rows of its size band and the next: a band is a factor 1.25 of ``size``, and
    sets whose sizes differ by more are less than 0.8 alike.
    """
    n = prints.count()
    if ring.budget(1) == 0:
        seg = [F.struct(F.lit(i).alias("seg"), F.shiftrightunsigned(
            F.conv(F.substring(F.hex("fp"), 16 * w + 1, 16), 16, -10).cast("long"), a).bitwiseAND(F.lit((1 << b) - 1).cast("long")).alias("cell"))
            for i, (w, a, b) in enumerate(ring.spans)]
        cells = prints.select("fp", F.inline(F.array(*seg))).select("seg", "cell", F.lit(0).alias("side"), "fp")
        copies = ring.segments
    else:
        band = F.floor(F.log(F.greatest(F.col("size"), F.lit(1)).cast("double")) / math.log(1.25)).cast("long")
        cells = prints.select("fp", band.alias("band")).select("fp", F.inline(F.array(
            F.struct(F.col("band").alias("cell"), F.lit(0).alias("side")),
            F.struct((F.col("band") - 1).alias("cell"), F.lit(1).alias("side")))))
        cells = cells.select(F.lit(0).alias("seg"), "cell", "side", "fp")
        copies = 2
    # Each large cell multiplies its rows by its blocks; what it adds is at most square in them.
    return _search(_spread(_blocks(cells), ["seg", "cell", "part"], copies * n), ring, ring.budget(1) == 0)


def groups(docs: DataFrame, shingle: int = 4, words: int = 1, segments: int = 5, limit: int = 4) -> DataFrame:
    """doc_id, fp, component_id: the least doc_id reachable over fingerprints ``limit`` bits apart or less.

    Documents without words have fingerprint zero and link like others. Null text is empty; rows with a null
    id are left out; repeated rows come back as often as given. Whole texts of any length are used.
    """
    ring = Ring(words, segments, limit)
    prints = store(fingerprints(docs, shingle, words), "prints")
    nodes = store(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("size").alias("size")), "nodes")
    roots = components(links(nodes, ring))
    known = nodes.join(roots, nodes["fp"] == roots["u"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    merged = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(merged, "root").select("fp", "component_id")
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def _bands(hashes: np.ndarray) -> np.ndarray:
    """One number per band: a mix of the least values of BAND_ROWS further hashes of the set."""
    least = np.empty(len(_SEEDS), np.uint64)
    for a in range(0, len(_SEEDS), 16):
        h = hashes[None, :] ^ _SEEDS[a:a + 16, None]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(_MIX[1])
        least[a:a + 16] = ((h ^ (h >> np.uint64(29))) * np.uint64(_MIX[2])).min(axis=1)
    out = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        out = (out ^ row) * np.uint64(_MIX[0])
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def shingle_sets(docs: DataFrame, shingle: int, words: int, whole: bool = False) -> DataFrame:
    """doc_id, row (XXH64 of the text), key (digest of the set of shingle hashes), fp (of the set), size; and the
    numbers of its bands (none of an empty set) or, with ``whole``, the sorted set."""

    def work(batch):
        texts = batch.column(1).to_pylist()
        sets = [np.unique(shingle_hashes(t, shingle)).astype("<u8") for t in texts]
        rows = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 42) for t in texts], np.uint64)
        out = {"doc_id": batch.column(0), "row": pa.array(rows.view(np.int64)),
               "key": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
               "fp": pa.array([fingerprint(s, words).astype(">u8").tobytes() for s in sets], pa.binary()),
               "size": pa.array([len(s) for s in sets], pa.int64())}
        if whole:
            return out | {"set": pa.array([s.tobytes() for s in sets], pa.binary())}
        return out | {"bands": pa.array([_bands(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))}

    schema = "doc_id long, row long, key binary, fp binary, size long, "
    return by_batch(documents(docs), work, schema + ("set binary" if whole else "bands array<long>"))


def _sharing(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of some sets have a Jaccard coefficient of 0.8 or more with one; all sorted, none empty."""
    sizes = np.array([len(o) for o in others])
    every = np.concatenate(others)
    at = np.searchsorted(own, every)
    at[at == len(own)] = 0
    both = np.add.reduceat((own[at] == every).astype(np.int64), np.cumsum(sizes) - sizes)
    return 5 * both >= 4 * (len(own) + sizes - both)


def _joined(prints: np.ndarray, size: np.ndarray, limit: int, sets: list[np.ndarray] | None = None,
            label: np.ndarray | None = None) -> np.ndarray:
    """Labels of rows of one cell: linked ones share one. Rows link within ``limit`` bits if the smaller set has 0.8
    of the larger one's size or more and, where sets are given, if these are 0.8 alike or more.

    Rows ask one after another, and only those of other labels; so a group of copies costs one look at each.
    label: what hangs together already.
    """
    label = np.arange(len(size)) if label is None else label.copy()
    for a in range(len(size) - 1):
        b = np.flatnonzero(label != label[a])
        if not len(b):
            break
        b = b[b > a]
        b = b[(5 * size[b] >= 4 * size[a]) & (5 * size[a] >= 4 * size[b])]
        for w in range(prints.shape[1]) if len(b) else ():
            bits = np.bitwise_count(prints[a, w] ^ prints[b, w]) + (bits if w else np.uint16(0))
        b = b[bits <= limit] if len(b) else b
        if len(b) and sets is not None:
            b = b[_sharing(sets[a], [sets[i] for i in b])]
        _merge(label, np.full(len(b), a), b)
    return label


def _first(group: np.ndarray, near: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The place of each row's first row of the same group and the same ``near``."""
    by = np.lexsort((place, near, group))
    new = np.ones(len(by), bool)
    new[1:] = (group[by][1:] != group[by][:-1]) | (near[by][1:] != near[by][:-1])
    out = np.empty(len(by), np.int64)
    out[by] = place[by][new][np.cumsum(new) - 1]
    return out


def _meet(cells: DataFrame, words: int, limit: int, rows: int) -> DataFrame:
    """Spanning links (u, v) between the keys that link in rows (seg, cell, part, key, fp, size and maybe set or near).

    Rows of one ``near`` hang together already; only links beyond that come back.
    """

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        where = np.stack([t.column(c).to_numpy() for c in ("seg", "cell", "part")], 1)
        _, group, n = np.unique(where, axis=0, return_inverse=True, return_counts=True)
        group, size = group.ravel(), t.column("size").to_numpy()
        prints, keys = _numbers(t.column("fp"), words), t.column("key")
        order = np.argsort(group, kind="stable")
        starts = np.cumsum(n) - n
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) - np.repeat(starts, n)
        first = _first(group, t.column("near").to_numpy(), place) if "near" in t.column_names else place
        for g in np.unique(group[first > 0]):
            own = order[starts[g]:starts[g] + n[g]]
            sets = [np.frombuffer(v, "<u8") for v in t.column("set").take(pa.array(own)).to_pylist()] if "set" in t.column_names else None
            label = _joined(prints[own], size[own], limit, sets, first[own])
            moved = np.flatnonzero((label != first[own]) & (first[own] == np.arange(len(own))))
            if len(moved):
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(own[i])).combine_chunks() for i in (moved, label[moved])], ["u", "v"])

    return _spread(cells, ["seg", "cell", "part"], rows).mapInArrow(run, "u binary, v binary")


def alike(docs: DataFrame, shingle: int = 5, words: int = 4, limit: int = 72) -> DataFrame:
    """doc_id, row, key, component_id: the least doc_id reachable over shingle sets with a Jaccard of 0.8 or more; group.

    Pigeonring search finds all pairs of fingerprints that differ in fewer bits than there are segments of 16 bits
    (15 of 256). Further pairs, up to ``limit`` bits, would pass a first segment nearly always; those not joined so far
    meet where a band of BAND_ROWS least hashes is equal; of BANDS bands, sets 0.8 alike have none with a chance
    of 3 in 100,000. What both find forms candidate clusters. Of 256
    bits, sets 0.8 alike differ in 39 on average with a standard deviation of 5.7, in 48 and 6.2 for the
    worst (4 of 5 shingles), so that 72 miss fewer than one pair in ten thousand. Within a cluster whole sets
    are compared. So work grows with the number of alike sets, not with all pairs of a size.

    Equal sets are one node, among them those of all texts without words. Null text is empty; rows with a null id
    are left out; ``row`` (XXH64 of the text) tells texts of one doc_id apart, ``group`` components that share one. Large cells and clusters are dealt
    out as pairs of blocks.
    """
    known = store(shingle_sets(docs, shingle, words), "prints")
    found = components(links(known.where("size > 0").select("fp").distinct(), Ring(words, 4 * words, 4 * words - 1)))
    nodes = known.groupBy("key", "fp", "size", "bands").agg(F.min(F.struct("doc_id", "row")).alias("least"))
    # Sets of near fingerprints share ``print``; the empty set has one of its own.
    nodes = store(nodes.join(found, nodes["fp"] == found["u"], "left").select("key", "fp", "size", "bands", "least", F.when(
        F.col("size") > 0, F.coalesce("root", "fp")).otherwise(F.col("key")).alias("print")), "nodes")
    heads = nodes.groupBy("print").agg(F.min("key").alias("v"), F.count("*").alias("n")).where("n > 1")
    edges = nodes.join(heads, "print").select(F.col("key").alias("u"), "v").where("u <> v")
    cells = nodes.select("key", "fp", "size", F.xxhash64("print").alias("near"), F.posexplode("bands").alias("seg", "cell"))
    n = nodes.count()
    near = components(edges.unionByName(_meet(_blocks(cells, None, "key"), words, limit, BANDS * n)))
    clusters = store(near.select(F.col("u").alias("key"), "root").unionByName(near.select(F.col("root").alias("key"), "root").distinct()), "clusters")
    few = nodes.select("key", "least.*").join(clusters, "key")
    # Only texts in a cluster are read again, and only their sets are moved; each set is in one cluster.
    given = docs.where("doc_id IS NOT NULL").withColumn("row", F.xxhash64(F.coalesce("text", F.lit("")))).select("doc_id", "row", "text")
    given = given.join(few.select("doc_id", "row"), ["doc_id", "row"], "left_semi").dropDuplicates(["doc_id", "row"])
    sets = shingle_sets(given, shingle, words, whole=True).join(clusters, "key")
    sets = store(sets.select(F.lit(0).alias("seg"), F.xxhash64("root").alias("cell"), "key", "fp", "size", "set").dropDuplicates(["key"]), "sets")
    weight = F.greatest(F.lit(1.0), F.col("size") * 8 / UNIT)
    total = sets.agg(F.sum(weight)).first()[0] or 0
    roots = components(_meet(_blocks(sets, weight, "key", SET_BLOCK), words, limit, total))
    named = nodes.join(roots, nodes["key"] == roots["u"], "left").select("key", "least.doc_id", F.coalesce("root", "key").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return known.select("doc_id", "row", "key").join(named.join(least, "root").select("key", "component_id", F.col("root").alias("group")), "key").select(
        "doc_id", "row", "key", "component_id", "group")
