"""Suffix-array removal of passages that also start in an earlier document.

Every passage of ``length`` bytes (a window) has an anchor: of the ``gram``-byte strings in it the one with
the least hash, the leftmost of equals. Equal windows have equal anchors, so a window whose anchor no other
document has is unique. Windows with one anchor follow one another; they make a context of at most
2 * length bytes. The work, over packs of whole documents that tasks keep in shared files:

1. Each pack names the hashes of its anchors; shards by hash answer which ones occur elsewhere.
2. Each pack sends the distinct contexts of those anchors, with the least doc_id of each, to shards. An
   anchor with very many contexts sends its windows one by one instead, so no shard gets too much.
3. A shard takes equal contexts as one. The windows of a context all differ, so a context that is the only one
   of its anchor has no window in common with any other. Of the rest, the shard sorts the suffixes by
   Larsson-Sadakane refinement, takes common prefixes as Kasai does, and so finds equal windows. Blocks hold whole
   anchors; those of an anchor too large for one are merged by binary search in their sorted windows. It answers
   for each window whether a smaller doc_id has it.
4. Each pack marks the bytes of the windows found and cuts them out.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import documents, filesystem, shared_folder, store

PACK, BUCKET, CROWD = 1 << 21, 1 << 22, 20_000
#: Bits of a place in a block of a shard, and contexts of a block, which have fewer symbols than that.
_PLACE, BLOCK = 21, 24_000
_BASE = 0x9E3779B97F4A7C15 | 1
_LOW = 16  # bits of a place within a segment, whose arrays should fit a processor's cache


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for one segment."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full((1 << _LOW) + 1, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _sums(raw: np.ndarray) -> np.ndarray:
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers()[0][: len(raw)], out=out[1:])
    return out


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _mix((sums[end] - sums[start]) * _powers()[1][start])


@dataclass
class Runs:
    """Runs of windows with one anchor: first and last start, document, hashes of anchor and context."""

    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    anchor: np.ndarray
    context: np.ndarray


def runs(raw: np.ndarray, ends: np.ndarray, length: int, gram: int) -> Runs:
    """Runs of all windows within documents that end at ``ends``; long inputs go by segments."""
    found = []
    width = length - gram + 1
    begins = ends - np.diff(ends, prepend=0)
    beyond = np.maximum(begins, ends - length + 1)  # the first place of a document where no window starts
    edges = np.unique(np.concatenate([begins, beyond]))
    size = (1 << _LOW) - length
    places = np.arange(1 << _LOW, dtype=np.uint64)
    low = np.uint64((1 << _LOW) - 1)
    for at in range(0, max(1, len(raw)), size):
        part = raw[at:at + size + length - 1]
        if len(part) < length:
            continue
        sums = _sums(part)
        n = len(part) - gram + 1
        grams = _mix((sums[gram:] - sums[:-gram]) * _powers()[1][:n])
        least = grams & ~low
        least |= places[:n]
        have = 1
        while have < width:
            more = min(have, width - have)
            least = np.minimum(least[:-more], least[more:])
            have += more
        new = np.append(True, least[1:] != least[:-1])
        lo, hi = np.searchsorted(edges, [at, at + len(least)])
        new[edges[lo:hi] - at] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(least)) - 1
        doc = np.searchsorted(ends, first + at, "right")
        inside = first + at < beyond[doc]
        first, last, doc = first[inside], last[inside], doc[inside]
        # Least hashes have low values; mixed once more they deal evenly.
        found.append((first + at, last + at, doc, _mix(grams[(least[first] & low).astype(np.int64)]),
                      _hash(sums, first, last + length) ^ (last - first).astype(np.uint64)))
    if not found:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    return Runs(*(np.concatenate(c) for c in zip(*found)))


def _zip(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unzip(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def _packed(docs: DataFrame, folder: str, pack_bytes: int) -> DataFrame:
    """Write packs of whole documents; one row (pack, path, at, size, bytes) each. A file gets a fresh name
    and is named only by the attempt that finished, so a task may run again."""

    def run(batches):
        fs, path = filesystem(folder)
        part = TaskContext.get().partitionId()
        name = f"{path}/{part:06d}-{uuid.uuid4().hex}.pack"
        out, at, n, held, size = None, 0, 0, [], 0
        rows = []

        def flush():
            nonlocal out, at, n, size
            if out is None:
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(name, compression=None)
            ids, texts = zip(*held)
            body = _zip(np.array([len(ids)], "<i8").tobytes() + np.array(ids, "<i8").tobytes()
                        + np.array([len(t) for t in texts], "<i8").tobytes() + b"".join(texts))
            out.write(body)
            rows.append((part << 32 | n, name, at, len(body), size))
            at, n, size = at + len(body), n + 1, 0
            held.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((doc_id, text.encode("utf-8", "surrogatepass")))
                size += len(held[-1][1])
                if size >= pack_bytes or len(held) >= 1 << 16:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["pack", "path", "at", "size", "bytes"])

    return store(documents(docs).mapInArrow(run, "pack long, path string, at long, size long, bytes long"), "packs")


@dataclass
class Pack:
    ids: np.ndarray
    ends: np.ndarray
    raw: np.ndarray


def _load(fs, path: str, at: int, size: int) -> Pack:
    with fs.open_input_file(path) as f:
        f.seek(at)
        body = _unzip(f.read(size))
    n = int(np.frombuffer(body, "<i8", 1)[0])
    return Pack(np.frombuffer(body, "<i8", n, 8), np.cumsum(np.frombuffer(body, "<i8", n, 8 + 8 * n)),
                np.frombuffer(body, np.uint8, -1, 8 + 16 * n))


@dataclass(frozen=True)
class Job:
    folder: str
    length: int
    gram: int
    buckets: int

    def anchors(self, pack: Pack) -> tuple[Runs, np.ndarray, np.ndarray, np.ndarray]:
        """Runs, and of the distinct anchors: ascending hashes, bucket, and the place of each run's anchor."""
        found = runs(pack.raw, pack.ends, self.length, self.gram)
        hashes, of = np.unique(found.anchor, return_inverse=True)
        return found, hashes, self.bucket(hashes), of.ravel()

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        """Buckets are ranges of hashes."""
        return ((hashes >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)

    def notes(self, pack: Pack, found: Runs, of: np.ndarray, n: int) -> np.ndarray:
        """Per distinct anchor: the number of its contexts, and the highest bit if several documents have it."""
        out = np.ones(n, np.uint8)
        own = np.flatnonzero(np.bincount(of, minlength=n)[of] > 1)
        if not len(own):
            return out
        own = own[np.lexsort((found.context[own], of[own]))]
        ids, anchor, context = pack.ids[found.doc[own]], of[own], found.context[own]
        begin = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        several = np.minimum.reduceat(ids, begin) != np.maximum.reduceat(ids, begin)
        kinds = np.add.reduceat(np.append(True, (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])).astype(np.int64), begin)
        out[anchor[begin]] = np.minimum(kinds, 127).astype(np.uint8) | (several.astype(np.uint8) << 7)
        return out

    def contexts(self, pack: Pack, answers: list) -> tuple:
        """Distinct contexts of shared anchors, by bucket: start, windows, least doc, bucket; and per run with
        windows to ask for: its first start, windows, document and place among the contexts."""
        found, hashes, bucket, of = self.anchors(pack)
        shared, crowd = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
        begin = np.searchsorted(bucket, np.arange(self.buckets + 1))
        for b, bits in answers:
            got = np.unpackbits(np.frombuffer(bits, np.uint8)).reshape(2, -1)[:, : begin[b + 1] - begin[b]].astype(bool)
            shared[begin[b]:begin[b + 1]], crowd[begin[b]:begin[b + 1]] = got
        own = np.flatnonzero(shared[of])
        many = crowd[of[own]]
        whole, split = own[~many], own[many]
        count = found.last - found.first + 1
        each = np.repeat(split, count[split])
        start = np.concatenate([found.first[whole], found.first[each] + _ramp(count[split])])
        windows = np.concatenate([count[whole], np.ones(len(each), np.int64)])
        doc = np.concatenate([found.doc[whole], found.doc[each]])
        single = _digests(pack.raw, start[len(whole):], self.length)
        first = np.concatenate([found.anchor[whole], single])
        second = np.concatenate([found.context[whole], np.zeros(len(each), np.uint64)])
        order = np.lexsort((pack.ids[doc], second, first))
        f, s, w = first[order], second[order], windows[order]
        new = np.ones(len(order), bool)
        new[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1]) | (w[1:] != w[:-1])
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        head = order[new]
        return (start[head], windows[head], pack.ids[doc[head]], self.bucket(first[head]),
                first[head], start, windows, doc, at)


def _ramp(counts: np.ndarray) -> np.ndarray:
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _digests(raw: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows at the given ascending starts, by segments."""
    out = np.zeros(len(start), np.uint64)
    size = (1 << _LOW) - length
    for at in range(0, len(raw), size):
        a, b = np.searchsorted(start, [at, at + size])
        if a < b:
            out[a:b] = _hash(_sums(raw[at:at + size + length]), start[a:b] - at, start[a:b] - at + length)
    return out


def sort_suffixes(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array to ``depth`` symbols; code 0 ends a text, and suffixes equal to that end keep their order.

    Larsson-Sadakane: all suffixes are ranked by their first symbols; groups that still hold several are
    refined by the ranks ``known`` symbols on, which doubles what is known each time.
    """
    n, known = len(codes), 4
    if n > 1 << _PLACE:
        raise ValueError("a block holds too many symbols")
    # Groups, ranks and places share one integer, so that a plain sort of numbers orders all three.
    place = (1 << _PLACE) - 1
    key = np.zeros(n, np.int64)
    ended = np.zeros(n, bool)  # within the known symbols: such a suffix is told from others already
    for k in range(known):
        key[: n - k] |= codes[k:].astype(np.int64) << (9 * (known - 1 - k))
        ended[: n - k] |= codes[k:] == 0
    ended[n - known:] = True
    packed = np.sort(key << _PLACE | np.arange(n))
    order = packed & place
    new = np.append(True, np.diff(packed >> _PLACE) != 0)[:n]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while known < depth:
        several = ~(new & np.append(new[1:], True))  # by place in the order
        at = np.flatnonzero(several & ~ended[order])  # a group is ended as a whole or not at all
        if not len(at):
            break
        suffix = order[at]
        packed = np.sort(rank[suffix] << 2 * _PLACE | rank[np.minimum(suffix + known, n - 1)] << _PLACE | suffix)
        order[at] = suffix = packed & place
        fresh = np.append(True, np.diff(packed >> _PLACE) != 0)
        new[at] |= fresh
        rank[suffix] = np.maximum.accumulate(np.where(fresh, at, 0))
        ended[:-known] |= ended[known:].copy()
        known *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray, start: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix shares ``length`` bytes with the one before it in the order (by place in the order).

    As Kasai does, a text's suffixes go from left to right, and the next shares at most one byte less with
    its neighbour; all contexts advance together. Only starts of windows are looked at.
    """
    same = np.zeros(len(order), bool)
    have = np.zeros(len(start), np.int64)
    for j in range(int(windows.max()) if len(windows) else 0):
        lane = np.flatnonzero(windows > j)
        at = start[lane] + j
        place = rank[at]
        lane, at, place = lane[place > 0], at[place > 0], place[place > 0]
        before = order[place - 1]
        h = np.maximum(have[lane] - 1, 0)
        go = np.arange(len(lane))
        while len(go):
            equal = text[at[go] + h[go]] == text[before[go] + h[go]]
            equal &= text[at[go] + h[go]] > 0
            go = go[equal]
            h[go] += 1
            go = go[h[go] < length]
        have[:] = 0
        have[lane] = h
        same[place] = h >= length
    return same


def least_docs(raw: np.ndarray, start: np.ndarray, windows: np.ndarray, docs: np.ndarray, length: int, block: int = BLOCK) -> np.ndarray:
    """The least doc of each window's text over all contexts: one value per window, context by context.

    raw: contexts end to end, each ``windows + length - 1`` bytes from ``start``.
    """
    out, keys = [], []
    for a in range(0, len(start), block):
        w, n = windows[a:a + block], windows[a:a + block] + length - 1
        codes = np.zeros(int((n + 7).sum()), np.uint16)
        begin = np.cumsum(n + 7) - (n + 7)
        codes[np.repeat(begin, n) + _ramp(n)] = raw[np.repeat(start[a:a + block], n) + _ramp(n)].astype(np.uint16) + 1
        # Contexts are at most twice the window: sorted to that depth, only suffixes equal to their ends tie.
        order = sort_suffixes(codes, 2 * length)
        at = np.repeat(begin, w) + _ramp(w)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        same = common_prefixes(codes, order, place, begin, w, length)
        group = np.cumsum(~same)[place[at]]
        least = np.full(int(group.max()) + 1 if len(group) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, group, np.repeat(docs[a:a + block], w))
        out.append(least[group])
        if len(start) > block:
            text = np.empty((len(at), length + 1), np.uint8)
            text[:, length] = 1  # keeps zero bytes at the end of a window
            for k in range(length):
                text[:, k] = (codes[at + k] - 1).astype(np.uint8)
            keys.append(text.view(f"S{length + 1}").ravel())
    if len(keys) > 1:
        tables = []
        for key, least in zip(keys, out):
            kinds, first = np.unique(key, return_index=True)
            tables.append((kinds, least[first]))
        for i, key in enumerate(keys):
            for j, (kinds, least) in enumerate(tables):
                if i != j:
                    at = np.minimum(np.searchsorted(kinds, key), len(kinds) - 1)
                    out[i] = np.where(kinds[at] == key, np.minimum(out[i], least[at]), out[i])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def least_by_anchor(raw: np.ndarray, start: np.ndarray, windows: np.ndarray, docs: np.ndarray, keys: np.ndarray, length: int,
                    block: int = BLOCK) -> np.ndarray:
    """As ``least_docs``, for distinct contexts in ascending order of the hashes of their anchors."""
    out = np.repeat(docs, windows)
    again = np.append(False, keys[1:] == keys[:-1])
    several = np.flatnonzero(again | np.append(again[1:], False))
    if not len(several):
        return out
    place = np.cumsum(windows) - windows
    ends = np.append(np.flatnonzero(np.diff(keys[several])) + 1, len(several))
    a = 0
    while a < len(several):
        b = ends[max(np.searchsorted(ends, a + block, "right") - 1, np.searchsorted(ends, a, "right"))]
        own = several[a:b]
        out[np.repeat(place[own], windows[own]) + _ramp(windows[own])] = least_docs(raw, start[own], windows[own], docs[own], length, block)
        a = b
    return out


def _each_pack(rows: DataFrame, job: Job, work, schema: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        fs, _ = filesystem(job.folder)
        for batch in batches:
            for row in batch.to_pylist():
                out = work(_load(fs, row["path"], row["at"], row["size"]), row)
                if out is not None and len(out[0]):
                    yield pa.RecordBatch.from_arrays(out, names)

    return rows.mapInArrow(run, schema)


def _each_bucket(rows: DataFrame, buckets: int, work, schema: str) -> DataFrame:
    """Hand a bucket's rows (bucket, pack, body) together to ``work``; one task may hold several buckets."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for bucket, pack, body in zip(*(batch.column(c).to_pylist() for c in ("bucket", "pack", "body"))):
                held.setdefault(bucket, []).append((pack, body))
        for bucket in sorted(held):
            bodies = sorted(held.pop(bucket), key=lambda x: x[0])
            answers = work([b for _, b in bodies])
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in bodies], pa.int64()),
                                              pa.array([bucket] * len(bodies), pa.int32()), pa.array(answers, pa.binary())], names)

    return rows.repartition(buckets, "bucket").mapInArrow(run, schema)


def _which_shared(bodies: list[bytes], crowd: int) -> list[bytes]:
    """Per pack: bits of its anchors that occur in another document, then bits of crowded ones."""
    hashes, notes = [], []
    for body in bodies:
        body = _unzip(body)
        n = len(body) // 9
        hashes.append(np.frombuffer(body, "<u8", n))
        notes.append(np.frombuffer(body, np.uint8, n, 8 * n))
    size = [len(h) for h in hashes]
    _, of = np.unique(np.concatenate(hashes), return_inverse=True)
    note = np.concatenate(notes)
    packs = np.bincount(of.ravel())
    several = np.zeros(len(packs), bool)
    np.logical_or.at(several, of.ravel(), note > 127)
    contexts = np.bincount(of.ravel(), weights=(note & 127).astype(float))
    bits = np.stack([(packs > 1) | several, contexts > crowd])[:, of.ravel()].astype(np.uint8)
    out, at = [], 0
    for n in size:
        part = np.zeros((2, -(-n // 8) * 8), np.uint8)
        part[:, :n] = bits[:, at:at + n]
        out.append(np.packbits(part).tobytes())
        at += n
    return out


def _asked(pack: Pack, start: np.ndarray, windows: np.ndarray, docs: np.ndarray, key: np.ndarray, length: int) -> bytes:
    n = windows + length - 1
    return _zip(np.array([len(start)], "<i8").tobytes() + docs.astype("<i8").tobytes() + key.astype("<u8").tobytes()
                + windows.astype(np.uint8).tobytes() + pack.raw[np.repeat(start, n) + _ramp(n)].tobytes())


def _words(raw: np.ndarray, start: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Each text of ``n`` bytes in words of eight, filled up with zeros: one column per word."""
    most = -(-int(n.max(initial=0)) // 8)
    body = np.append(raw, np.zeros(8 * most, np.uint8))
    whole = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    at_each = np.ndarray(len(body) - 7, "<u8", body, strides=(1,)) if most else None
    return [at_each[start + 8 * k] & whole[np.clip(n - 8 * k, 0, 8)] if k else at_each[start] & whole[np.minimum(n, 8)] for k in range(most)]


def _answered(bodies: list[bytes], length: int) -> list[bytes]:
    """Per pack: one bit for each window sent, 1 if a smaller doc has it."""
    docs, keys, windows, raws, size = [], [], [], [], []
    for body in bodies:
        body = _unzip(body)
        n = int(np.frombuffer(body, "<i8", 1)[0])
        docs.append(np.frombuffer(body, "<i8", n, 8))
        keys.append(np.frombuffer(body, "<u8", n, 8 + 8 * n))
        windows.append(np.frombuffer(body, np.uint8, n, 8 + 16 * n).astype(np.int64))
        raws.append(np.frombuffer(body, np.uint8, -1, 8 + 17 * n))
        size.append(n)
    raw, docs, keys, windows = (np.concatenate(c) for c in (raws, docs, keys, windows))
    n = windows + length - 1
    start = np.cumsum(n) - n
    # Equal contexts from several packs are one; those of an anchor stay together.
    words = _words(raw, start, n)
    digest = np.zeros(len(start), np.uint64)
    for word in words:
        digest = _mix(digest * np.uint64(_BASE) + word)
    order = np.lexsort((docs, digest, keys))
    new = np.ones(len(order), bool)
    new[1:] = False
    for c in (keys, windows, *words):
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    head = order[new]
    least = least_by_anchor(raw, start[head], windows[head], docs[head], keys[head], length)
    begin = np.cumsum(windows[head]) - windows[head]
    place = np.repeat(begin[at], windows) + _ramp(windows)
    bits = (least[place] < np.repeat(docs, windows)).astype(np.uint8)
    out, done, a = [], 0, 0
    for m in size:
        total = int(windows[a:a + m].sum())
        out.append(np.packbits(bits[done:done + total]).tobytes())
        done, a = done + total, a + m
    return out


def _with_answers(packs: DataFrame, answers: DataFrame) -> DataFrame:
    """Packs with the answers of all buckets: at most one per bucket and pack."""
    got = answers.groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias("answers"))
    return packs.join(got, "pack", "left")


def deduplicated(docs: DataFrame, length: int = 50, gram: int = 24, pack_bytes: int = PACK, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left, in UTF-8) of each document.

    A byte goes if it lies in a string of ``length`` bytes that also starts in a document with a smaller
    doc_id, judged on the input. Null text is empty; texts shorter than ``length`` stay whole; rows with a
    null id are left out; rows that repeat a doc_id never remove from one another. An anchor with more than
    ``crowd`` contexts sends its windows one by one; ``pack_bytes`` of text make a pack. Neither changes the result.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "texts")
    packs = _packed(docs, folder, pack_bytes)
    total = packs.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    # Work is dealt in whole packs; buckets grow with the bytes.
    buckets = max(1, min(spark.sparkContext.defaultParallelism * 2, total[0]), math.ceil(total[1] / BUCKET))
    job = Job(folder, length, gram, buckets)
    tasks = max(1, min(total[0], 1 << 15))
    dealt = packs.repartition(tasks, "pack")

    def name(pack: Pack, row: dict):
        found, hashes, bucket, of = job.anchors(pack)
        note = job.notes(pack, found, of, len(hashes))
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        bodies = [_zip(hashes[a:b].astype("<u8").tobytes() + note[a:b].tobytes()) for a, b in zip(cut, [*cut[1:], len(bucket)])]
        return [pa.array(bucket[cut], pa.int32()), pa.array([row["pack"]] * len(cut), pa.int64()), pa.array(bodies, pa.binary())]

    asked = _each_pack(dealt, job, name, "bucket int, pack long, body binary")
    shared = store(_each_bucket(asked, buckets, lambda b: _which_shared(b, crowd), "pack long, bucket int, bits binary"), "shared")

    def send(pack: Pack, row: dict):
        start, windows, least, bucket, key, *_ = job.contexts(pack, [(a["bucket"], a["bits"]) for a in row["answers"] or ()])
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        bodies = [_asked(pack, start[a:b], windows[a:b], least[a:b], key[a:b], length) for a, b in zip(cut, [*cut[1:], len(bucket)])]
        return [pa.array(bucket[cut], pa.int32()), pa.array([row["pack"]] * len(cut), pa.int64()), pa.array(bodies, pa.binary())]

    known = store(_with_answers(packs, shared).repartition(tasks, "pack"), "known")
    asked = _each_pack(known, job, send, "bucket int, pack long, body binary")
    found = store(_each_bucket(asked, buckets, lambda b: _answered(b, length), "pack long, bucket int, bits binary"), "found")

    def cut_out(pack: Pack, row: dict):
        _, windows, least, bucket, _, start, count, doc, at = job.contexts(pack, [(a["bucket"], a["bits"]) for a in row["answers"] or ()])
        begin, ends = np.cumsum(windows) - windows, np.searchsorted(bucket, np.arange(job.buckets + 1))
        bits = np.zeros(int(windows.sum()), bool)
        for a in row["found"] or ():
            lo, hi = ends[a["bucket"]], ends[a["bucket"] + 1]
            n = int(windows[lo:hi].sum())
            bits[begin[lo]:begin[lo] + n] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=n).astype(bool)
        later = np.repeat(pack.ids[doc] > least[at], count)
        hit = later | bits[np.repeat(begin[at], count) + _ramp(count)]
        step = np.zeros(len(pack.raw) + 1, np.int64)
        places = (np.repeat(start, count) + _ramp(count))[hit]  # each window once
        step[places] += 1
        step[places + length] -= 1
        gone = np.cumsum(step[:-1]) > 0
        rows, a = [], 0
        for doc_id, b in zip(pack.ids.tolist(), pack.ends.tolist()):
            own = gone[a:b]
            removed = int(own.sum())
            spans = int((own & ~np.append(False, own[:-1])).sum()) if removed else 0
            raw = pack.raw[a:b]
            rows.append((doc_id, b - a, removed, spans, (raw[~own] if removed else raw).tobytes()))
            a = b
        return [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.binary()])]

    ready = known.join(found.groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias("found")), "pack", "left")
    return _each_pack(ready.repartition(tasks, "pack"), job, cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
