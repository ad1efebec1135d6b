import random

import numpy as np
import pytest

from corpus_fixtures import docs  # noqa: F401
from llm import suffixes


def brute(rows, length):
    rows = [(i, (t or "").encode()) for i, t in rows if i is not None]
    first = {}
    for i, t in rows:
        for p in range(len(t) - length + 1):
            w = t[p:p + length]
            first[w] = min(i, first.get(w, i))
    out = []
    for i, t in rows:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if first[t[p:p + length]] < i:
                gone[p:p + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, kept))
    return sorted(out)


def texts(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé\0") for _ in range(r.randint(1, 6)))
    passage = [" ".join(word() for _ in range(40)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(r.randint(0, 60)))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passage)
            a = r.randint(0, len(p) // 2)
            parts += [p[a:a + r.randint(20, len(p))], word() * r.randint(0, 40)]
        rows.append((i, "".join(parts)))
    rows += [(n + k, rows[k][1]) for k in range(0, n, 3)]
    return rows + [(n + 900, None), (n + 901, ""), (n + 902, "z" * 5000), (n + 903, "z" * 70), (None, "lost"), (1, rows[1][1]), rows[2]]


@pytest.mark.parametrize("crowd", [20_000, 3])
def test_removed_as_by_brute_force(docs, crowd):
    rows = texts(5, 90)
    found = suffixes.deduplicated(docs(rows), 50, pack_bytes=3000, crowd=crowd)
    assert sorted(tuple(r[:4]) + (bytes(r[4]),) for r in found.collect()) == brute(rows, 50)


def test_blocks_of_a_shard_are_merged():
    start, windows, ids, at = [], [], [], 0
    texts_ = [(i, (t or "").encode()) for i, t in texts(5, 60) if i is not None]
    for i, t in texts_:
        if len(t) >= 50:
            start.append(at), windows.append(min(27, len(t) - 49)), ids.append(i)
        at += len(t)
    args = np.frombuffer(b"".join(t for _, t in texts_), np.uint8), np.array(start), np.array(windows), np.array(ids), 50
    assert (suffixes.least_docs(*args, block=7) == suffixes.least_docs(*args)).all()


def contexts_of(rows):
    """Distinct contexts of all anchors in the order of their hashes: arguments of ``least_docs``, and the hashes."""
    rows = [(i, (t or "").encode()) for i, t in rows if i is not None]
    raw = np.frombuffer(b"".join(t for _, t in rows), np.uint8)
    r = suffixes.runs(raw, np.cumsum([len(t) for _, t in rows]), 50, 24)
    ids, windows = np.array([i for i, _ in rows])[r.doc], r.last - r.first + 1
    order = np.lexsort((ids, r.context, r.anchor))
    head = order[np.append(True, (np.diff(r.anchor[order]) != 0) | (np.diff(r.context[order]) != 0))]
    return (raw, r.first[head], windows[head], ids[head]), r.anchor[head]


@pytest.mark.parametrize("block", [2, 7, 24_000])
def test_blocks_of_whole_anchors(block):
    args, keys = contexts_of(texts(8, 80))
    assert np.bincount(np.unique(keys, return_inverse=True)[1]).max() > 7  # more than two of the block sizes
    assert (suffixes.least_by_anchor(*args, keys, 50, block=block) == suffixes.least_docs(*args, 50)).all()


def test_only_anchors_with_several_contexts_are_sorted(monkeypatch):
    r, done = random.Random(9), []
    sort = suffixes.sort_suffixes
    monkeypatch.setattr(suffixes, "sort_suffixes", lambda codes, depth: done.append(len(codes)) or sort(codes, depth))
    passages = [bytes(r.choice(b"abcdefgh") for _ in range(2000)) for _ in range(12)]

    def bits(first, second):
        bodies, sizes = [], []
        for ids, found in (((1, 2), first), ((3, 4), second)):
            pack = suffixes.Pack(np.array(ids), np.cumsum([len(t) for t in found]), np.frombuffer(b"".join(found), np.uint8))
            job = suffixes.Job("", 50, 24, 1)
            n = len(job.anchors(pack)[1])
            every = np.zeros((2, -(-n // 8) * 8), np.uint8)
            every[0, :n] = 1
            start, windows, least, _, key, *_ = job.contexts(pack, [(0, np.packbits(every).tobytes())])
            bodies.append(suffixes._asked(pack, start, windows, least, key, 50))
            sizes.append(int(windows.sum()))
        return [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(suffixes._answered(bodies, 50), sizes)]

    one, two = bits(passages[:2], passages[:2])  # copies: each anchor has one context
    assert not one.any() and two.all() and len(two) == 2 * 1951 and not done
    # A passage cut out of its document has other contexts at its two ends only.
    longer = passages[2] + passages[0][500:1500] + passages[3]
    one, two = bits(passages[:2], [longer, passages[4]])
    equal = sum(longer[k:k + 50] in passages[0] for k in range(len(longer) - 49))
    assert not one.any() and two.sum() == equal >= 951
    assert sum(done) < 10 * 90


def test_long_texts_go_by_segments(monkeypatch):
    raw = np.frombuffer("".join(t or "" for _, t in texts(6, 60)).encode(), np.uint8)

    def anchors():
        suffixes._powers.cache_clear()
        r = suffixes.runs(raw, np.array([700, len(raw)]), 50, 24)
        return {p: (d, a) for f, n, d, a in zip(r.first, r.last, r.doc, r.anchor) for p in range(f, n + 1)}

    whole = anchors()
    monkeypatch.setattr(suffixes, "_LOW", 10)
    parts = anchors()
    monkeypatch.undo()
    suffixes._powers.cache_clear()
    assert parts.keys() == whole.keys() and len(whole) == len(raw) - 2 * 49
    # The order of hashes keeps fewer bits in longer segments, so anchors agree but for such ties.
    assert all(parts[p] == whole[p] for p in whole)


def test_sorted_suffixes():
    r = np.random.default_rng(3)
    texts_ = [r.integers(1, 3, 40) for _ in range(12)] + [np.ones(40, int)] * 2
    codes = np.concatenate([np.append(t, [0] * 7) for t in texts_]).astype(np.uint16)
    order = [i for i in suffixes.sort_suffixes(codes, 64).tolist() if codes[i] > 0]
    assert order == sorted(order, key=lambda i: (codes[i:i + 40].tolist(), i) if 0 not in codes[i:i + 40]
                           else (codes[i:i + int(np.argmax(codes[i:] == 0)) + 1].tolist(), i))


def test_no_rows(docs, spark):
    assert suffixes.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
