import random
import re

import numpy as np
import pytest
import xxhash

from corpus_fixtures import docs  # noqa: F401
from llm import simhash
from llm.graph import components


def plain_print(text, shingle=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    parts = [b" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def plain_groups(items, limit):
    """Least name of each item's component; items are (name, number)."""
    root = list(range(len(items)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(items)):
        for b in range(a):
            if (items[a][1] ^ items[b][1]).bit_count() <= limit:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    least = {}
    for a, (name, _) in enumerate(items):
        least[find(a)] = min(name, least.get(find(a), name))
    return [(name, least[find(a)]) for a, (name, _) in enumerate(items)]


def texts(n=60):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeÉ") for _ in range(r.randint(1, 5)))
    rows = []
    for i in range(n):
        base = [word() for _ in range(r.randint(1, 120))]
        rows.append((10 * i, " ".join(base)))
        for k in range(r.randint(0, 3)):
            copy = list(base)
            copy[r.randrange(len(copy))] = word()
            rows.append((10 * i + k + 1, "\t".join(copy).swapcase() if k == 1 else " ".join(copy)))
    return rows + [(5001, None), (5002, ""), (5003, " \n "), (5004, "ONE"), (5005, "one"), (None, "lost"), rows[3], (5006, "long " * 30_000)]


@pytest.mark.parametrize("block", [1 << 15, 8])
def test_groups_are_those_of_all_pairs(docs, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)  # small blocks: every cell is split and meets by pairs
    rows = [r for r in texts() if r[0] is not None]
    want = sorted((i, f"{plain_print(t):016X}", c) for (i, t), (_, c) in zip(rows, plain_groups([(i, plain_print(t)) for i, t in rows], 4)))
    got = sorted((r["doc_id"], bytes(r["fp"]).hex().upper(), r["component_id"]) for r in simhash.groups(docs(texts())).collect())
    assert got == want


@pytest.mark.parametrize("ring", [simhash.Ring(1, 5, 4), simhash.Ring(1, 8, 7), simhash.Ring(4, 16, 46), simhash.Ring(2, 8, 20)])
def test_every_pair_within_the_limit_passes_some_chain(ring):
    r = np.random.default_rng(2)
    bits = 64 * ring.words
    for _ in range(300):
        flip = r.choice(bits, r.integers(0, ring.limit + 1), replace=False)
        x = np.zeros(ring.words, np.uint64)
        for b in flip:
            x[b // 64] |= np.uint64(1 << int(b % 64))
        assert any(len(ring.near(x[None], i)) for i in range(ring.segments))
    far = r.integers(0, 1 << 63, (50, ring.words)).astype(np.uint64) * np.uint64(2)
    far = far[np.bitwise_count(far).sum(1) > ring.limit]
    assert not any(len(ring.near(far, i)) for i in range(ring.segments))


def test_near_copies_meet_in_size_bands(docs):
    r = random.Random(9)
    rows, copies = [], []
    for i in range(40):
        base = [f"w{r.randrange(9999)}" for _ in range(200)]
        copy = list(base)
        for _ in range(3):
            copy[r.randrange(200)] = "changed"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        copies.append(2 * i)
    found = {x["doc_id"]: x["component_id"] for x in simhash.groups(docs(rows), shingle=5, words=4, segments=16, limit=46).collect()}
    assert all(found[c] == c for c in copies), "unrelated documents stay apart"
    assert all(found[c + 1] == c for c in copies)


def shared(common, own, name):
    """Two texts of which ``common`` five-word shingles are in both and ``own`` in each only."""
    a = [f"{name}w{i}" for i in range(common + 4)]
    return " ".join(a + [f"{name}x{i}" for i in range(own)]), " ".join(a + [f"{name}y{i}" for i in range(own)])


@pytest.mark.parametrize("block", [1 << 15, 8])
def test_copies_are_those_whose_sets_are_eight_tenths_alike(docs, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows, want, at = [], {}, 0
    for k in range(20):
        # Jaccard 70/100, 78/100, 80/100, 85/101 and 4/5; the last is of five shingles and four of them.
        for common, own in ((140, 30), (156, 22), (160, 20), (170, 15)):
            for t in shared(common, own, f"{k}n{common}"):
                rows.append((at, t))
                want[at] = at - (at % 2 if common >= 160 else 0)
                at += 1
        few = [f"{k}few{i}" for i in range(9)]
        rows += [(at, " ".join(few)), (at + 1, " ".join(few[:-1]))]
        want |= {at: at, at + 1: at}
        at += 2
    # Two texts of other sets that share one passage many times over are no copies.
    passage = " ".join(f"p{i}" for i in range(20)) + " "
    for k in range(2):
        rows.append((at + k, passage * 60 + shared(100, 20, f"rep{k}")[0]))
        want[at + k] = at + k
    got = {r["doc_id"]: r["component_id"] for r in simhash.alike(docs(rows)).collect()}
    assert got == want
    old = {x["doc_id"]: x["component_id"] for x in simhash.groups(docs(rows[-2:]), shingle=5, words=4, segments=16, limit=46).collect()}
    assert old[at + 1] == at, "fingerprints alone link the last two"


def test_alike_without_rows(spark):
    assert simhash.alike(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    r = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(200 + r.randrange(80), 200 + r.randrange(80)) for _ in range(60)] + [(5, 5)]
    root = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(components(spark.createDataFrame(pairs, "u long, v long")).collect())
    assert {x: got.get(x, x) for x in root} == root
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_no_rows(spark):
    assert simhash.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_pair_at_the_limit_is_missed(docs):
    """300 pairs of Jaccard 80/100 and 300 of 82/100 of random words, found among each other; 300 of 76/100 stay apart."""
    r = random.Random(3)
    rows, want = [], {}
    for i in range(900):
        common, own = ((160, 20), (164, 18), (152, 24))[i % 3]
        a = [f"{r.getrandbits(40):x}" for _ in range(common + 4)]
        for j in range(2):
            rows.append((2 * i + j, " ".join(a + [f"{r.getrandbits(40):x}" for _ in range(own)])))
            want[2 * i + j] = 2 * i + (j if i % 3 == 2 else 0)
    got = {x["doc_id"]: x["component_id"] for x in simhash.alike(docs(rows)).collect()}
    assert sum(got[i] != want[i] for i in want) == 0


@pytest.mark.parametrize("block", [1 << 15, 64])
def test_a_large_group_of_near_copies_is_one(docs, monkeypatch, block):
    """Every copy differs from the others in words of its own; small blocks deal the cluster out in parts."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    base = [f"w{i}" for i in range(120)]
    rows = [(10 + k, " ".join(base[:k % 100] + [f"own{k}"] + base[k % 100 + 1:])) for k in range(600)]
    rows += [(5000 + k, " ".join(f"x{k}y{i}" for i in range(120))) for k in range(100)]
    got = {x["doc_id"]: x["component_id"] for x in simhash.alike(docs(rows)).collect()}
    assert all(got[10 + k] == 10 for k in range(600)) and all(got[5000 + k] == 5000 + k for k in range(100))


def test_rows_of_one_label_are_not_compared_again():
    """A group of copies costs one look at each, not one at each pair."""
    looks = []
    n, real = 400, simhash._sharing
    sets = [np.arange(100, dtype=np.uint64) for _ in range(n)]
    simhash._sharing = lambda own, others: looks.append(len(others)) or real(own, others)
    try:
        label = simhash._joined(np.zeros((n, 4), np.uint64), np.full(n, 100), 72, sets)
    finally:
        simhash._sharing = real
    assert (label == 0).all() and sum(looks) == n - 1


def test_texts_of_one_id_are_told_apart(docs):
    words = [" ".join(f"{k}w{i}" for i in range(50)) for k in "abc"]
    rows = [(1, words[0]), (1, words[1]), (2, words[0]), (3, words[1]), (4, words[2]), (4, words[2])]
    found = simhash.alike(docs(rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4)]
    assert len({r["group"] for r in found}) == 3 and len({r["row"] for r in found}) == 3


def test_near_fingerprints_are_found_by_pigeonring(docs, monkeypatch):
    """Pairs of up to 15 of 256 bits need no band of least hashes; copies further apart do."""
    real = simhash._meet
    rows, near = [], {}
    for k in range(120):
        a, b = shared(300, 1 + k % 3, f"{k}n") if k % 2 else shared(160, 20, f"{k}n")
        rows += [(2 * k, a), (2 * k + 1, b)]
        x, y = (simhash.fingerprint(np.unique(simhash.shingle_hashes(t, 5)), 4) for t in (a, b))
        near[2 * k], near[2 * k + 1] = 2 * k, 2 * k + (int(np.bitwise_count(x ^ y).sum()) > 15)
    rows += [(900, ""), (901, None)]
    assert len(set(near.values())) not in (120, 240), "pairs of both kinds"
    bands = []

    def only_sets(cells, *args):
        if "set" not in cells.columns:
            bands.append(real(cells, *args))
            return bands[0].limit(0)
        return real(cells, *args)

    monkeypatch.setattr(simhash, "_meet", only_sets)
    got = {x["doc_id"]: x["component_id"] for x in simhash.alike(docs(rows)).collect()}
    assert got == near | {900: 900, 901: 900}
    # The bands add only pairs that the fingerprints left apart.
    assert bands[0].selectExpr("least(u, v)", "greatest(u, v)").distinct().count() == sum(k == v for k, v in near.items() if k % 2)


def test_labels_of_large_runs_are_those_of_all_pairs(monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS", 50)
    r = np.random.default_rng(8)
    ring = simhash.Ring(1, 4, 3)
    base = r.integers(0, 1 << 62, 6).astype(np.uint64)
    prints = np.concatenate([base, base[r.integers(0, 6, 400)] ^ (np.uint64(1) << r.integers(0, 64, 400).astype(np.uint64))
                             ^ (np.uint64(1) << r.integers(0, 64, 400).astype(np.uint64))])[:, None]
    whole = np.zeros(len(prints), np.int64)
    labels = [simhash._links(ring, np.unique(ring.segment(prints, i), return_inverse=True)[1], prints, whole, [i], True) for i in range(4)]
    got = np.arange(len(prints))
    for label in labels:
        simhash._merge(got, np.arange(len(prints)), label)
    want = [v for _, v in plain_groups([(i, int(p)) for i, p in enumerate(prints[:, 0])], 3)]
    assert got.tolist() == want
