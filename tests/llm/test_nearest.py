import math

import numpy as np
import psutil
import pyarrow as pa
import pytest

from llm import nearest

SCHEMA = "vec_id long, embedding array<float>, label int, x string, ids string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", "clash") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, queries, k):
    least = {}
    for i, v in rows:
        ok = i is not None and v and len(v) == 16 and all(c is not None and math.isfinite(c) for c in v) and any(v)
        if ok:
            v = np.float32(v).astype(float).tolist()
            least[i] = min(v, least.get(i, v))
    ids = np.array(sorted(least))
    x = np.array([least[i] for i in ids])
    out = {}
    for q in ids[ids % queries == 0]:
        s = np.array([(x[j] * x[list(ids).index(q)]).sum() for j in range(len(ids))])
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), s[j]) for j in order]
    return out


def vectors(n, seed=3):
    r = np.random.default_rng(seed)
    rows = [(i, r.normal(size=16).astype(np.float32).tolist()) for i in range(n)]
    copy = rows[7][1]
    rows += [(n + i, copy) for i in range(60)]  # a group of copies: ties go to smaller ids
    rows += [(5001, None), (5020, []), (5040, [0.0] * 16), (5060, [float("nan")] + copy[1:]), (None, copy),
             (5080, [None] + copy[1:]), (5100, copy[:3]), (5120, [float("inf")] + copy[1:]), rows[20], (40, copy)]
    return rows


def test_few_vectors_are_ranked_exactly(spark):
    rows = vectors(300)
    want = brute(rows, 20, 20)
    got = {}
    for r in nearest.nearest(frame(spark, rows)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    assert got.keys() == want.keys()
    for q in want:
        assert [g[0] for g in got[q]] == [w[0] for w in want[q]] and [g[2] for g in got[q]] == list(range(1, 21))
        assert all(abs(g[1] - w[1]) < 1e-9 for g, w in zip(got[q], want[q]))


def test_recall_of_many_vectors(spark):
    rows = vectors(3000, seed=5)
    want = brute(rows, 100, 20)
    got = {}
    for r in nearest.nearest(frame(spark, rows), queries=100).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert got.keys() == want.keys() and all(len(g) == 20 for g in got.values())
    assert sum(len(got[q] & {i for i, _ in want[q]}) for q in want) / (20 * len(want)) >= 0.9


def test_buckets_are_visited_in_order_of_distance_and_split(monkeypatch):
    monkeypatch.setattr(nearest, "PART", 50)
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 8))
    index = nearest.Index.drawn(8, float(np.linalg.norm(x, axis=1).max()))
    codes = index.codes(x)
    index.directory([(t, int(c), int((codes[t] == c).sum())) for t in range(len(codes)) for c in np.unique(codes[t])], 7)
    parts = index.part_of(codes, np.arange(len(x)))
    assert set(index.group) == set(range(7)) and max(np.bincount(parts.ravel())) <= 100
    few, many = (index.probes(x[:5], s) for s in (0.05, 1.0))
    assert all(set(a) < set(b) for a, b in zip(few, many))
    assert all(set(p) == set(range(len(index.group))) for p in many), "all buckets of every table in the end"


def test_fewer_than_k_and_no_rows(spark):
    got = nearest.nearest(frame(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [2.0, 1.0])])).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 2, 2.0), (0, 1, 0.5)]
    assert nearest.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert nearest.nearest(frame(spark, [(0, [1.0, 2.0])])).count() == 0


def peaks():
    """Most memory so far of each Python worker below this process, in MB."""
    out = {}
    for p in psutil.Process().children(recursive=True):
        try:
            if "pyspark.daemon" in p.cmdline():
                with open(f"/proc/{p.pid}/status") as f:
                    out[p.pid] = int(next(line for line in f if line.startswith("VmHWM")).split()[1]) / 1024
        except (psutil.Error, OSError):
            pass
    return out


def test_memory_does_not_grow_with_the_rows_of_a_bucket(spark):
    """6,000 queries meet a bucket of 12,000 vectors: all their products at once are 576 MB and more."""
    r = np.random.default_rng(4)
    x = (np.eye(16)[0] + r.normal(size=(12000, 16)) * 1e-3).astype(np.float32)
    rows = frame(spark, list(enumerate(x.tolist())))
    before = peaks()
    got = nearest.nearest(rows, queries=2).collect()
    assert len(got) == 6000 * 20
    grown = [mb for pid, mb in peaks().items() if mb > before.get(pid, 0)]
    assert max(grown) < 700
    x = x.astype(float)
    for q in range(0, 12000, 2400):
        s = x @ x[q]
        s[q] = -1
        assert [g["vec_id"] for g in sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])] == np.argsort(-s)[:20].tolist()


@pytest.mark.parametrize("part", [37, 1 << 14])
def test_ties_and_copies_over_several_shelves(monkeypatch, part):
    """Few different scores: most pairs tie, and ids decide among equal scores of different shelves."""
    for name, value in {"PART": part, "PRODUCTS": 300, "HELD": 500, "PLANNED": 7}.items():
        monkeypatch.setattr(nearest, name, value)
    r = np.random.default_rng(2)
    x = np.unique(r.integers(-2, 3, size=(2500, 5)), axis=0).astype(np.float32)
    x = r.permutation(x[np.any(x, axis=1)])
    ids = np.split(r.permutation(4 * len(x)), np.sort(r.choice(np.arange(1, 4 * len(x)), len(x) - 1, replace=False)))
    ids = [np.sort(i)[:6] for i in ids]  # of copies the k + 1 least
    index = nearest.Index.drawn(5, float(np.linalg.norm(x, axis=1).max()))
    codes = index.codes(x.astype(float))
    index.directory([(t, int(c), int((codes[t] == c).sum())) for t in range(len(codes)) for c in np.unique(codes[t])], 3)
    asking = r.choice(len(x), 60, replace=False)
    block = nearest.Block(index, np.array([ids[i][0] for i in asking]), x[asking].astype(float), 5, 1.0)
    for own in np.array_split(np.arange(len(x)), 4):
        at = np.cumsum([0, *(len(ids[i]) for i in own)])
        block.see(nearest.Shelf(x[own], np.concatenate([ids[i] for i in own]), at, codes[:, own]))
    flat, owner = np.concatenate(ids), np.repeat(np.arange(len(x)), [len(i) for i in ids])
    got = block.answer().to_pandas()
    for i in asking:
        score = x[owner] @ x[i]
        order = [j for j in np.lexsort((flat, -score)) if flat[j] != ids[i][0]][:5]
        own = got[got.query_id == ids[i][0]]
        assert own["rank"].tolist() == [1, 2, 3, 4, 5]
        assert own.vec_id.tolist() == flat[order].tolist() and own.score.tolist() == score[order].tolist()


def test_many_packs_and_blocks_and_doubles(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SHELF", 1 << 13)
    monkeypatch.setattr(nearest, "QUERIES", 16)
    r = np.random.default_rng(9)
    x = np.repeat(r.normal(size=(500, 4)) * 1e30, 2, axis=0)
    x[1::2] *= 1 + 1e-12  # apart in doubles only
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for row in nearest.nearest(rows, queries=10, k=4).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
    assert got.keys() == set(range(0, 1000, 10))
    for q, own in got.items():
        s = np.einsum("ij,j->i", x, x[q])
        s[q] = -np.inf
        assert [i for i, _ in own] == np.argsort(-s)[:4].tolist()
        assert np.allclose([v for _, v in own], np.sort(s)[::-1][:4], rtol=1e-14, atol=0)


@pytest.mark.parametrize("kind", [pa.float32(), pa.float64()])
def test_bytes_sort_as_vectors_do(kind):
    r = np.random.default_rng(6)
    rows = [r.choice([-3e30, -1.5, -1e-40, -0.0, 0.0, 1e-40, 0.25, 7.0], n).tolist() for n in r.integers(1, 4, 300)]
    column = pa.array([[9.0], *rows], pa.list_(kind))[1:]
    found, square = nearest._encoded(column)
    found, rows = found.to_pylist(), column.to_pylist()
    assert np.allclose(square, [sum(float(v) ** 2 for v in row) for row in rows])
    assert [rows[i] for i in sorted(range(300), key=lambda i: found[i])] == sorted(rows)
    assert len(set(found)) == len({tuple(v + 0.0 for v in row) for row in rows})
    for n in (1, 2, 3):
        same = [i for i in range(300) if len(rows[i]) == n]
        back = nearest._decoded(pa.array([b"0" * 8, *(found[i] for i in same)], pa.binary())[1:], kind.bit_width // 8, n)
        assert back.tolist() == [rows[i] for i in same]


@pytest.mark.parametrize("long", [1.0, 1e6, 1e30])
def test_a_long_vector_does_not_hide_the_others(monkeypatch, long):
    """Rounding is bounded by each entry's own length: few pairs need exact scores beside a long vector too."""
    r = np.random.default_rng(8)
    x = r.normal(size=(4000, 16)).astype(np.float32)
    x[17] *= np.float32(long)
    index = nearest.Index.drawn(16, float(np.linalg.norm(x.astype(float), axis=1).max()))
    codes = index.codes(x.astype(float))
    index.directory([(t, int(c), int((codes[t] == c).sum())) for t in range(len(codes)) for c in np.unique(codes[t])], 3)
    seen = []
    best = nearest.Block._best
    monkeypatch.setattr(nearest.Block, "_best", lambda self, *a: seen.append(sum(len(h[0]) for h in a[-1])) or best(self, *a))
    monkeypatch.setattr(nearest, "HELD", 1 << 12)
    block = nearest.Block(index, np.arange(50), x[:50].astype(float), 20, 1.0)
    ids = np.arange(len(x) + 1)
    block.see(nearest.Shelf(x, ids[:-1], ids, codes))
    got = block.answer().to_pandas()
    for q in range(50):
        s = np.einsum("ij,j->i", x.astype(float), x[q].astype(float))
        s[q] = -np.inf
        assert got[got.query_id == q].vec_id.tolist() == np.argsort(-s)[:20].tolist()
    assert sum(seen) < 1.2 * 50 * len(x)  # once each at most, not in every table
