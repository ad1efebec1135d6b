import hashlib
import random
import zlib

import pytest

from cellfleet.plans import scan
from llm import prefix_trie as P

FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, block long, n int, owned string, t0 string, chunk long"


def plain_rebuilt(rows):
    """Lists of (role, text) of every conversation."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def plain(paths):
    """All nodes by walking every conversation."""
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[:len(key)] == key]
        kids = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(len(j) == len(k) + 1 and j[:len(k)] == k for j in below)]
        ends = ",".join(str(c) for c in sorted(members) if len(paths[c]) == len(key))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(kids), len(leaves),
                    sum((len(nodes[k]) - 1) * len(k[-1][1].encode()) for k in below if k), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations():
    r = random.Random(7)
    rows = []
    for c in [*range(60), 1001, 1003, 2005]:
        n = r.choice([0, 1, 2, 3, 7, 8, 9, 12, 17, 30])
        for i in range(n):
            text = "same" if r.random() < 0.8 else r.choice(["é", "", None, "x" * 50])
            rows.append((c, 2 * i, ["user", "assistant", None][i % 3] if c % 7 else "user", text))
    rows += [(c, i, "user", f"t{i}") for c in range(100, 130) for i in range(20)]  # copies
    rows += [(200, None, "user", "first"), (200, None, "user", "first"), (200, 3, None, None), (200, 3, "a", "b"), (200, 3, "a", "a")]
    rows += [(None, 0, "user", "lost"), (205, 0, "user", "long " * 40_000), (210, 5, "ab", "c"), (215, 5, "a", "bc")]
    return rows


@pytest.fixture
def frame(spark):
    def make(rows):
        return spark.createDataFrame([(*row, 5, 6, "x", "y", 7) for row in rows], SCHEMA).repartition(3)

    return make


def found(df):
    return sorted((tuple(r[f] for f in FIELDS) for r in df.collect()), key=repr)


def test_nodes_are_those_of_a_walk(frame):
    assert found(P.rebuilt_trie(frame(conversations()))) == plain(plain_rebuilt(conversations()))


def test_long_conversations_in_small_chunks(frame, monkeypatch):
    """Blocks of two turns, chunks of three blocks, lists of ends in pieces of four, a hot conversation cut by turn."""
    monkeypatch.setattr(scan, "CHUNK", 3)
    monkeypatch.setattr(scan, "HOT_ROWS", 20)
    monkeypatch.setattr(P, "PIECE", 2)
    rows = conversations() + [(c, i, "user", f"t{i % 5}") for c in (300, 301, 305) for i in range(70)]
    convs, turns = P.rebuilt(P.turns(frame(rows)))
    assert found(P.trie(convs, turns, width=2)) == plain(plain_rebuilt(rows))


def test_turnless_conversations_are_members_of_the_root(frame):
    rows = [(c, 0, "user", "one") for c in range(1, 60) if c % 5]
    want = plain(plain_rebuilt(rows))
    assert any(len(p) == 0 for p in plain_rebuilt(rows).values())
    assert found(P.rebuilt_trie(frame(rows))) == want


def test_empty_table(frame):
    assert found(P.rebuilt_trie(frame([(1, 0, "user", "a")]).where("conv_id > 1"))) == []


def test_query_has_the_agreed_columns(spark, frame, tmp_path):
    from llm.queries import op13_prefix_trie

    frame(conversations()).write.parquet(str(tmp_path / "conversations.parquet"))
    out = op13_prefix_trie(spark, str(tmp_path))
    assert out.dtypes == [(f, "string" if f == "ends_sha256" else "bigint") for f in FIELDS]
    assert found(out) == plain(plain_rebuilt(conversations()))
