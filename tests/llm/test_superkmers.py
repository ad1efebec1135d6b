import hashlib
import random
import re

import numpy as np
import pytest

from corpus_fixtures import docs  # noqa: F401
from llm import superkmers


def plain(rows, window=13):
    """n_words, n_removed and kept of every row with an id, by looking at every window."""
    rows = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows if d is not None]
    least = {}
    for d, words in rows:
        for i in range(len(words) - window + 1):
            key = tuple(words[i:i + window])
            least[key] = min(d, least.get(key, d))
    out = []
    for d, words in rows:
        gone = set()
        for i in range(len(words) - window + 1):
            if least[tuple(words[i:i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out)


def texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abÉ漢") for _ in range(r.choice([1, 1, 2, 3, 20])))
    shared = [[word() for _ in range(n)] for n in (12, 13, 14, 60, 200)]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(r.randint(0, 4)):
            parts += [word() for _ in range(r.randint(0, 40))]
            if r.random() < 0.6:
                parts += r.choice(shared)
        rows.append((r.randint(-5, 400), r.choice([" ", "\t", " \n\r ", "\x0b"]).join(parts)))
    rows += [(900 + i, " ".join(shared[4])) for i in range(40)]  # a group of copies
    rows += [(1, None), (2, ""), (3, " \n "), (4, "few words"), (None, "lost " * 40), (5, "same " * 3000), (6, "same " * 13)]
    rows += [(7, "    " * 20), (8, "    " * 20), rows[0], rows[0], (rows[3][0], "other text " * 9)]
    return rows


@pytest.mark.parametrize("chunk, bucket", [(8 << 20, 4 << 20), (700, 2000), (700, 64)])
def test_words_that_stay_are_those_of_all_windows(docs, monkeypatch, chunk, bucket):
    """Small chunks cut texts into pieces; small buckets make every repeated minimiser hot."""
    monkeypatch.setattr(superkmers, "CHUNK", chunk)
    monkeypatch.setattr(superkmers, "BUCKET", bucket)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in superkmers.deduplicated(docs(texts())).collect())
    assert got == plain(texts())


@pytest.mark.parametrize("window", [1, 2, 5, 8])
def test_other_windows(docs, window):
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in superkmers.deduplicated(docs(texts()), window).collect())
    assert got == plain(texts(), window)


def test_empty_table(docs):
    assert superkmers.deduplicated(docs([(1, "a")]).where("doc_id > 1")).count() == 0


def test_pieces_of_a_long_text_hold_each_window_once():
    text = " ".join(str(i) for i in range(5000)).encode()
    words = text.split()
    seen = [(base + i, tuple(p.split()[i:i + 13])) for base, p in superkmers._pieces(text, 13, 300) for i in range(len(p.split()) - 12)]
    assert seen == [(i, tuple(words[i:i + 13])) for i in range(len(words) - 12)]
    assert list(superkmers._pieces(b"x" * 1000 + b" " + b"y " * 5, 13, 300)) == []


def test_equal_strings_leave_a_chunk_once():
    words = " ".join(f"w{i}" for i in range(60)).encode()
    cut = superkmers._Cut([(d, 0, 0, words) for d in (7, 3, 9, 3)], 13, np.zeros(0, np.uint64))
    assert set(cut.doc[cut.dealt()].tolist()) == {3} and len(cut.n) == 4 * len(set(cut.at.tolist()))
    assert cut.n.sum() == 4 * 48 and max(cut.n) <= 11


def test_hot_minimisers_are_dealt_by_window():
    """One minimiser among many contexts goes to many buckets, one window a string."""
    def value(core):
        data, ends = core.encode() + b" ", np.cumsum([len(w) + 1 for w in core.split()]) - 1
        return superkmers._along(superkmers.word_hashes(data, np.append(0, ends[:-1] + 1), ends), superkmers.GRAM)[0]

    core = min((f"the end {j}" for j in range(3000)), key=value)  # one that is the least of nearly any window
    lines = [(i, 0, 0, " ".join([*(f"l{i}x{k}" for k in range(9)), core, *(f"r{i}x{k}" for k in range(9))]).encode()) for i in range(200)]
    plain_cut = superkmers._Cut(lines, 13, np.zeros(0, np.uint64))
    values, times = np.unique(plain_cut.mini, return_counts=True)
    hot = values[times > 20]
    assert len(hot)
    cut = superkmers._Cut(lines, 13, hot)
    which = np.isin(cut.mini, hot)
    assert (cut.n[which] == 1).all() and len(np.unique(cut.route[which] % np.uint64(64))) == 64


@pytest.mark.parametrize("window", [3, 13])
def test_ranks_tell_windows_apart(window):
    words = np.random.default_rng(1).integers(0, 2, 4000)
    at = np.arange(len(words) - window + 1)
    rank = superkmers.ranks(words, at, window)
    keys = [tuple(words[i:i + window]) for i in at]
    assert len(set(zip(keys, rank.tolist()))) == len(set(keys)) == len(set(rank.tolist()))


def test_query_has_the_agreed_columns(spark, docs, tmp_path):
    from llm.queries import op12_superkmers

    docs(texts()).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    out = op12_superkmers(spark, str(tmp_path))
    assert [(c, t) for c, t in out.dtypes][:4] == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")]
    want = sorted((d, n, m, hashlib.sha256(k.encode()).hexdigest()) for d, n, m, k in plain(texts()))
    assert sorted(tuple(r) for r in out.collect()) == want
