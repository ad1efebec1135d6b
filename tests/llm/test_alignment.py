import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corpus_fixtures import docs  # noqa: F401
from llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIELDS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def plain_tokens(text, a=Tokenizer.from_file(A), b=sentencepiece.SentencePieceProcessor(model_file=B)):
    """(id, start, end) of both libraries' tokens over space and text, or nothing."""
    if not text:
        return [], []
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    a_ids = a.encode(" " + text, add_special_tokens=False).ids
    a_raw = [bytes(byte[c] for c in a.id_to_token(i)) for i in a_ids]
    b_ids = b.encode(text)
    b_raw = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    if not b"".join(a_raw) == b"".join(b_raw) == b" " + text.encode():
        return [], []
    out = []
    for ids, raw in ((a_ids, a_raw), (b_ids, b_raw)):
        ends = np.cumsum([len(r) for r in raw]).tolist()
        out.append([(i, e - len(r), e) for i, r, e in zip(ids, raw, ends)])
    return tuple(out)


def plain(rows):
    """Every document's figures by looking at all pairs of tokens."""
    found, count = [], Counter()
    for doc, text in rows:
        if doc is None:
            continue
        a, b = plain_tokens(text)
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        parts = []
        for lo, hi in zip([0, *cuts], cuts):
            side = [",".join(str(t[0]) for t in s if lo < t[2] <= hi) for s in (a, b)]
            parts.append("|".join(side))
        found.append((doc, len(a), len(b), len(cuts), links, ";".join(parts)))
        count.update(links)
    most = {}
    for (_, y), n in count.items():
        most[y] = max(n, most.get(y, 0))
    return sorted((d, na, nb, ng, len(ls), sum(count[p] == most[p[1]] for p in ls), sum(count[p] for p in ls),
                   hashlib.sha256(t.encode()).hexdigest() if na else "") for d, na, nb, ng, ls, t in found)


def texts():
    r = random.Random(11)
    bits = ["the ", "cat", "alignment", "  ", "é", "漢字", "\n", "😀", "1234", "<|endoftext|>", "<0x41>", "</s>", "'s", "naïve", "\t", "é", " ", "zzzzqx", "▁", "\x00"]
    rows = [(i, "".join(r.choice(bits[:-2] if i % 7 else bits) for _ in range(r.randint(0, 25)))) for i in range(120)]
    return rows + [(500, None), (501, ""), (502, " "), (503, "▁"), (504, "a▁b"), (505, "\n\n"), (None, "lost"), (506, "tie tie tie"),
                   rows[3], rows[3], (507, "word " * 400), (508, "x" * 1500)]


@pytest.mark.parametrize("part, chunk", [(1 << 20, 8 << 20), (40, 1)])
def test_figures_are_those_of_all_token_pairs(docs, monkeypatch, part, chunk):
    """Small parts and chunks: counts must still be those of the whole corpus."""
    monkeypatch.setattr(alignment, "PART", part)
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    got = sorted(tuple(r[f] for f in FIELDS) for r in alignment.aligned(docs(texts()), A, B).collect())
    assert got == plain(texts())


def test_groups_join_to_the_text_and_pairs_count_links(docs):
    rows = [r for r in texts() if r[0] is not None]
    for r in alignment.groups(docs(rows), A, B).collect():
        text = next(t for d, t in rows if d == r["doc_id"] and len(plain_tokens(t)[0]) == len(r["a_ids"]))
        a, b = plain_tokens(text)
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        assert r["ends"] == cuts and r["a_ids"] == [x[0] for x in a] and r["b_ids"] == [y[0] for y in b]
        assert r["a_ends"] == [sum(x[2] <= c for x in a) for c in cuts] and r["b_ends"] == [sum(y[2] <= c for y in b) for c in cuts]
    got = {(r["a_id"], r["b_id"]): r["links"] for r in alignment.pair_counts(alignment.noted(docs(rows), A, B)).collect()}
    want = Counter()
    for _, text in rows:
        a, b = plain_tokens(text)
        want.update((x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2])
    assert got == dict(want)


def test_labels_follow_long_chains():
    """Two token rows that never end alike before the text does make one group, however long."""
    n = 5000
    a = np.append(np.arange(2, 2 * n, 2), 2 * n)
    b = np.append(np.arange(1, 2 * n, 2), 2 * n)
    over = [np.repeat(np.arange(len(e)), np.diff(e, prepend=0)) for e in (a, b)]
    got = alignment.labels(a, b, *over)
    assert set(got[0].tolist()) == set(got[1].tolist()) == {n - 1}


def test_empty_table(docs):
    assert alignment.aligned(docs([(1, "a")]).where("doc_id > 1"), A, B).count() == 0


def test_query_has_the_agreed_columns(spark, docs, tmp_path):
    from llm.queries import op11_alignment

    docs(texts()).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    out = op11_alignment(spark, str(tmp_path))
    assert out.dtypes == [(f, "string" if f == "groups_sha256" else "bigint") for f in FIELDS]
    assert sorted(tuple(r) for r in out.collect()) == plain(texts())
