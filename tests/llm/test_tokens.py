"""Encoders against the libraries, packing, Huffman files and piece decoding against their plain definitions."""

import hashlib
import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from corpus_fixtures import docs  # noqa: F401
from llm import huffman, packing, pieces, tokens

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = [
    "", "  ", "a\tb\n\n c  d e", "日本語 x İstanbul ſ ŉ", "<|endoftext|> hi <s>", "it's I'M we'LL 'S", "x" * 3000,
    "½ 12²3 ª º µ", "trail   ", "a\r\nb\x0bc\x1cd\x85e", "é ẞ STRASSE", "▁ ▁▁ a▁b", " \n ", " a b", "\x00a\x00",
    "😀 word😀word", "don't–stop…“q”€", "ĲĳŒœÿŸ", "a" + " " * 40 + "b", " " * 50, "Ontion the edes, wh " * 300,
]
ROWS = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (None, "no id"), (3, ODD[3]), (60, "tie"), (61, "tie"), (70, "word " * 40_000)]


def library(path):
    t = tokens.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_are_those_of_the_library(path):
    use, plain = tokens.encoder(path), library(path)
    for text in ODD:
        assert np.frombuffer(use.encode(text), "<u4").tolist() == plain(text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x250), st.characters(), st.sampled_from(" \n'stlé")), max_size=60))
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    for path in (BYTE, WORD):
        assert np.frombuffer(tokens.encoder(path).encode(text), "<u4").tolist() == library(path)(text)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    use = pieces.model(PIECE)
    got = use.encode(text)
    ids = sp.encode(text, add_bos=True, add_eos=True)
    assert np.frombuffer(got, "<u4").tolist() == ids
    assert use.decode(got) == sp.decode(ids)


def test_long_texts_are_cut_where_no_token_reaches(monkeypatch):
    text = "Erst  the\n\nedes, it's on-ti  12 " * 90
    plain = [library(p)(text) for p in (BYTE, WORD)]
    monkeypatch.setattr(tokens, "PART", 50)
    monkeypatch.setattr(tokens.parts, "__defaults__", (50,))
    monkeypatch.setattr(pieces, "PART", 50)
    assert [np.frombuffer(tokens.encoder(p).encode(text), "<u4").tolist() for p in (BYTE, WORD)] == plain
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert np.frombuffer(pieces.model(PIECE).encode(text), "<u4").tolist() == sp.encode(text, add_bos=True, add_eos=True)


def test_word_tables_are_bounded():
    t = tokens.Table(lambda w: w.encode(), limit=3)
    assert [t[w] for w in "abcdea"] == [w.encode() for w in "abcdea"] and len(t) <= 3


def expected(path, end):
    use = library(path)
    return sorted((i, use(t or "") + [end]) for i, t in ROWS if i is not None)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_places_each_token_once(docs):
    got = packing.pack(docs(ROWS), BYTE, window=64, end_id=0).collect()
    want = expected(BYTE, 0)
    by_doc = {}
    for r in got:
        assert 0 < r["length"] <= 64 and r["offset"] + r["length"] <= 64
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc, ids in want:
        own = sorted(by_doc[doc], key=lambda r: r["start"])
        copies = sum(d == doc for d, _ in want)
        assert sum(r["length"] for r in own) == copies * len(ids) and {r["doc_tokens"] for r in own} == {len(ids)}
        assert all(r["ids_crc32"] == crc(ids[r["start"]:r["start"] + r["length"]]) for r in own)
    fill = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert fill.get(r["sequence_id"], 0) == r["offset"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(fill) == list(range(len(fill))) and sum(n < 64 for n in fill.values()) <= 1


def test_fit_finds_an_exact_mixture():
    ways = packing.shapes(12)
    assert (ways.sum(1) == 12).all() and len({tuple(w) for w in ways}) == len(ways)
    histogram = np.zeros(12)
    for way, n in ((ways[3], 40), (ways[9], 25)):
        for length in way[way > 0]:
            histogram[length] += n
    x = packing.fit(histogram, ways, 5000)
    made = np.zeros(12)
    np.add.at(made, ways.ravel(), np.repeat(x, 3))
    assert (x >= 0).all() and np.abs(made - histogram)[1:].max() < 2


def test_huffman_files_give_back_every_token(docs):
    files, folder = huffman.archive(docs(ROWS), WORD, 2)
    got = sorted(tuple(r) for r in huffman.read(files, folder).collect())
    at, want = 0, []
    for doc, ids in expected(WORD, 2):
        want.append((doc, at, len(ids), crc(ids)))
        at += len(ids)
    assert [(g[0], g[2], g[3]) for g in got] == [(w[0], w[2], w[3]) for w in want]
    assert sorted(g[1] for g in got) == [w[1] for w in want]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=2000), st.integers(9, 16))
def test_codes_round_trip(ids, limit):
    ids = np.array(ids) ** 2 % 301
    counts = np.bincount(ids, minlength=301)
    lengths = huffman.code_lengths(counts, limit)
    used = lengths[lengths > 0].astype(float)
    assert lengths.max() <= limit and (used > 0).sum() == (counts > 0).sum() and (2.0 ** -used).sum() <= 1
    code = huffman.Code(lengths)
    payload, starts = code.pack(ids)
    assert (code.unpack(payload, starts, len(ids)) == ids).all()
    k = len(starts) // 2  # any block alone
    part = ids[k * huffman.BLOCK:(k + 1) * huffman.BLOCK]
    assert (code.unpack(payload, starts[k:k + 1], len(part)) == part).all()


def test_limited_lengths_are_optimal_when_the_limit_is_loose():
    import heapq

    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 0, 34])
    heap, cost = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert int((huffman.code_lengths(counts, 20) * counts).sum()) == cost
    assert huffman.code_lengths(counts, 4).max() == 4


def test_damaged_files_are_noticed():
    ids = np.arange(50)
    frame = huffman.write_frame(huffman.Code(huffman.code_lengths(np.ones(50))), True, [(7, 50, True)], ids)
    (_, _, _, got), = huffman.read_frames(io.BytesIO(frame))
    assert (got == ids).all()
    with pytest.raises(ValueError):
        list(huffman.read_frames(io.BytesIO(frame[:-3] + b"xyz")))


def test_pieces_of_documents(docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = sorted((r["doc_id"], hashlib.sha256(r["ids"]).hexdigest(), r["text"]) for r in pieces.decoded(pieces.encoded(docs(ROWS), PIECE), PIECE).collect())
    want = []
    for i, t in ROWS:
        if i is not None:
            ids = sp.encode(t or "", add_bos=True, add_eos=True)
            want.append((i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sp.decode(ids)))
    assert got == sorted(want)


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, BYTE).count() == 0
    assert huffman.read(*huffman.archive(none, WORD, 2)).count() == 0
    assert pieces.encoded(none, PIECE).count() == 0
