"""Token ids of whole texts, exactly as the tokenizers library gives them, at a few times its speed.

Texts of common Latin letters are cut into the tokenizer's own words by its pattern, and each word's ids
come from a bounded table, filled by byte-pair merging of the word. Any other text (other scripts, control
characters, combining marks) is encoded by the library itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

# Letters, numbers and spaces among the characters that the fast way takes (fixed values).
_L = "A-Za-zªµºÀ-ÖØ-öø-įı-ňŊ-ž"
_N = "0-9²³¹¼-¾"
_S = "\t\n\v\f\r "
_COMMON = re.compile(f"[{_S}\x21-\x7e¡-¬®-įı-ňŊ-ž–—‘-„•…€]*")
_CONTRACTED = "'s|'t|'re|'ve|'m|'ll|'d"
_PATTERNS = {
    "byte": re.compile(f"{_CONTRACTED}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"),
    "word": re.compile(f"{_CONTRACTED}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+"),
}
_GAP = re.compile(f"(?<=[^{_S}]) (?=[^{_S}])")
#: Characters of a text cut at once, and words that a table holds before it starts afresh.
PART, WORDS = 1 << 20, 600_000


class Table(dict):
    """Ids of words as little-endian unsigned 32-bit bytes; a missing word is encoded and kept."""

    def __init__(self, encode: Callable[[str], bytes], limit: int = WORDS):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = ids
        return ids


def parts(text: str, size: int = PART) -> Iterator[str]:
    """A long text in parts, cut before a space between two words, where no token reaches across."""
    at = 0
    while len(text) - at > size and (cut := _GAP.search(text, at + size)):
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts by one tokenizer file."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their names in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.end = spec["model"].get("end_of_word_suffix") or ""
        self.folds = spec["normalizer"] is not None
        self.pattern = _PATTERNS["word" if self.end else "byte"]
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self._core(spec["model"])
        self.table = Table(self._word)

    def _core(self, model: dict) -> None:
        """Byte-pair merging by rank. An end of word is a byte 0xFF, which joins the last byte first."""
        chars, vocab, end = _byte_chars(), model["vocab"], self.end

        def raw(token: str) -> bytes:
            if end and token.endswith(end):
                return bytes(chars[c] for c in token.removesuffix(end)) + b"\xff"
            return bytes(chars[c] for c in token)

        ranks = {bytes([b]): b for b in range(256)}
        ids = {b: vocab.get(c, 0) for c, b in chars.items()}
        for c, b in chars.items() if end else ():
            ranks[bytes([b, 255])] = 256 + b
            ids[256 + b] = vocab.get(c + end, 0)
        first = len(ids)
        for i, pair in enumerate(model["merges"]):
            token = "".join(pair.split(" ") if isinstance(pair, str) else pair)
            token = token.replace(end, "", token.count(end) - 1) if end else token
            ranks.setdefault(raw(token), first + i)
            ids[first + i] = vocab[token]
        self.ids = np.zeros(max(ids) + 1, "<u4")
        self.ids[list(ids)] = list(ids.values())
        self.core = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={},
                                      explicit_n_vocab=None)._core_bpe

    def _word(self, word: str) -> bytes:
        raw = word.encode() + (b"\xff" if self.end else b"")
        return self.ids[self.core.encode_single_piece(raw)].tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes."""
        if not (text.isascii() and text.isprintable()) and not _COMMON.fullmatch(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out = []
        for part in parts(text):
            part = part.lower() if self.folds else part
            out.append(b"".join(map(self.table.__getitem__, self.pattern.findall(part))))
        return b"".join(out)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file; tasks that follow use its table again."""
    return Encoder(path)
