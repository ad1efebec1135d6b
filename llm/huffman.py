"""Token ids on disk: canonical, length-limited Huffman codes, decoded by table in independent blocks.

File format, version 1. One file per range of doc_id, made of frames; integers are little-endian.
    frame   b"HUF1", seven uint32: alphabet, ids, pieces, blocks, bytes of codes, bytes of header, crc32
    header  zlib: code lengths (uint8 per id of the alphabet; first frame of a file only), then per piece
            doc_id (int64), ids (uint32), last (uint8: 1 ends its document), then per block the bit at which
            it starts (uint64)
    codes   the codes of all ids, most significant bit first, with eight bytes of padding
A block holds ``BLOCK`` ids (the last of a frame fewer) and can be decoded alone from its bit offset.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import by_batch, documents, filesystem, shared_folder, store
from llm.tokens import encoder

LIMIT, BLOCK, FRAME, FILE = 20, 128, 1 << 20, 1 << 23
_HEAD = struct.Struct("<4s7I")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, by package-merge; 0 for ids that do not occur."""
    out = np.zeros(len(counts), np.uint8)
    ids = np.flatnonzero(counts)
    ids = ids[np.argsort(counts[ids], kind="stable")]
    n = len(ids)
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit codes of {limit} bits")
    if n < 2:
        out[ids] = 1
        return out
    single = counts[ids].astype(np.float64)
    level, leaves = single, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([single, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        leaves.append(order < n)
    take = 2 * n - 2
    for leaf in reversed(leaves):
        used = int(leaf[:take].sum())
        out[ids[:used]] += 1
        take = 2 * (take - used)
    return out


class Code:
    """Canonical codes of given lengths: shorter first, equal lengths by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        n = lengths[order].astype(np.int64)
        self.bits = int(n.max()) if len(n) else 1
        width = np.int64(1) << (self.bits - n)
        start = np.cumsum(width) - width
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (start >> (self.bits - n)).astype(np.uint64)
        # The table: the next ``bits`` bits name the id and the length of its code.
        self.ids = np.repeat(order.astype(np.uint32), width)
        self.steps = np.repeat(n.astype(np.uint8), width)
        gap = (1 << self.bits) - len(self.ids)
        self.ids, self.steps = np.pad(self.ids, (0, gap)), np.pad(self.steps, (0, gap))

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The codes of ids, and the bit at which each block starts."""
        n = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(n)
        at = ends - n
        words = np.zeros((int(ends[-1]) if len(ids) else 0) // 64 + 2, np.uint64)
        code, shift = self.codes[ids], 64 - (at & 63) - n
        fits = shift >= 0
        first = np.where(fits, code << np.maximum(shift, 0).astype(np.uint64), code >> np.maximum(-shift, 0).astype(np.uint64))
        if len(ids):
            word = at >> 6
            cut = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[cut]] = np.bitwise_or.reduceat(first, cut)
            over = np.flatnonzero(~fits)  # at most one code runs into each word
            words[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
        return words.astype(">u8").tobytes(), at[::BLOCK].astype(np.uint64)

    def unpack(self, codes: bytes, starts: np.ndarray, count: int) -> np.ndarray:
        """All ids: the blocks advance together, one table look-up per id of each block."""
        out = np.zeros((len(starts), BLOCK), np.uint32)
        raw = np.frombuffer(codes, np.uint8)
        # Four bytes from any byte on hold the seven bits before and a code of up to 20 bits (limit 25).
        window = (raw[:-3].astype(np.uint32) << 24) | (raw[1:-2].astype(np.uint32) << 16) | (raw[2:-1].astype(np.uint32) << 8) | raw[3:]
        at = starts.astype(np.int64)
        for k in range(min(BLOCK, count)):
            live = at if k < (count - 1) % BLOCK + 1 else at[:-1]
            got = (window[live >> 3] << (live & 7).astype(np.uint32)) >> np.uint32(32 - self.bits)
            out[: len(live), k] = self.ids[got]
            live += self.steps[got]
        return out.reshape(-1)[:count]


def write_frame(code: Code, first: bool, pieces: list[tuple[int, int, bool]], ids: np.ndarray) -> bytes:
    payload, starts = code.pack(ids)
    doc, n, last = zip(*pieces)
    header = zlib.compress((code.lengths.tobytes() if first else b"") + np.array(doc, "<i8").tobytes()
                           + np.array(n, "<u4").tobytes() + np.array(last, np.uint8).tobytes() + starts.astype("<u8").tobytes(), 1)
    head = _HEAD.pack(b"HUF1", len(code.lengths), len(ids), len(pieces), len(starts), len(payload), len(header),
                      zlib.crc32(header + payload))
    return head + header + payload


def read_frames(stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """doc ids, counts, last flags and ids of each frame, one frame in memory at a time."""
    code = None
    while head := stream.read(_HEAD.size):
        magic, alphabet, n, pieces, blocks, size, header_size, crc = _HEAD.unpack(head)
        body = stream.read(header_size + size)
        if magic != b"HUF1" or zlib.crc32(body) != crc:
            raise ValueError("damaged frame")
        header, at = zlib.decompress(body[:header_size]), 0
        if code is None:
            code, at = Code(np.frombuffer(header, np.uint8, alphabet)), alphabet
        doc = np.frombuffer(header, "<i8", pieces, at)
        counts = np.frombuffer(header, "<u4", pieces, at + 8 * pieces)
        last = np.frombuffer(header, np.uint8, pieces, at + 12 * pieces)
        starts = np.frombuffer(header, "<u8", blocks, at + 13 * pieces)
        yield doc, counts, last, code.unpack(body[header_size:], starts, n)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id and ids (unsigned little-endian; 16 bits where the vocabulary allows)."""

    def work(batch):
        use = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        ids = [use.encode(t) + end for t in batch.column(1).to_pylist()]
        if use.size <= 1 << 16:
            ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
        return {"doc_id": batch.column(0), "ids": pa.array(ids, pa.binary()),
                "width": pa.array([2 if use.size <= 1 << 16 else 4] * len(ids), pa.int32())}

    return by_batch(documents(docs), work, "doc_id long, ids binary, width int")


def _ids(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if width == 2 else "<u4")


def counts(ids: DataFrame, alphabet: int) -> np.ndarray:
    """How often each id occurs in all rows; the driver gets one row per id of the vocabulary at most."""

    def run(batches):
        n = np.zeros(alphabet, np.int64)
        for batch in batches:
            for raw, width in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n += np.bincount(_ids(raw, width), minlength=alphabet)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(n[seen], pa.int64())], ["id", "n"])

    out = np.zeros(alphabet, np.int64)
    for row in ids.select("ids", "width").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row["id"]] = row["n"]
    return out


def write(ids: DataFrame, lengths: np.ndarray, folder: str, total: int) -> DataFrame:
    """Write files in ascending doc_id order; returns (part, path, tokens) of each, part by part.

    A file gets a fresh name and is listed only by the attempt that finished, so a task may run again.
    """
    parts = max(1, -(-total // FILE))
    ranged = ids.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")

    def run(batches):
        fs, path = filesystem(folder)
        name = f"{path}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.huf"
        code, held, pieces, size, total, out = Code(lengths), [], [], 0, 0, None
        for batch in batches:
            for doc, raw, width in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "width"))):
                x, at = _ids(raw, width), 0
                while at < len(x):
                    take = x[at:at + FRAME - size]
                    at += len(take)
                    held.append(take)
                    pieces.append((doc, len(take), at == len(x)))
                    size += len(take)
                    if size == FRAME:
                        if out is None:
                            fs.create_dir(path, recursive=True)
                            out = fs.open_output_stream(name)
                        out.write(write_frame(code, not total, pieces, np.concatenate(held)))
                        total, held, pieces, size = total + size, [], [], 0
        if pieces:
            if out is None:
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(name)
            out.write(write_frame(code, not total, pieces, np.concatenate(held)))
            total += size
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]),
                                              pa.array([total], pa.int64())], ["part", "path", "tokens"])

    return store(ranged.mapInArrow(run, "part int, path string, tokens long"), "files")


def read(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("path", F.coalesce(before, F.lit(0)).alias("base"))  # one row per file

    def run(batches):
        fs, _ = filesystem(folder)
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_stream(path) as stream:
                    n, crc = 0, 0
                    for doc, counts_, last, ids in read_frames(stream):
                        rows, place = [], 0
                        raw = memoryview(ids.astype("<u4").tobytes())
                        for d, c, end in zip(doc.tolist(), counts_.tolist(), last.tolist()):
                            crc = zlib.crc32(raw[4 * place:4 * (place + c)], crc)
                            place, n = place + c, n + c
                            if end:
                                rows.append((d, at, n, crc))
                                at, n, crc = at + n, 0, 0
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                                             ["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = max(1, files.count())
    return files.repartition(min(parts, 1 << 14), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def archive(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> tuple[DataFrame, str]:
    """Encode all documents into Huffman-coded files; returns the table of files and their folder.

    Null and empty texts are the end id alone; rows with a null id are left out; rows with equal ids follow
    one another in the order of their token ids. No rows: no file. Codes come from the counts of all rows.
    """
    ids = store(tokenized(docs, tokenizer, end_id), "ids")
    n = counts(ids, encoder(tokenizer).size)
    folder = folder or shared_folder(docs.sparkSession, "huffman")
    return write(ids, code_lengths(n), folder, int(n.sum())), folder
