"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing with exact reranking.

Vectors get one more component that makes all their norms equal, and queries are scaled to that norm, so
the largest inner product is the least distance. A table hashes a vector by a few functions
floor((a . v + b) / width) with Gaussian a. For a query, the buckets of a table are perturbations of its
own; they are visited in order of the estimated chance of success (least squared distance to the bucket,
as in query-directed probing) until they hold a given share of all vectors. Candidates of all tables are
merged and ranked by the inner product of the original vectors.

Equal vectors are one entry with their smallest ids. Hash values are clipped, so the directory of buckets
has at most bins ** functions rows a table at any number of vectors. Large buckets are split into parts.

Entries lie once, with their codes, in packs in the work folder. A task answers a block of queries: it reads
the packs by shelves of bounded size, and what it holds besides is bounded by the block, not by the table.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import filesystem, shared_folder, store

TABLES, FUNCTIONS, WIDTH, BINS, SHARE = 3, 5, 1.2, 6, 0.45
#: Vectors of one part, and queries of a block, which meet a part at once.
PART, QUERIES, SEED = 1 << 14, 1 << 11, 11
#: Bytes of the vectors of a pack, and of those read at once; products made at once, and candidates held; groups of parts.
SHELF, PRODUCTS, HELD, GROUPS = 1 << 25, 1 << 18, 1 << 19, 4
#: Queries whose visits are planned at once.
PLANNED = 128
#: So few vectors are all looked at.
FEW = 1_000


@dataclass
class Index:
    """Hash functions, and the directory: of each table's buckets the values, rows and parts."""

    norm: float
    a: np.ndarray  # (tables, dims + 1, functions)
    b: np.ndarray  # (tables, functions)
    values: list[np.ndarray] | None = None
    counts: list[np.ndarray] | None = None
    first: list[np.ndarray] | None = None  # the first part of each bucket; it has ceil(rows / PART)
    group: np.ndarray | None = None  # group of each part

    @classmethod
    def drawn(cls, dims: int, norm: float, tables: int = TABLES, functions: int = FUNCTIONS) -> Index:
        r = np.random.default_rng(SEED)
        return cls(norm, r.normal(size=(tables, dims + 1, functions)), r.uniform(0, 1, size=(tables, functions)))

    def places(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Unrounded hash values, (tables, rows, functions), in units of the width."""
        if query:
            x = x * (self.norm / np.linalg.norm(x, axis=1))[:, None]
            last = np.zeros(len(x))
        else:
            last = np.sqrt(np.maximum(0.0, self.norm ** 2 - np.square(x).sum(1)))
        v = np.hstack([x, last[:, None]]) / self.norm
        return v @ self.a / WIDTH + self.b[:, None, :]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Bucket codes, (tables, rows): clipped hash values as digits."""
        cells = np.clip(np.floor(self.places(x)) + BINS // 2, 0, BINS - 1).astype(np.int64)
        return cells @ (BINS ** np.arange(cells.shape[2]))

    def directory(self, rows: list, groups: int) -> None:
        """rows: (table, code, count) of all buckets. Parts are dealt into groups of like size, in order."""
        tables = self.a.shape[0]
        self.values, self.counts, self.first = [], [], []
        parts, sizes = 0, []
        self.code = []
        for t in range(tables):
            own = sorted((code, n) for table, code, n in rows if table == t)
            code = np.array([c for c, _ in own], np.int64)
            n = np.array([c for _, c in own], np.int64)
            split = -(-n // PART)
            self.code.append(code)
            self.values.append((code[:, None] // BINS ** np.arange(self.a.shape[2])) % BINS - BINS // 2)
            self.counts.append(n)
            self.first.append(parts + np.cumsum(split) - split)
            sizes.append(np.repeat(n / np.maximum(split, 1), split))
            parts += int(split.sum())
        size = np.concatenate(sizes) if sizes else np.zeros(0)
        self.group = np.minimum((np.cumsum(size) - size) * groups / max(1.0, size.sum()), groups - 1).astype(np.int64)

    def part_of(self, codes: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """Part of each row in each table, (tables, rows)."""
        out = []
        for t, code in enumerate(codes):
            at = np.searchsorted(self.code[t], code)
            out.append(self.first[t][at] + salt % -(-self.counts[t][at] // PART))
        return np.array(out)

    def probes(self, x: np.ndarray, share: float) -> list[np.ndarray]:
        """Parts that each query visits; buckets as far away as the last one needed are visited too."""
        out: list[list] = [[] for _ in x]
        low = np.arange(BINS) - BINS // 2.0
        high = low + 1
        low[0], high[-1] = -np.inf, np.inf
        for t, place in enumerate(self.places(x, query=True)):
            cell = np.square(np.maximum(np.maximum(low - place[:, :, None], place[:, :, None] - high), 0))
            away = np.zeros((len(x), len(self.counts[t])))
            for f, digit in enumerate((self.values[t] + BINS // 2).T):
                away += cell[:, f].take(digit, axis=1)
            order = np.argsort(away, axis=1)
            filled = np.cumsum(self.counts[t][order], axis=1)
            last = np.minimum((filled < share * self.counts[t].sum()).sum(1), len(self.counts[t]) - 1)
            every = np.arange(len(x))
            seen = away <= away[every, order[every, last]][:, None]
            split = -(-self.counts[t] // PART)
            for i in every:
                got = np.flatnonzero(seen[i])
                out[i].append(np.repeat(self.first[t][got], split[got]) + _ramp(split[got]))
        return [np.concatenate(p) for p in out]

    def asked(self, x: np.ndarray, share: float) -> np.ndarray:
        """Whether a query visits a part, (parts, queries)."""
        out = np.zeros((len(self.group), len(x)), bool)
        for at in range(0, len(x), PLANNED):
            some = np.zeros((len(x[at:at + PLANNED]), len(out)), bool)
            for one, parts in zip(some, self.probes(x[at:at + PLANNED], share)):
                one[parts] = True
            out[:, at:at + PLANNED] = some.T
        return out


def _ramp(counts: np.ndarray) -> np.ndarray:
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _encoded(x: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """Vectors as bytes that sort as the vectors do, and their squared lengths. None is empty."""
    at = x.offsets.to_numpy()
    v = x.flatten().to_numpy() + 0.0  # without a negative zero
    bits = v.view(f"u{v.itemsize}")
    top = 8 * v.itemsize - 1
    bits = bits ^ np.where(bits >> top, ~bits.dtype.type(0), bits.dtype.type(1 << top))
    data = bits.astype(f">u{v.itemsize}")
    ends = ((at - at[0]) * v.itemsize).astype(np.int32)
    out = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return out, np.add.reduceat(np.square(v.astype(float)), at[:-1] - at[0])


def _decoded(column: pa.BinaryArray, size: int, dims: int) -> np.ndarray:
    """The vectors, (rows, dims), of components of ``size`` bytes, from their bytes."""
    start = np.frombuffer(column.buffers()[1], np.int32, 1, 4 * column.offset)[0]
    bits = np.frombuffer(column.buffers()[2], f">u{size}", len(column) * dims, start).astype(f"u{size}")
    top = 8 * size - 1
    bits ^= np.where(bits >> top, bits.dtype.type(1 << top), ~bits.dtype.type(0))
    return bits.view(f"f{size}").reshape(-1, dims)


def vectors(rows: DataFrame) -> DataFrame:
    """vec_id, x (sortable bytes) and squared length of the rows that take part: no null, zero or not finite vector or component.

    Of rows that repeat a vec_id the least vector counts; vectors of another size than most are left out.
    Floats stay floats, other components become doubles.
    """
    kind = f"array<{_kind(rows)}>"
    x = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("x"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    x = x.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(fine)

    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                x, square = _encoded(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), x, pa.array(square)], ["vec_id", "x", "square"])

    least = x.mapInArrow(encode, "vec_id long, x binary, square double").groupBy("vec_id").agg(F.min(F.struct("x", "square")).alias("v"))
    return least.select("vec_id", "v.x", "v.square")


def _kind(rows: DataFrame) -> str:
    kind = getattr(rows.schema["embedding"].dataType, "elementType", None)
    return "float" if kind is not None and kind.typeName() == "float" else "double"


@dataclass
class Shelf:
    """Entries that are looked at together: vectors, ids (those of entry i from at[i] to at[i + 1], in order), codes."""

    x: np.ndarray
    ids: np.ndarray
    at: np.ndarray
    codes: np.ndarray  # (tables, rows)

    @classmethod
    def read(cls, paths: list[str], dims: int, tables: int) -> Shelf:
        fs, _ = filesystem(paths[0])
        found = []
        for path in paths:
            with fs.open_input_file(filesystem(path)[1]) as f:
                found.append(pa.ipc.open_file(f).read_all())
        x, ids, codes = (c.combine_chunks() for c in pa.concat_tables(found).columns)
        at = ids.offsets.to_numpy()
        return cls(x.flatten().to_numpy().reshape(-1, dims), ids.flatten().to_numpy(), at - at[0], codes.flatten().to_numpy().reshape(-1, tables).T)


class Block:
    """The k best others of each query of a block among the entries of the shelves seen so far.

    Products in single precision, of vectors scaled to at most 1, say which pairs may be among the best; these get exact scores.
    What a product may be off by is in proportion to the entry's length.
    """

    def __init__(self, index: Index, ids: np.ndarray, x: np.ndarray, k: int, share: float):
        self.index, self.ids, self.x, self.k = index, ids, x, k
        self.asked = index.asked(x, share)
        self.scale = index.norm * np.linalg.norm(x, axis=1)
        self.rough = (x * (index.norm / self.scale)[:, None]).astype(np.float32)
        self.bar = np.full(len(x), -np.inf)  # lower scores are not among the best
        self.top = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)  # query, score, vec_id

    def see(self, shelf: Shelf) -> None:
        if not len(shelf.x):
            return
        first = shelf.ids[shelf.at[:-1]]
        off = self._off(shelf.x)
        part = self.index.part_of(shelf.codes, first).ravel()
        order = np.argsort(part, kind="stable")
        part, row = part[order], order % len(first)
        begin = np.union1d(np.flatnonzero(np.diff(part, prepend=-1)), np.arange(0, len(part), PART))
        group = self.index.group[part[begin]]
        held, size, kept = [], 0, 0
        bar = self._rough_bar()
        for i, (b, e) in enumerate(zip(begin, np.append(begin[1:], len(part)))):
            a = np.flatnonzero(self.asked[part[b]])
            if not len(a):
                continue
            r = row[b:e]
            v, most = (shelf.x[r] / np.float64(self.index.norm)).astype(np.float32).T, off[r].max()
            step = max(1, PRODUCTS // len(r))
            for at in range(0, len(a), step):
                some = a[at:at + step]
                s = self.rough[some] @ v
                hit = np.flatnonzero((s >= (bar[some] - most)[:, None]).ravel())
                if len(hit):
                    one, two = np.divmod(hit, len(r))
                    one, two, s = some[one], r[two], s.ravel()[hit]
                    near = s + off[two] >= bar[one]
                    held.append((one[near], two[near], s[near]))
                    size += len(held[-1][0])
                if size > HELD + 2 * kept:
                    held = [self._best(shelf, first, off, held)[:3]]
                    size, kept, bar = len(held[0][0]), len(held[0][0]), self._rough_bar()
            if held and i + 1 < len(group) and group[i + 1] != group[i]:
                held = [self._best(shelf, first, off, held)[:3]]
                size, kept, bar = len(held[0][0]), len(held[0][0]), self._rough_bar()
        if held:
            a, r, _, s = self._best(shelf, first, off, held)
            self._merge(shelf, a, r, s)

    def _off(self, x: np.ndarray) -> np.ndarray:
        """What rough products of the entries may be off by: twice the bound on rounding, and what is too small for a float."""
        out = np.empty(len(x), np.float32)
        floats = np.finfo(np.float32)
        for at in range(0, len(x), PART):
            v = x[at:at + PART] / np.float64(self.index.norm)
            out[at:at + PART] = (x.shape[1] + 8) * (floats.eps * np.sqrt(np.einsum("ij,ij->i", v, v)) + 2 * floats.tiny)
        return out

    def _rough_bar(self) -> np.ndarray:
        # One step down, as rounding may have raised it.
        return np.nextafter((self.bar / self.scale).astype(np.float32), np.float32(-np.inf))

    def _best(self, shelf: Shelf, first: np.ndarray, off: np.ndarray, held: list) -> tuple[np.ndarray, ...]:
        """Of the entries held, the k + 1 best of each query (it may be one of them): query, row, rough and exact score.

        Ties go to the smaller first id.
        """
        a, r, s = (np.concatenate(c) for c in zip(*held))
        once = np.unique(a * len(first) + r, return_index=True)[1]  # several tables show the same
        a, r, s = a[once], r[once], s[once]
        low = s - off[r]
        o = np.lexsort((-low, a))
        least = np.full(len(self.x), -np.inf, np.float32)
        last = o[_rank(a[o]) == self.k]
        least[a[last]] = low[last]
        near = s + off[r] >= least[a]
        a, r, rough = a[near], r[near], s[near]
        s = np.empty(len(a))
        for at in range(0, len(a), PART):
            s[at:at + PART] = np.einsum("ij,ij->i", self.x[a[at:at + PART]], shelf.x[r[at:at + PART]].astype(float))
        o = np.lexsort((first[r], -s, a))
        rank = _rank(a[o])
        last = o[rank == self.k]
        self.bar[a[last]] = np.maximum(self.bar[a[last]], s[last])
        o = o[rank <= self.k]
        return a[o], r[o], rough[o], s[o]

    def _merge(self, shelf: Shelf, a: np.ndarray, r: np.ndarray, s: np.ndarray) -> None:
        n = shelf.at[r + 1] - shelf.at[r]
        a, s, ids = np.repeat(a, n), np.repeat(s, n), shelf.ids[np.repeat(shelf.at[r], n) + _ramp(n)]
        other = ids != self.ids[a]
        a, s, ids = (np.concatenate([old, new[other]]) for old, new in zip(self.top, (a, s, ids)))
        o = np.lexsort((ids, -s, a))
        o = o[_rank(a[o]) < self.k]
        self.top = a, s, ids = a[o], s[o], ids[o]
        last = _rank(a) == self.k - 1
        self.bar[a[last]] = np.maximum(self.bar[a[last]], s[last])

    def answer(self) -> pa.RecordBatch:
        a, s, ids = self.top
        return pa.RecordBatch.from_arrays([pa.array(self.ids[a]), pa.array((_rank(a) + 1).astype(np.int32)), pa.array(ids), pa.array(s)], ["query_id", "rank", "vec_id", "score"])


def _rank(a: np.ndarray) -> np.ndarray:
    """Places within the runs of a sorted array."""
    return np.arange(len(a)) - np.searchsorted(a, a, "left")


def nearest(rows: DataFrame, queries: int = 20, k: int = 20, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by ``queries`` its k best others found.

    Ties go to the smaller vec_id. With fewer than k others all are returned. A query of copies gets the
    copies like other vectors, without its own id. Each table shows a query a ``share`` of all vectors.
    """
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    size = 4 if _kind(rows) == "float" else 8
    all_ = store(vectors(rows), "vectors")
    sizes = all_.groupBy((F.octet_length("x") / size).cast("int").alias("d")).agg(
        F.count("*").alias("n"), F.max("square").alias("m")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dims, norm = sizes["d"], math.sqrt(sizes["m"])
    all_ = all_.where(F.octet_length("x") == dims * size)
    if sizes["n"] <= FEW:
        share = 1.0  # so few that every bucket is visited
    # A copy of rank k + 2 or later can't be among the best k: it is cut before the shuffle already.
    copies = all_.select("x", "vec_id", F.row_number().over(Window.partitionBy("x").orderBy("vec_id")).alias("r")).where(F.col("r") <= k + 1)
    entries = copies.groupBy("x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    index = Index.drawn(dims, norm)
    tables, folder = len(index.a), shared_folder(spark, "entries")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes packs; of each its rows (table -1) and its buckets' rows."""
        fs, path = filesystem(folder)
        out, rows, buckets = None, 0, None

        def closed() -> pa.RecordBatch:
            writer.close()
            out.close()
            t, code = np.nonzero(buckets)
            t, code, n = np.append(t, -1), np.append(code, 0), np.append(buckets[t, code], rows)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(t)), pa.array(t, pa.int32()), pa.array(code), pa.array(n)], ["path", "t", "code", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, step := max(1, SHELF // (size * dims))):
                some = batch.slice(at, step)
                x = _decoded(some.column(0), size, dims)
                codes = index.codes(x.astype(float))
                ids = some.column(1)
                packed = pa.RecordBatch.from_arrays([
                    pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dims), ids.cast(pa.list_(pa.int64())),
                    pa.FixedSizeListArray.from_arrays(pa.array(codes.T.ravel().astype(np.int32)), tables)], ["x", "ids", "codes"])
                if out is None:
                    fs.create_dir(path, recursive=True)
                    file = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.arrow"
                    name, out = f"{folder}/{file}", fs.open_output_stream(f"{path}/{file}", compression=None)
                    writer = pa.ipc.new_file(out, packed.schema)
                    rows, buckets = 0, np.zeros((tables, BINS ** index.a.shape[2]), np.int64)
                writer.write_batch(packed)
                rows += len(x)
                for t, code in enumerate(codes):
                    buckets[t] += np.bincount(code, minlength=buckets.shape[1])
                if rows >= step:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    packs = store(entries.mapInArrow(pack, "path string, t int, code long, n long"), "packs")
    # At most tables * bins ** functions rows.
    index.directory([tuple(r) for r in packs.where("t >= 0").groupBy("t", "code").agg(F.sum("n")).collect()], GROUPS)
    shelves, filled = [], SHELF
    for path, n in sorted((r["path"], r["n"]) for r in packs.where("t < 0").collect()):
        if filled + n * dims * size > SHELF:
            shelves.append([])
            filled = 0
        shelves[-1].append(path)
        filled += n * dims * size
    shared = spark.sparkContext.broadcast((index, shelves))
    asking = all_.where(F.col("vec_id") % queries == 0)
    total, least = asking.count(), 2 * spark.sparkContext.defaultParallelism
    blocks = max(1, min(least * -(-total // (least * QUERIES)), -(-total // 16)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, stands = shared.value
        held, n = [], 0

        def answers() -> Iterator[pa.RecordBatch]:
            asked = pa.Table.from_batches(held).combine_chunks()
            ids = asked.column(0).to_numpy()
            x = np.concatenate([_decoded(c, size, dims) for c in asked.column(1).chunks]).astype(float)
            for at in range(0, len(ids), QUERIES):
                block = Block(use, ids[at:at + QUERIES], x[at:at + QUERIES], k, share)
                for stand in stands:
                    block.see(Shelf.read(stand, dims, tables))
                yield block.answer()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= QUERIES:
                yield from answers()
                held, n = [], 0
        if held:
            yield from answers()

    return asking.select("vec_id", "x").repartition(blocks).mapInArrow(meet, schema)
