"""Order statistics and clipped moments of many columns at once, for all rows and with each group left out.

The table stays wide: no column is turned into rows and no row is copied for a fold. A task makes one histogram per
column over the intervals that still hold a wanted rank, split by group. Histograms add up, and those of all groups
less one group's own are those of the fold that leaves it out; so the rows are read the same number of times for
any number of groups. An interval shrinks to a bin's own least and greatest value, until so few rows are left
that their values can be counted one by one: the result is exact for every distribution. Clipped moments come from
one more pass, by segments between the folds' bounds.

Only finite values have ranks; NULL, NaN and infinity are left out of each column by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellfleet.plans.small import SMALL_ROWS, collect_bounded

#: Values left in all intervals together that are counted one by one, rows of a task looked at together.
FEW, BLOCK = 50_000, 1 << 17
MAX_GROUPS, MAX_PASSES = 256, 200


def blocks(batches: Iterator[pa.RecordBatch], groups: list, n_columns: int, rows: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a task in large blocks: group numbers (the first column's) and values, missing ones NaN."""
    held, full = [], 0
    values = pa.array(groups)

    def joined():
        t = pa.Table.from_batches(held)
        x = np.column_stack([t.column(i + 1).to_numpy().astype(float) for i in range(n_columns)])
        x[~np.isfinite(x)] = np.nan
        g = pc.index_in(t.column(0), values.cast(t.column(0).type)).combine_chunks()
        return g.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), x

    for batch in batches:
        held.append(batch)
        full += batch.num_rows
        if full >= (rows or BLOCK):
            yield joined()
            held, full = [], 0
    if full:
        yield joined()


class Folds:
    """All rows (fold None) and, with ``key``, every fold that leaves one group out."""

    def __init__(self, df: DataFrame, columns: Sequence[str], key: str | None = None):
        self.columns, self.key = list(columns), key
        group = F.col(key) if key else F.lit(0)
        self.df = df.select(group.alias("_g"), *[F.col(c).cast("double").alias(c) for c in self.columns])
        fine = {c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in self.columns}
        aggs = [f(x).alias(f"{n}_{c}") for c, x in fine.items() for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max), ("s", F.avg))]
        rows = collect_bounded(self.df.where(F.col("_g").isNotNull()).groupBy("_g").agg(*aggs), MAX_GROUPS, "groups")
        rows.sort(key=lambda r: r["_g"])
        self.groups = [r["_g"] for r in rows]
        pick = lambda n, none: np.array([[r[f"{n}_{c}"] if r[f"{n}_{c}"] is not None else none for c in self.columns] for r in rows], float)
        shape = (len(rows), len(self.columns))
        self.n = pick("n", 0).reshape(shape).astype(np.int64)
        self.lo = pick("lo", np.inf).reshape(shape).min(axis=0, initial=np.inf)
        self.hi = pick("hi", -np.inf).reshape(shape).max(axis=0, initial=-np.inf)
        size = self.n.sum(axis=0)
        self.shift = (pick("s", 0).reshape(shape) * self.n).sum(axis=0) / np.maximum(size, 1)
        self.folds: list[int | None] = [None, *(range(len(self.groups)) if key else [])]

    def name(self, fold: int | None):
        return None if fold is None else self.groups[fold]

    def _of(self, by_group: np.ndarray, fold: int | None) -> np.ndarray:
        """A fold's sums from sums by group (the last axis)."""
        whole = by_group.sum(axis=-1)
        return whole if fold is None else whole - by_group[..., fold]

    def _pass(self, work: Callable[[np.ndarray, np.ndarray], Iterator[tuple]], schema: str, by: list[str], sums: dict) -> list:
        """Columns that a function of each block gives, aggregated and collected (bounded)."""
        groups, k = self.groups, len(self.columns)
        fields = [f.split() for f in schema.split(", ")]
        names, kinds = [n for n, _ in fields], [{"long": pa.int64(), "double": pa.float64()}[t] for _, t in fields]

        def run(batches):
            for g, x in blocks(batches, groups, k):
                for part in work(g, x):
                    yield pa.RecordBatch.from_arrays([pa.array(v).cast(t) for v, t in zip(part, kinds)], names)

        out = self.df.mapInArrow(run, schema).groupBy(*by).agg(*[f(c).alias(c) for c, f in sums.items()])
        return collect_bounded(out, SMALL_ROWS, "histograms")

    def _histogram(self, spans: dict[int, np.ndarray], bins: int) -> dict[tuple[int, int], tuple]:
        """(column, interval) -> counts by bin and group, least and greatest value of each bin that has any."""
        n_groups = len(self.groups)

        def work(g, x):
            for c, span in spans.items():
                v = x[:, c]
                i = np.searchsorted(span[:, 0], v, side="right") - 1  # NaN sorts last: not below its interval's end
                use = np.flatnonzero((i >= 0) & (g >= 0) & (v <= span[np.maximum(i, 0), 1]))
                if not len(use):
                    continue
                i, v = i[use], v[use]
                lo, hi = span[i, 0], span[i, 1]
                width = hi / bins - lo / bins
                share = np.divide(v, width, out=np.zeros_like(v), where=width > 0) - np.divide(lo, width, out=np.zeros_like(v), where=width > 0)
                b = np.clip(np.floor(share), 0, bins - 1).astype(np.int64)
                code = (i * bins + b) * n_groups + g[use]
                order = np.argsort(code, kind="stable")
                code, v = code[order], v[order]
                at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                yield (np.full(len(at), c), code[at], np.diff(np.append(at, len(code))), np.minimum.reduceat(v, at), np.maximum.reduceat(v, at))

        rows = self._pass(work, "c long, code long, n long, lo double, hi double", ["c", "code"], {"n": F.sum, "lo": F.min, "hi": F.max})
        found: dict[tuple[int, int], dict[int, list]] = {}
        for r in rows:
            cell, g = divmod(r["code"], n_groups)
            i, b = divmod(cell, bins)
            here = found.setdefault((r["c"], i), {}).setdefault(b, [np.zeros(n_groups, np.int64), np.inf, -np.inf])
            here[0][g] += r["n"]
            here[1], here[2] = min(here[1], r["lo"]), max(here[2], r["hi"])
        return {k: tuple(np.array(v) for v in zip(*(bins_[b] for b in sorted(bins_)))) for k, bins_ in found.items()}

    def _values(self, spans: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Column -> distinct values in its intervals, ascending, and their counts by group."""
        n_groups = len(self.groups)

        def work(g, x):
            for c, span in spans.items():
                v = x[:, c]
                i = np.searchsorted(span[:, 0], v, side="right") - 1
                use = (i >= 0) & (g >= 0) & (v <= span[np.maximum(i, 0), 1])
                pairs, n = np.unique(np.column_stack([v[use], g[use]]), axis=0, return_counts=True)
                if len(n):
                    yield np.full(len(n), c), pairs[:, 0], pairs[:, 1].astype(np.int64), n

        rows = self._pass(work, "c long, v double, g long, n long", ["c", "v", "g"], {"n": F.sum})
        out = {}
        for c in spans:
            mine = [r for r in rows if r["c"] == c]
            values, place = np.unique([r["v"] for r in mine], return_inverse=True)
            counts = np.zeros((len(values), n_groups), np.int64)
            np.add.at(counts, (place, [r["g"] for r in mine]), [r["n"] for r in mine])
            out[c] = (values, counts)
        return out

    def _search(self, wants: set[tuple]) -> dict[tuple, float]:
        """The value at each wanted (fold, column, 1-based rank)."""
        # Where each want lies: interval (lo, hi) of its column, rank within it.
        at = {w: (self.lo[w[1]], self.hi[w[1]], w[2]) for w in wants}
        left = {(c, self.lo[c], self.hi[c]): int(self.n[:, c].sum()) for _, c, _ in wants}
        for _ in range(MAX_PASSES):
            open_ = {k: n for k, n in left.items() if k[1] < k[2]}
            if sum(open_.values()) <= FEW:
                break
            spans = _spans(open_)
            n_open = sum(len(s) for s in spans.values())
            bins = max(16, min(4096, SMALL_ROWS // (len(self.groups) * n_open)))
            found = self._histogram(spans, bins)
            left = {k: n for k, n in left.items() if k[1] == k[2]}
            for w, (lo, hi, r) in at.items():
                if lo == hi:
                    continue
                fold, c, _ = w
                counts, los, his = found[(c, int(np.searchsorted(spans[c][:, 0], lo)))]
                cum = np.cumsum(self._of(counts, fold))
                b = int(np.searchsorted(cum, r))
                at[w] = (los[b], his[b], r - (int(cum[b - 1]) if b else 0))
                left[(c, los[b], his[b])] = int(counts[b].sum())
        else:
            raise RuntimeError("a histogram interval does not shrink")
        values = self._values(_spans(open_)) if open_ else {}
        out = {}
        for w, (lo, hi, r) in at.items():
            if lo == hi:
                out[w] = float(lo)
                continue
            v, counts = values[w[1]]
            a, b = np.searchsorted(v, lo), np.searchsorted(v, hi, side="right")
            out[w] = float(v[a + int(np.searchsorted(np.cumsum(self._of(counts[a:b], w[0])), r))])
        return out

    def percentiles(self, fractions: Sequence[float], columns: Sequence[str] | None = None) -> dict:
        """Fold -> exact percentiles (column x fraction) with linear interpolation; NaN where a column has no value.

        With ``columns`` only these are searched for; a column of one value needs no search.
        """
        spots = {}
        for fold in self.folds:
            for c, n in enumerate(self._of(self.n.T, fold)):
                if columns is not None and self.columns[c] not in columns:
                    continue
                for f in fractions:
                    spots[(fold, c, f)] = float((n - 1) * f) if n else None
        ranks = lambda x: (int(np.floor(x)) + 1, int(np.ceil(x)) + 1)
        found = self._search({(fold, c, r) for (fold, c, _), x in spots.items() if x is not None for r in ranks(x)})
        out = {fold: np.full((len(self.columns), len(fractions)), np.nan) for fold in self.folds}
        for (fold, c, f), x in spots.items():
            if x is not None:
                a, b = (found[(fold, c, r)] for r in ranks(x))
                out[fold][c, list(fractions).index(f)] = a + (b - a) * (x - np.floor(x))
        return out

    def clipped_moments(self, bounds: dict) -> dict:
        """Fold -> (mean, population spread) of each column's values clipped to the fold's bounds (column x 2)."""
        k, shift = len(self.columns), self.shift
        edges = [np.unique([b[c, j] for b in bounds.values() for j in (0, 1) if not np.isnan(b[c, j])]) for c in range(k)]
        own = np.array([bounds[i] for i in range(len(self.groups))]) if self.key else None

        def sums(kind, c, place, x, n_places):
            n = np.bincount(place, minlength=n_places)
            s1, s2 = (np.bincount(place, p, minlength=n_places) for p in (x, x * x))
            at = np.flatnonzero(n)
            return np.full(len(at), kind), np.full(len(at), c), at, n[at], s1[at], s2[at]

        def work(g, x):
            for c in range(k):
                use = np.flatnonzero(~np.isnan(x[:, c]) & (g >= 0))
                v = x[use, c]
                yield sums(0, c, np.searchsorted(edges[c], v, side="right"), v - shift[c], len(edges[c]) + 1)
                if own is not None:
                    lo, hi = own[g[use], c, 0], own[g[use], c, 1]
                    part = (v >= lo).astype(np.int64) + (v >= hi)
                    yield sums(1, c, g[use] * 3 + part, v - shift[c], len(own) * 3)

        rows = self._pass(work, "kind long, c long, place long, n long, s1 double, s2 double", ["kind", "c", "place"], {"n": F.sum, "s1": F.sum, "s2": F.sum})
        whole = [np.zeros((len(e) + 1, 3)) for e in edges]
        mine = np.zeros((k, max(1, len(self.groups)), 3, 3))
        for r in rows:
            v = (r["n"], r["s1"], r["s2"])
            if r["kind"] == 0:
                whole[r["c"]][r["place"]] = v
            else:
                mine[r["c"], r["place"] // 3, r["place"] % 3] = v
        out = {}
        for fold in self.folds:
            mean, std = np.full(k, np.nan), np.full(k, np.nan)
            for c in range(k):
                lo, hi = bounds[fold][c]
                if np.isnan(lo):
                    continue
                a, b = np.searchsorted(edges[c], [lo, hi])
                parts = np.array([whole[c][:a + 1].sum(axis=0), whole[c][a + 1:b + 1].sum(axis=0), whole[c][b + 1:].sum(axis=0)])
                if fold is not None:
                    parts = parts - mine[c, fold]
                n, (l, h) = parts[:, 0].sum(), (lo - shift[c], hi - shift[c])
                s1 = parts[1, 1] + parts[0, 0] * l + parts[2, 0] * h
                s2 = parts[1, 2] + parts[0, 0] * l * l + parts[2, 0] * h * h
                mean[c] = shift[c] + s1 / n
                std[c] = np.sqrt(max(0.0, s2 / n - (s1 / n) ** 2)) if lo < hi else 0.0
            out[fold] = (mean, std)
        return out


def _spans(keys) -> dict[int, np.ndarray]:
    """Column -> its intervals, ascending."""
    out: dict[int, list] = {}
    for c, lo, hi in sorted(keys):
        out.setdefault(c, []).append((lo, hi))
    return {c: np.array(v) for c, v in out.items()}
