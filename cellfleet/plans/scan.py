"""Ordered operators that survive a hot trajectory.

A trajectory is an ordered series of points. One of them may hold a large share of all rows,
so no operator here partitions a window by trajectory alone. Points carry a gapless position,
and ``chunk = position div CHUNK`` cuts every series into bounded pieces:

* frames of fixed reach (lags, 20-point contexts, labels h steps ahead) run inside a chunk,
  after copying the few rows at a chunk border into the neighbour (`halo`);
* unbounded frames and whole-series totals are two-level scans: partial aggregates per chunk,
  a window over the chunk table, and a join back on (trajectory, chunk) (`attach`).

Where no series is longer than a chunk, the usual case, a plan is one exchange and one sort, as
with a plain window; a filter on ``chunk`` tells beforehand.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellfleet.plans.small import cut, settle

KEY = "trajectory_id"
POS = "reference_index"
CHUNK = 131_072
# A key with more rows than this is cut by its order value before the first sort.
HOT_ROWS = 4_000_000


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def halo(df: DataFrame, back: int = 0, ahead: int = 0, key: str | Sequence[str] = KEY, pos: str = POS,
         size: int | None = None, spread: bool = True) -> DataFrame:
    """Add ``chunk`` and ``home``; copy border rows so that frames of that reach stay inside.

    ``home`` is false on copies, which only feed frames and must be dropped afterwards. Rows are
    spread by (key, chunk) here, because windows would accept an earlier partitioning by key
    alone, say from a join, and with it a hot key in one task. Skip it where a join or an
    aggregation by (key, chunk) comes next.
    """
    rows = _chunks(df, back, ahead, pos, size)
    return rows.repartition(*_keys(key), "chunk") if spread else rows


def _chunks(df: DataFrame, back: int, ahead: int, pos: str, size: int | None) -> DataFrame:
    size = size or CHUNK
    if back + ahead >= size:
        raise ValueError("a frame may not reach over a whole chunk")
    own = F.expr(f"`{pos}` div {size}")
    if not back and not ahead:
        return df.withColumn("chunk", own).withColumn("home", F.lit(True))
    offset = F.col(pos) % size
    places = F.when(offset >= size - back, F.array(own, own + 1)) if back else None
    if ahead:
        cond = (offset < ahead) & (own > 0)
        both = F.array(own, own - 1)
        places = F.when(cond, both) if places is None else places.when(cond, both)
    return df.withColumn("chunk", F.explode(places.otherwise(F.array(own)))).withColumn(
        "home", F.col("chunk") == own
    )


def series(key: str | Sequence[str] = KEY, pos: str = POS) -> WindowSpec:
    """The one window spec of all chunked operators: a single exchange and a single sort."""
    return Window.partitionBy(*_keys(key), "chunk").orderBy(pos)


def frame(back: int, ahead: int = 0, key: str | Sequence[str] = KEY, pos: str = POS) -> WindowSpec:
    return series(key, pos).rowsBetween(-back, ahead)


def running(key: str | Sequence[str] = KEY, pos: str = POS) -> WindowSpec:
    """From the first row of the chunk to the current one."""
    return series(key, pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole(key: str | Sequence[str] = KEY, pos: str = POS) -> WindowSpec:
    """All rows of the chunk, on the one shared spec."""
    return series(key, pos).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _long_series(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """Keys of series longer than a chunk, or None where there are none.

    The filter is on a partition column, so it sinks below the windows of ``df``, and on a stored
    table down to the index column's file statistics. At most rows / CHUNK keys come back.
    """
    later = df.where(F.col("chunk") >= 1)
    if later.agg(F.count("*")).first()[0] == 0:
        return None
    return settle(later.select(*keys).distinct())


Part = tuple[Column, Callable[[str], Column]]


def attach(
    df: DataFrame,
    total: dict[str, Part] | None = None,
    before: dict[str, Part] | None = None,
    key: str | Sequence[str] = KEY,
    pos: str = POS,
) -> DataFrame:
    """Attach series-level context to rows that carry ``chunk``.

    Each entry is (aggregate over rows, how its partial results merge), for instance
    ``(F.count("*"), F.sum)``. ``total`` covers the whole series and ``before`` the earlier chunks,
    where it is NULL in the first one. Where every series is one chunk, both are settled by the
    window over the chunk; otherwise the long series get a chunk table, joined by (key, chunk).
    """
    keys, total, before = _keys(key), total or {}, before or {}
    local = {n: e.over(whole(keys, pos)) for n, (e, _) in total.items()}
    long = _long_series(df, keys)
    if long is None:
        none = {n: F.when(F.lit(False), e.over(whole(keys, pos))) for n, (e, _) in before.items()}
        return df.withColumns({**local, **none})
    parts = {**total, **before}
    table = df.join(long, keys, "left_semi").groupBy(*keys, "chunk").agg(*[e.alias(n) for n, (e, _) in parts.items()])
    ordered = Window.partitionBy(*keys).orderBy("chunk")
    spans = (
        (total, "_t_", ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        (before, "", ordered.rowsBetween(Window.unboundedPreceding, -1)),
    )
    context = [m(n).over(w).alias(f"{p}{n}") for part, p, w in spans for n, (_, m) in part.items()]
    rows = df.join(settle(table.select(*keys, "chunk", *context)), [*keys, "chunk"], "left")
    merged = {n: F.coalesce(F.col(f"_t_{n}"), e) for n, e in local.items()}
    return rows.withColumns(merged).drop(*[f"_t_{n}" for n in total])


def attach_dim(df: DataFrame, dim: DataFrame, key: str = KEY) -> DataFrame:
    """Join a one-row-per-series table to rows that carry ``chunk``.

    The dimension may be as long as the fleet, so it is not broadcast by hint. Where a series is
    longer than a chunk, the dimension is spread over the chunks and joined chunk by chunk, and
    the rows stay spread for the windows that follow.
    """
    if _long_series(df, [key]) is None:
        return df.join(dim, key)
    pieces = df.select(key, "chunk").distinct().join(dim, key)
    return df.join(pieces, [key, "chunk"]).repartition(key, "chunk")


def running_sums(
    df: DataFrame, sums: dict[str, str | Column], key: str | Sequence[str] = KEY, pos: str = POS
) -> DataFrame:
    """Running sums over each whole series as two-level scans; ``df`` carries ``chunk``."""
    named = {n: F.col(c) if isinstance(c, str) else c for n, c in sums.items()}
    out = attach(df, before={f"_b_{n}": (F.sum(c), F.sum) for n, c in named.items()}, key=key, pos=pos)
    w = running(key, pos)
    cols = {n: F.coalesce(F.col(f"_b_{n}"), F.lit(0)) + F.sum(c).over(w) for n, c in named.items()}
    return out.withColumns(cols).drop(*[f"_b_{n}" for n in named])


def ordered_scan(
    df: DataFrame,
    key: str | Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column] | None = None,
    hot_rows: int | None = None,
    pos: str = POS,
    at_most: int | None = None,
) -> DataFrame:
    """Gapless position (from 0) and running sums by ``order`` within ``key``.

    Keys above ``hot_rows`` are cut into segments of about equal numbers of rows: they are range-partitioned by key and
    the whole order, whose splitters Spark draws from a sample, so a burst within a second or numbers far apart
    split as evenly as any others. There are at most rows / hot_rows such keys; where the whole table is no longer
    than that nothing is looked up. ``at_most`` is a known bound of the table's rows, which saves counting them.
    """
    hot_rows, keys, sums = hot_rows or HOT_ROWS, _keys(key), sums or {}
    plain = df.withColumn("_seg", F.lit(0).cast("long"))
    if (df.count() if at_most is None else at_most) <= hot_rows:
        return _positions(plain, keys, order, sums, pos)
    hot = settle(df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).select(*keys))
    if hot.isEmpty():
        return _positions(plain, keys, order, sums, pos)
    # Evaluated once: the segment of every row is settled before it is counted.
    ranged = cut(df.join(hot, keys, "left_semi").orderBy(*keys, *order).withColumn("_seg", F.spark_partition_id().cast("long")))
    table = ranged.groupBy(*keys, "_seg").agg(F.count("*").alias("_o"), *[F.sum(c).alias(f"_o_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    names = ["_o", *[f"_o_{n}" for n in sums]]
    offsets = settle(table.select(*keys, "_seg", *[F.sum(n).over(earlier).alias(n) for n in names]))
    placed = _positions(ranged.join(offsets, [*keys, "_seg"], "left"), keys, order, sums, pos, shifted=True).drop(*names)
    return placed.unionByName(_positions(plain.join(hot, keys, "left_anti"), keys, order, sums, pos))


def _positions(df: DataFrame, keys: list[str], order: Sequence[str], sums: dict[str, Column], pos: str,
               shifted: bool = False) -> DataFrame:
    w = Window.partitionBy(*keys, "_seg").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = lambda c: F.coalesce(F.col(c), F.lit(0)) if shifted else F.lit(0)
    return df.withColumns(
        {
            pos: (base("_o") + F.row_number().over(w) - 1).cast("long"),
            **{n: base(f"_o_{n}") + F.sum(c).over(upto) for n, c in sums.items()},
        }
    ).drop("_seg")


def with_ordinal(df: DataFrame, key: str | Sequence[str] = KEY, pos: str = POS, out: str = "ordinal") -> DataFrame:
    """Gapless ordinal by a number with gaps, however far apart its values lie (`ordered_scan`)."""
    return ordered_scan(df, key, [pos], pos=out)


def global_offsets(df: DataFrame, order: Sequence[str], size: str, out: str = "offset") -> DataFrame:
    """Exclusive running sum of ``size`` over the whole table in ``order``, without one big window.

    The table is range-partitioned and sorted once and checkpointed, so the partition of every
    row is settled; sums per partition are added up on the chunk table, never over rows.
    """
    ranged = cut(
        df.orderBy(*order).withColumn("_part", F.shiftright(F.monotonically_increasing_id(), 33))
    )
    parts = ranged.groupBy("_part").agg(F.sum(size).alias("_s"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = settle(parts.select("_part", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_base")))
    inner = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(base, "_part").withColumn(
        out, F.col("_base") + F.coalesce(F.sum(size).over(inner), F.lit(0))
    ).drop("_part", "_base")
