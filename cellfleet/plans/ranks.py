"""Exact order statistics of large groups by repeated histograms.

Spark's exact ``percentile`` keeps every distinct value of a group in one task, and a row number
over a group sorts it in one task. Neither survives a group with a third of all rows. Here
each pass is a map-side-combined histogram over the interval that still holds the wanted rank,
until the rows left in it are few; the result is exact for every distribution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellfleet.plans.small import cut, each_case, settle

BINS, MAX_PASSES = 4096, 200
# Rows of one interval that one task may sort.
SORT_ROWS = 20_000


def _stats(src: DataFrame, keys: list[str]) -> DataFrame:
    return settle(
        src.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_in"))
    )


def _values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The two or three columns the passes need, computed once: the input may hold a big shuffle.

    Only finite values have ranks; NULL, NaN and infinity are left out.
    """
    x = F.col(value).cast("double")
    return cut(df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select(*keys, F.col(value).cast("double").alias("_v")))


def pick_ranks(df: DataFrame, keys: Sequence[str], value: str, rank, sort_rows: int | None = None) -> DataFrame:
    """The values at 1-based ranks per group: ``keys``, ``n``, ``rank``, ``value``.

    ``rank`` maps the group size (a column) to an array of ranks. NULL values are left out.
    """
    keys = list(keys)
    if not keys:
        return pick_ranks(df.withColumn("_all", F.lit(0)), ["_all"], value, rank, sort_rows).drop("_all")
    src = _values(df, keys, value)
    stats = _stats(src, keys)
    want = stats.withColumn("rank", F.explode(F.array_distinct(rank(F.col("_in")))))
    got = _search(src, keys, want.select(*keys, "rank", F.col("rank").alias("_r"), "_lo", "_hi", "_in"), sort_rows or SORT_ROWS)
    return got.join(stats.select(*keys, F.col("_in").alias("n")), keys)


def _inside(src: DataFrame, keys: list[str], open_: DataFrame) -> DataFrame:
    """Rows in the open intervals of their group. Equal intervals of several ranks count once."""
    spans = settle(open_.select(*keys, "_lo", "_hi").distinct())
    return src.join(spans, keys).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))


def _hit(counts: DataFrame, keys: list[str], order: str, open_: DataFrame) -> DataFrame:
    """The row of ``counts`` (interval, ``order``, ``_c``) that holds each wanted rank."""
    w = Window.partitionBy(*keys, "_lo", "_hi").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.withColumn("_cum", F.sum("_c").over(w))
    want = open_.select(*keys, "rank", "_r", "_lo", "_hi")
    return summed.join(want, [*keys, "_lo", "_hi"]).where(
        (F.col("_cum") >= F.col("_r")) & (F.col("_cum") - F.col("_c") < F.col("_r"))
    )


def _search(src: DataFrame, keys: list[str], open_: DataFrame, sort_rows: int) -> DataFrame:
    open_ = settle(open_)
    # A pass narrows an interval at least 4096-fold or to equal values, so a double's range ends sooner.
    for _ in range(MAX_PASSES):
        wide = (F.col("_in") > sort_rows) & (F.col("_lo") < F.col("_hi"))
        big = open_.where(wide)
        if big.isEmpty():
            break
        # Halves keep the width of any two doubles finite; a width that underflows leaves one slot.
        width = F.col("_hi") / BINS - F.col("_lo") / BINS
        share = F.when(width > 0, F.col("_v") / width - F.col("_lo") / width).otherwise(F.lit(0.0))
        slot = F.greatest(F.least(F.floor(share), F.lit(BINS - 1)), F.lit(0))
        hist = _inside(src, keys, big).groupBy(*keys, "_lo", "_hi", slot.alias("_b")).agg(
            F.count("*").alias("_c"), F.min("_v").alias("_l"), F.max("_v").alias("_h")
        )
        narrowed = _hit(hist, keys, "_b", big).select(
            *keys, "rank", (F.col("_r") - F.col("_cum") + F.col("_c")).alias("_r"),
            F.col("_l").alias("_lo"), F.col("_h").alias("_hi"), F.col("_c").alias("_in"),
        )
        open_ = settle(open_.where(~wide).unionByName(narrowed))
    else:
        raise RuntimeError("a histogram interval does not shrink")
    flat = open_.where(F.col("_lo") == F.col("_hi")).select(*keys, "rank", F.col("_lo").alias("value"))
    todo = open_.where(F.col("_lo") < F.col("_hi"))
    # Equal values collapse in the map-side combine, so ties never reach one task as rows.
    left = _inside(src, keys, todo).groupBy(*keys, "_lo", "_hi", "_v").agg(F.count("*").alias("_c"))
    return flat.unionByName(_hit(left, keys, "_v", todo).select(*keys, "rank", F.col("_v").alias("value")))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float]) -> DataFrame:
    """Exact percentiles with linear interpolation: ``keys``, ``n``, ``fraction``, ``value``."""
    keys = list(keys)
    if not keys:
        return percentiles(df.withColumn("_all", F.lit(0)), ["_all"], value, fractions).drop("_all")

    def near(n):
        spots = [(n - 1) * F.lit(float(q)) for q in fractions]
        return F.array(*[f(x) + 1 for x in spots for f in (F.floor, F.ceil)])

    got = settle(pick_ranks(df, keys, value, near))
    spot = each_case(
        got.select(*keys, "n").distinct(), [(float(q),) for q in fractions], "fraction double"
    ).withColumn("_x", (F.col("n") - 1) * F.col("fraction"))
    spot = spot.withColumns({"_f": F.floor("_x") + 1, "_g": F.ceil("_x") + 1})
    lo = got.select(*keys, F.col("rank").alias("_f"), F.col("value").alias("_a"))
    hi = got.select(*keys, F.col("rank").alias("_g"), F.col("value").alias("_b"))
    step = F.col("_x") - F.floor("_x")
    return spot.join(lo, [*keys, "_f"]).join(hi, [*keys, "_g"]).select(
        *keys, "n", "fraction", (F.col("_a") + (F.col("_b") - F.col("_a")) * step).alias("value")
    )


def percentile_columns(df: DataFrame, keys: Sequence[str], value: str, named: dict[str, float]) -> DataFrame:
    """`percentiles` with one column per fraction."""
    long = percentiles(df, keys, value, sorted(set(named.values())))
    picks = [F.max(F.when(F.col("fraction") == q, F.col("value"))).alias(n) for n, q in named.items()]
    return settle(long.groupBy(*keys).agg(*picks))


def percentile_table(df: DataFrame, named: dict[str, tuple[str, float]]) -> DataFrame:
    """Percentiles of several columns as one row, from one search: name -> (column, fraction)."""
    cols = sorted({c for c, _ in named.values()})
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in cols], "measure", "x")
    got = percentiles(long, ["measure"], "x", sorted({q for _, q in named.values()}))
    picks = [
        F.max(F.when((F.col("measure") == c) & (F.col("fraction") == q), F.col("value"))).alias(n)
        for n, (c, q) in named.items()
    ]
    return settle(got.agg(*picks))
