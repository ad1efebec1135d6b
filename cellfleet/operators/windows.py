"""Ordered operators over trajectories (see `plans.scan` for how they stay skew-safe).

Inputs carry ``trajectory_id`` and a gapless ``reference_index`` from 0 (`plans.scan.with_ordinal`
makes one where the index has gaps).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellfleet.functions.space import CONTEXT, EOL_SOH, FEATURES, clip
from cellfleet.plans import scan
from cellfleet.plans.scan import KEY, POS


def _done(df: DataFrame) -> DataFrame:
    return df.where("home").drop("home", "chunk")


def context_windows(df: DataFrame, n: int = CONTEXT, x: str = "soh_observed", key=KEY) -> DataFrame:
    """The last ``n`` points up to each anchor as ``ctx``; only full windows are kept."""
    cut = scan.halo(df, back=n - 1, key=key)
    out = cut.withColumn("ctx", F.collect_list(x).over(scan.frame(n - 1, key=key)))
    return _done(out.where(F.col(POS) >= n - 1))


def feature_columns(x: str, key=KEY) -> dict[str, Column]:
    """The 11 features as window expressions over one chunked series; needs 19 rows of halo."""
    w, v = scan.series(key), F.col(x)
    full, five = scan.frame(CONTEXT - 1, key=key), scan.frame(4, key=key)
    l1, l2, first = (F.lag(x, k).over(w) for k in (1, 2, CONTEXT - 1))
    pos = F.col(POS).cast("double")
    return {
        "last": v,
        "diff1": v - l1,
        "diff2": v - l2,
        "diff_long": v - first,
        "slope5": F.regr_slope(v, pos).over(five),
        "slope_full": F.regr_slope(v, pos).over(full),
        "curvature": v - 2 * l1 + l2,
        "ctx_mean": F.avg(v).over(full),
        "ctx_std": F.stddev_pop(v).over(full),
        "ctx_min": F.min(v).over(full),
        "ctx_max": F.max(v).over(full),
    }


def features11(df: DataFrame, x: str = "soh_observed", key=KEY, ahead: int = 0,
               extra: dict[str, Column] | None = None) -> DataFrame:
    """The 11 context features at every anchor with a full context, in one exchange and sort.

    ``extra`` are further window expressions on the same spec, reaching at most ``ahead`` rows on.
    """
    cut = scan.halo(df, back=CONTEXT - 1, ahead=ahead, key=key)
    out = cut.withColumns({**feature_columns(x, key), **(extra or {})})
    return _done(out.where(F.col(POS) >= CONTEXT - 1))


def with_target(df: DataFrame, horizons: Sequence[int] = (8,), x: str = "soh_observed",
                y: str = "soh_true", key=KEY, day: str = "reference_day") -> DataFrame:
    """Features plus the label h steps ahead, one row per (anchor, horizon) that has a target.

    All horizons share one window pass; rows are multiplied only after it.
    """
    w = scan.series(key)
    leads = {f"_y{h}": F.lead(y, h).over(w) for h in horizons}
    days = {f"_d{h}": F.lead(day, h).over(w) for h in horizons}
    wide = features11(df, x, key, ahead=max(horizons), extra={**leads, **days})
    picks = F.array(
        *[
            F.struct(F.lit(h).alias("horizon"), F.col(f"_d{h}").alias("target_day"),
                     F.col(f"_y{h}").alias("target_soh_true"))
            for h in horizons
        ]
    )
    return (
        wide.withColumn("_t", F.explode(picks))
        .select(*[c for c in wide.columns if not c.startswith(("_y", "_d"))], "_t.*")
        .where(F.col("target_soh_true").isNotNull())
        .withColumns(
            {
                "anchor_soh_observed": F.col(x),
                "y_delta": F.col("target_soh_true") - F.col(x),
            }
        )
    )


def source_windows(cycles: DataFrame, h: int = 8) -> DataFrame:
    """Features and labels from discharge cycles: SOH is capacity over the cell's first capacity.

    ``cycles`` has cell_id, a gapless cycle_idx and capacity. Cells with fewer than 21 + h cycles
    give no rows; `contracts.split_short_groups` reports them.
    """
    first = F.min_by("capacity", POS)
    src = cycles.select(F.col("cell_id").alias(KEY), F.col("cycle_idx").alias(POS), "capacity")
    cut = scan.halo(src).drop("home")
    ctx = scan.attach(
        cut,
        total={"_first": (first, lambda n: F.min_by(n, "chunk")), "n_cycles": (F.count("*"), F.sum)},
    )
    soh = (
        ctx.where(F.col("n_cycles") >= CONTEXT + 1 + h)
        .withColumn("soh", F.col("capacity") / F.col("_first"))
        .select(KEY, POS, "soh")
    )
    nxt = F.lead("soh", h).over(scan.series())
    out = features11(soh, "soh", ahead=h, extra={"_next": nxt}).where(F.col("_next").isNotNull())
    return out.withColumn("y_delta", F.col("_next") - F.col("soh")).drop("_next").withColumnsRenamed(
        {KEY: "cell_id", POS: "cycle_idx"}
    )


def rul_anchors(df: DataFrame, eol: float = EOL_SOH, key=KEY) -> DataFrame:
    """Remaining-life anchors: features, days to end of life, follow-up bound, censoring flag.

    Anchors at or after end of life are dropped; trajectories that never reach it are kept with
    a NULL label and their follow-up as a lower bound.
    """
    keys = [key] if isinstance(key, str) else list(key)
    totals = {
        "_points": (F.count_if("home"), F.sum),
        "eol_day": (F.min(F.when(F.col("soh_true") <= eol, F.col("reference_day"))), F.min),
        "last_day": (F.max("reference_day"), F.max),
    }
    # Copies at chunk borders repeat days of the same series, which changes neither extreme.
    cut = scan.halo(df, back=CONTEXT - 1, key=keys)
    ctx = scan.attach(cut, total=totals, key=keys)
    out = ctx.withColumns(feature_columns("soh_observed", keys)).where(F.col(POS) >= CONTEXT - 1)
    out = out.where(F.col("eol_day").isNull() | (F.col("reference_day") < F.col("eol_day")))
    return _done(out).withColumns(
        {
            "rul_days": F.col("eol_day") - F.col("reference_day"),
            "rul_lower_bound_days": F.col("last_day") - F.col("reference_day"),
            "censored": F.col("eol_day").isNull().cast("int"),
            # A censored trajectory keeps every anchor; its weights need their number.
            "n_censored_rows": F.col("_points") - (CONTEXT - 1),
        }
    ).drop("_points")


def with_lag(df: DataFrame, cols: Sequence[str], key=KEY) -> DataFrame:
    """Difference to the previous row; the first row differs from 0 (``d_``) or is NULL (``diff_``)."""
    cut = scan.halo(df, back=1, key=key)
    w = scan.series(key)
    out = {}
    for c in cols:
        prev = F.lag(c).over(w)
        out[f"d_{c}"] = F.col(c) - F.coalesce(prev, F.lit(0.0))
        out[f"diff_{c}"] = F.col(c) - prev
    return _done(cut.withColumns(out))


def running_sum(df: DataFrame, col: str, out: str | None = None, key=KEY) -> DataFrame:
    cut = scan.halo(df, key=key).drop("home")
    return scan.running_sums(cut, {out or f"sum_{col}": col}, key=key).drop("chunk")


def first_last(df: DataFrame, cols: Sequence[str], key=KEY) -> DataFrame:
    """First and last value per trajectory, by mergeable aggregates."""
    keys = [key] if isinstance(key, str) else list(key)
    aggs = [f(c, POS).alias(f"{p}_{c}") for c in cols for p, f in (("first", F.min_by), ("last", F.max_by))]
    return df.groupBy(*keys).agg(*aggs)


def steps(df: DataFrame, x: str = "soh_true", key=KEY) -> DataFrame:
    """Step to the previous point as ``step``; NULL at the first one."""
    return with_lag(df.select(*([key] if isinstance(key, str) else key), POS, x), [x], key).withColumnsRenamed(
        {f"diff_{x}": "step"}
    )


def monotonicity(df: DataFrame, x: str = "soh_true") -> DataFrame:
    """Rises above 1e-12, and the mean share of steps that do not rise by more than 1e-6."""
    per = steps(df, x).where(F.col("step").isNotNull()).groupBy(KEY).agg(
        F.count_if(F.col("step") > 1e-12).alias("rises"),
        F.avg((F.col("step") <= 1e-6).cast("double")).alias("share"),
    )
    return per.agg(F.sum("rises").alias("rises"), F.avg("share").alias("non_increasing_share"))


def half_rates(df: DataFrame, x: str = "soh_true") -> DataFrame:
    """Mean step in the first and in the second half; the step across the middle is in neither."""
    cut = scan.halo(df.select(KEY, POS, x), back=1)
    ctx = scan.attach(cut, total={"n": (F.count_if("home"), F.sum)})
    mid = F.expr("n div 2")
    step = F.col(x) - F.lag(x).over(scan.series())
    out = ctx.withColumn("step", step).where("home").withColumn("mid", mid)
    return (
        out.groupBy(KEY)
        .agg(
            F.avg(F.when(F.col(POS).between(1, F.col("mid") - 1), F.col("step"))).alias("early"),
            F.avg(F.when(F.col(POS) > F.col("mid"), F.col("step"))).alias("late"),
        )
        .na.fill(0.0, ["early", "late"])
    )


def pack_ctx(df: DataFrame, prefix: str = "ctx_soh_") -> DataFrame:
    """Wide context columns, in numeric suffix order, to one array."""
    wide = sorted((c for c in df.columns if c.startswith(prefix)), key=lambda c: int(c.rsplit("_", 1)[1]))
    return df.withColumn("ctx", F.array(*wide)).drop(*wide)


def unpack_ctx(df: DataFrame, n: int = CONTEXT, prefix: str = "ctx_soh_") -> DataFrame:
    return df.withColumns({f"{prefix}{i:02d}": F.col("ctx")[i] for i in range(n)}).drop("ctx")


def features_of_ctx(df: DataFrame) -> DataFrame:
    """The 11 features of a stored context array, by plain arithmetic in generated code."""
    h = [F.col("ctx")[i] for i in range(CONTEXT)]

    def mean(v):
        return sum(v[1:], v[0]) / len(v)

    def slope(v):
        mid = (len(v) - 1) / 2.0
        den = sum((i - mid) ** 2 for i in range(len(v)))
        return sum((x * (i - mid) for i, x in enumerate(v[1:], 1)), v[0] * (-mid)) / den

    m = mean(h)
    return df.withColumns(
        {
            "last": h[-1], "diff1": h[-1] - h[-2], "diff2": h[-1] - h[-3], "diff_long": h[-1] - h[0],
            "slope5": slope(h[-5:]), "slope_full": slope(h), "curvature": h[-1] - 2 * h[-2] + h[-3],
            "ctx_mean": m, "ctx_std": F.sqrt(mean([(x - m) * (x - m) for x in h])),
            "ctx_min": F.array_min("ctx"), "ctx_max": F.array_max("ctx"),
        }
    )


def stride(df: DataFrame, k: int = 10, group: str = "family", key: str = KEY) -> DataFrame:
    """Every k-th row of each group in (trajectory, index) order.

    The rank of a row is the offset of its trajectory in the group plus its own rank; offsets
    are scanned on the trajectory table, so no task ever holds a whole group.
    """
    rank = scan.with_ordinal(df, key)
    counts = df.groupBy(group, key).agg(F.count("*").alias("_n"))
    offs = scan.global_offsets(counts, [group, key], "_n", "_o")
    start = offs.groupBy(group).agg(F.min("_o").alias("_g"))
    placed = offs.join(start, group).select(group, key, (F.col("_o") - F.col("_g")).alias("_start"))
    # A trajectory table can be large: joined without a hint, on chunks so that a hot one is split.
    cut = rank.withColumn("chunk", F.expr(f"ordinal div {scan.CHUNK}"))
    pieces = placed.join(cut.groupBy(group, key, "chunk").agg(F.count("*").alias("_c")), [group, key])
    out = cut.join(pieces.select(group, key, "chunk", "_start"), [group, key, "chunk"])
    return out.where((F.col("_start") + F.col("ordinal")) % k == 0).drop("_start", "ordinal", "chunk")


def budget_members(df: DataFrame, n: int, group: str = "family", key: str = KEY) -> DataFrame:
    """The first ``n`` trajectories of each group by id.

    The rank filter lets Spark keep only ``n`` per group in every task before the shuffle.
    """
    ids = df.select(group, key).distinct()
    rank = F.row_number().over(Window.partitionBy(group).orderBy(key))
    return ids.withColumn("budget_rank", rank).where(F.col("budget_rank") <= n)


def budget_shares(df: DataFrame, group: str = "family", key: str = KEY) -> DataFrame:
    """Every trajectory with its rank by id in its group and the group's number of trajectories."""
    ids = df.select(group, key).distinct()
    count = ids.groupBy(group).agg(F.count("*").alias("n_trajectories"))
    return ids.withColumn("budget_rank", F.row_number().over(Window.partitionBy(group).orderBy(key))).join(count, group)


def budget_subset(df: DataFrame, n: int, group: str = "family", key: str = KEY) -> DataFrame:
    return df.join(budget_members(df, n, group, key), [group, key], "left_semi")


def prefix_stats(df: DataFrame, x: str = "soh_observed", key=KEY) -> DataFrame:
    """Statistics of all points up to and including each anchor."""
    v = F.col(x)
    cut = scan.halo(df, key=key).drop("home")
    ctx = scan.attach(
        cut,
        before={"_n0": (F.count("*"), F.sum), "_s0": (F.sum(v), F.sum), "_lo0": (F.min(v), F.min), "_hi0": (F.max(v), F.max)},
        key=key,
    )
    w = scan.running(key)
    n = F.coalesce(F.col("_n0"), F.lit(0)) + F.count("*").over(w)
    return ctx.withColumns(
        {
            "prefix_n": n,
            "prefix_mean": (F.coalesce(F.col("_s0"), F.lit(0.0)) + F.sum(v).over(w)) / n,
            "prefix_min": F.least("_lo0", F.min(v).over(w)),
            "prefix_max": F.greatest("_hi0", F.max(v).over(w)),
        }
    ).drop("_n0", "_s0", "_lo0", "_hi0", "chunk")


def wiener_fit(df: DataFrame, x: str = "soh_observed", day: str = "reference_day", key=KEY) -> DataFrame:
    """Drift and diffusion at each anchor from all steps so far; fewer than two steps give (0, 1e-9).

    One pass of running sums of ds, dt and ds^2/dt replaces a refit per anchor.
    """
    cut = scan.halo(df, back=1, key=key)
    w = scan.series(key)
    dt, ds = F.col(day) - F.lag(day).over(w), F.col(x) - F.lag(x).over(w)
    step = cut.withColumns({"_dt": dt, "_ds": ds}).where("home").drop("home")
    ok = F.col("_dt") > 0
    zero = F.lit(0.0)
    sums = {
        "_n": F.when(ok, F.lit(1.0)).otherwise(zero),
        "_sdt": F.when(ok, F.col("_dt")).otherwise(zero),
        "_sds": F.when(ok, F.col("_ds")).otherwise(zero),
        "_sq": F.when(ok, F.col("_ds") * F.col("_ds") / F.when(ok, F.col("_dt"))).otherwise(zero),
    }
    out = scan.running_sums(step, sums, key=key)
    enough = F.col("_n") >= 2
    mu = F.when(enough, -F.col("_sds") / F.when(enough, F.col("_sdt"))).otherwise(zero)
    out = out.withColumn("mu", mu)
    var = (F.col("_sq") + 2 * F.col("mu") * F.col("_sds") + F.col("mu") * F.col("mu") * F.col("_sdt")) / F.when(
        enough, F.col("_n")
    )
    sigma = F.when(enough, F.sqrt(F.greatest(var, F.lit(1e-18)))).otherwise(F.lit(1e-9))
    return out.withColumns({"sigma": sigma, "n_steps": F.col("_n").cast("long")}).drop(
        "_dt", "_ds", "_n", "_sdt", "_sds", "_sq", "chunk"
    )


# How strongly each fault signature speeds up decline.
RINT_GAIN = 0.9
TEMP_GAIN = 0.05
DOD_GAIN = 0.15
# The four fault classes (onset share, resistance, capacity, temperature, DoD).
FAULTS = (
    ("rint_step", 0.45, 1.6, 1.0, 0.0, 0.0),
    ("capacity_jump", 0.55, 1.0, 0.96, 0.0, 0.0),
    ("thermal_bias", 0.35, 1.0, 1.0, 6.0, 0.0),
    ("deep_discharge", 0.50, 1.0, 1.0, 0.0, 0.85),
)
FAULT_SCHEMA = (
    "fault_type string, onset_fraction double, rint_mult double, q_factor double, "
    "temp_bias double, dod_depth double"
)


def perturb(df: DataFrame, channels: Sequence[str] = ("soh_true", "soh_observed"), key=KEY) -> DataFrame:
    """Fault signature on rows that carry the columns of one fault each.

    Falls after the onset are amplified and re-accumulated, then the level is scaled from the
    onset on and clipped to [0, 1.2]. Adds ``<channel>_faulted``, ``onset_index`` and the markers.
    """
    cut = scan.halo(df, back=1, key=key)
    ctx = scan.attach(cut, total={"n_points": (F.count_if("home"), F.sum)}, key=key)
    n = F.col("n_points")
    k = F.least(F.greatest(F.bround(F.col("onset_fraction") * (n - 1)).cast("long"), F.lit(1)), n - 2)
    accel = (
        1 + RINT_GAIN * F.greatest(F.col("rint_mult") - 1, F.lit(0.0))
        + TEMP_GAIN * F.greatest(F.col("temp_bias"), F.lit(0.0))
        + DOD_GAIN * F.greatest(F.col("dod_depth"), F.lit(0.0))
    )
    ctx = ctx.withColumn("onset_index", k)
    w = scan.series(key)
    after, pos = F.col(POS) > F.col("onset_index"), F.col(POS)
    moved = {}
    for c in channels:
        d = F.col(c) - F.lag(c).over(w)
        moved[f"_m_{c}"] = F.when(after & (d < 0), d * accel).when(after, d)
        moved[f"_a_{c}"] = F.when(pos == F.col("onset_index"), F.col(c))
    stepped = ctx.withColumns(moved).where("home").drop("home")
    # The level from the onset on is the onset level plus the running sum of the changed steps.
    sums = {f"_r_{c}": F.coalesce(F.col(f"_a_{c}"), F.col(f"_m_{c}"), F.lit(0.0)) for c in channels}
    out = scan.running_sums(stepped, sums, key=key)
    on = pos >= F.col("onset_index")
    final = {
        f"{c}_faulted": clip(
            F.when(on, F.col(f"_r_{c}") * F.col("q_factor")).otherwise(F.col(c)), 0.0, 1.2
        )
        for c in channels
    }
    marks = {
        "post_onset": on.cast("int"),
        "rint_multiplier": F.when(on, F.col("rint_mult")).otherwise(F.lit(1.0)),
        "temperature_bias_c": F.when(on, F.col("temp_bias")).otherwise(F.lit(0.0)),
        "dod_event": F.when(pos == F.col("onset_index"), F.col("dod_depth")).otherwise(F.lit(0.0)),
        "q_factor_series": F.when(on, F.col("q_factor")).otherwise(F.lit(1.0)),
    }
    drop = [f"{p}_{c}" for p in ("_m", "_a", "_r") for c in channels]
    return out.withColumns({**final, **marks}).drop(*drop, "chunk")
