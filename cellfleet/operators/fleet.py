"""Fleet prediction, protocol tables and the comparison of arms."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellfleet.functions.forecast import NO_CROSSING, rul_readout, slope_rul, wiener_rul
from cellfleet.functions.space import CONTEXT, HORIZONS, STEP_DAYS, Space, apply_space, clip, dot
from cellfleet.operators import aggregates as A
from cellfleet.operators import conformal as C
from cellfleet.operators import contracts as V
from cellfleet.operators import learning as L
from cellfleet.operators import windows as W
from cellfleet.plans import scan, wide
from cellfleet.plans.scan import KEY
from cellfleet.plans.small import SMALL_ROWS, collect_bounded, cut, grid, settle

# Outcome of a request, as the service reports it.
OK, REFUSED, OPEN = "OK", "INPUT_REFUSED_BY_SCHEMA", "NO_CROSSING_WITHIN_112D"


def placed(requests: DataFrame, key: str = "battery_id") -> DataFrame:
    """Requests with ``_at``, their position by ``arrival``, whose values may have any gaps."""
    return scan.with_ordinal(requests, key, "arrival", "_at")


def request_faults(requests: DataFrame, key: str = "battery_id") -> DataFrame:
    """Per battery: how many rows break each rule, and its length; one aggregation and one scan.

    ``_at`` is the position of a row in the order of arrival (`placed`).
    """
    x, i = F.col("soh_observed"), F.col("reference_index").cast("double")
    bad = x.isNull() | F.isnan(x) | (x <= 0) | (x > V.SOH_MAX) | i.isNull() | (i != F.floor(i))
    cut = scan.halo(requests, back=1, key=key, pos="_at")
    prev = F.lag("reference_index").over(scan.series(key, "_at"))
    flags = cut.withColumn("_o", F.coalesce(F.col("reference_index") <= prev, F.lit(False))).where("home")
    return flags.groupBy(key).agg(
        F.count("*").alias("n_points"), F.count_if(bad).alias("n_bad_values"), F.count_if("_o").alias("n_order"),
        F.max("_at").alias("_last"),
    )


def predict_fleet(requests: DataFrame, heads: DataFrame, space: Space, quantiles: DataFrame | None = None,
                  protocol: str = "PROTOCOL_FIXED_HOLDOUT", arm: str = "FINAL_MODEL", level: float = 0.9,
                  with_rul: bool = True, key: str = "battery_id") -> tuple[DataFrame, DataFrame]:
    """Validate, cut the last 20 points, forecast all horizons; one row per battery.

    Returns predictions and refusals. Columns are checked before any job runs; rows of a
    battery that breaks a rule are refused, never repaired. ``heads`` are stored deployment heads.
    """
    V.refuse_columns(requests.drop("arrival"))
    V.check_columns(requests.drop("arrival"))
    table = {r["horizon"]: r for r in collect_bounded(heads, SMALL_ROWS, "heads")}
    widths = {}
    if quantiles is not None:
        hit = quantiles.where((F.col("protocol") == protocol) & (F.col("arm") == arm) & (F.col("coverage") == level))
        widths = {r["horizon"]: r["half_width"] for r in collect_bounded(hit, len(HORIZONS), "half-widths")}
        if set(HORIZONS) - set(widths):
            raise V.ContractError(f"no calibrated half-width for coverage {level}; none is interpolated")
    requests = cut(placed(requests, key))
    faults = request_faults(requests, key)
    good = (F.col("n_bad_values") == 0) & (F.col("n_order") == 0) & (F.col("n_points") >= CONTEXT)
    reason = (
        F.when(F.col("n_bad_values") > 0, "VALUE_RULE").when(F.col("n_order") > 0, "ORDER").otherwise("SHORT_HISTORY")
    )
    refusals = faults.where(~good).select(key, F.lit(REFUSED).alias("status"), reason.alias("reason"), "n_points",
                                          "n_bad_values", "n_order")
    # The last 20 arrivals are found per chunk, so a long history never meets in one task.
    chunks = scan.halo(requests, key=key, pos="_at", spread=False).drop("home")
    ends = chunks.groupBy(key, "chunk").agg(F.count("*").alias("_c")).join(faults.where(good), key)
    tail = chunks.join(ends.select(key, "chunk", "_last"), [key, "chunk"]).where(
        F.col("_at") > F.col("_last") - CONTEXT
    )
    last = tail.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_at", "soh_observed"))), lambda s: s.soh_observed).alias("ctx"),
        F.max_by("reference_index", "_at").alias("anchor_reference_index"),
    )
    z = space.columns()
    out = apply_space(W.features_of_ctx(last), space).withColumn("anchor_soh_observed", F.col("last"))
    cols = {}
    for h in HORIZONS:
        r, d = table[h], h * STEP_DAYS
        delta = F.lit(float(r["c_b"])) + dot(z, [r[f"c{i}"] for i in range(len(z))])
        cols[f"predicted_delta_soh_day{d}"] = delta
        cols[f"predicted_soh_day{d}"] = F.col("anchor_soh_observed") + delta
        cols[f"baseline_predicted_soh_day{d}"] = F.col("anchor_soh_observed") + F.col("slope_full") * h
        cols[f"alpha_day{d}"] = F.lit(float(r["alpha"]))
        if widths:
            cols[f"interval_half_width_day{d}"] = F.lit(float(widths[h]))
            cols[f"interval_lo_day{d}"] = F.col("anchor_soh_observed") + delta - widths[h]
            cols[f"interval_hi_day{d}"] = F.col("anchor_soh_observed") + delta + widths[h]
    cols["context_length"] = F.lit(CONTEXT)
    if widths:
        cols |= {"interval_coverage_nominal": F.lit(float(level)), "interval_is_per_horizon_marginal": F.lit(True)}
    keep = [key, "anchor_reference_index", "anchor_soh_observed"]
    out = out.withColumns(cols).select(*keep, *cols)
    status = F.lit(OK)
    if with_rul:
        out = rul_readout(out, nodes=[f"predicted_soh_day{h * STEP_DAYS}" for h in HORIZONS])
        status = F.when(F.col("rul_status") == NO_CROSSING, OPEN).otherwise(OK)
    return out.withColumn("status", status), refusals


# ---------------------------------------------------------------- protocol tables


def protocol_scores(df: DataFrame, heads: DataFrame, z: Sequence[str]) -> DataFrame:
    """Model and baseline predictions of every window, long by arm."""
    scored = L.attach_heads(df, heads, z)
    base = F.col("anchor_soh_observed") + F.col("slope_full") * F.col("horizon")
    arms = F.array(
        F.struct(F.lit("FINAL_MODEL").alias("arm"), F.col("pred_soh").alias("pred_soh")),
        F.struct(F.lit("STABILITY_BASELINE").alias("arm"), base.alias("pred_soh")),
    )
    keep = ["horizon", "family", KEY, "target_soh_true"]
    return scored.select(*keep, F.inline(arms)).withColumn("abs_err", F.abs(F.col("pred_soh") - F.col("target_soh_true")))


def fold_results(scores: DataFrame) -> DataFrame:
    """One row per (arm, horizon, held-out family)."""
    return A.macro_metrics(scores.withColumn("held", F.col("family")), "abs_err", ["arm", "horizon", "held"]).select(
        "arm", "horizon", "held", "n_rows", "n_trajectories", "mae", "trajectory_macro", "family_macro"
    )


def interval_cells(scores: DataFrame, quantiles: DataFrame, protocol: str = "PROTOCOL_NESTED_FAMILY_LOFO") -> DataFrame:
    """Coverage of stored half-widths per (coverage, horizon, held-out family), all levels at once."""
    table = settle(quantiles.where((F.col("protocol") == protocol) & (F.col("arm") == "FINAL_MODEL")).select(
        "coverage", "horizon", "half_width"))
    rows = scores.where(F.col("arm") == "FINAL_MODEL").withColumn("held", F.col("family")).join(table, "horizon")
    return C.coverage_report(rows, "target_soh_true", "pred_soh", "half_width", ["coverage", "horizon", "held"])


def matched_summary(folds: DataFrame) -> DataFrame:
    """Mean over the folds per arm: with one held-out family each, this is the family macro."""
    return folds.groupBy("arm").agg(
        F.avg("family_macro").alias("family_macro_mae"), F.avg("trajectory_macro").alias("trajectory_macro_mae"),
        F.max("family_macro").alias("worst_family_mae"), F.count("*").alias("n_cells"), F.sum("n_rows").alias("n_windows"),
    )


# ---------------------------------------------------------------- arms


def _arm_table(long: DataFrame, task: str) -> DataFrame:
    per = long.groupBy("arm", "horizon", "family").agg(F.avg("err").alias("mae"))
    return per.groupBy("arm", "horizon").agg(
        F.avg("mae").alias("family_macro"), F.max("mae").alias("worst_family"),
        F.stddev_pop("mae").alias("across_family_std"),
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(
            F.struct(F.col("family").cast("string").alias("k"), F.round("mae", 8).alias("v")))))).alias("per_family"),
    ).withColumn("task", F.lit(task))


def _arms(df: DataFrame, errs: dict) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("arm"), F.abs(e).alias("err")) for n, e in errs.items()])
    return df.select("horizon", "family", F.inline(pairs))


def soh_arms(df: DataFrame, ridge: DataFrame, l2sp: DataFrame, z: Sequence[str]) -> DataFrame:
    """Persistence, local trend, ridge and L2-SP under one protocol, scored in one pass."""
    y = F.col("y_delta")
    rows = L.attach_heads(df, ridge, z, out="p_ridge").drop("alpha", "lam")
    rows = L.attach_heads(rows, l2sp, z, out="p_l2sp")
    errs = {
        "persistence": y,
        "observable_local_trend": F.col("slope_full") * F.col("horizon") - y,
        "target_only_ridge": F.col("p_ridge") - y,
        "l2sp_transfer": F.col("p_l2sp") - y,
    }
    return _arm_table(_arms(rows, errs), "SOH_DELTA")


def train_means(anchors: DataFrame) -> DataFrame:
    """Mean uncensored label of all other families, per held-out family."""
    per = settle(anchors.where(F.col("censored") == 0).groupBy("family").agg(
        F.sum("rul_days").alias("_s"), F.count("*").alias("_n")))
    tot = per.agg(F.sum("_s").alias("_all_s"), F.sum("_n").alias("_all_n"))
    rest = F.col("_all_n") - F.col("_n")
    return settle(per.join(tot, F.lit(True)).where(rest > 0).select(
        "family", ((F.col("_all_s") - F.col("_s")) / rest).alias("train_mean")))


def rul_arms(anchors: DataFrame, fits: DataFrame, heads: DataFrame, z: Sequence[str]) -> DataFrame:
    """Constant mean, slope extrapolation, Wiener passage and censoring-aware ridge.

    ``fits`` carries the drift ``mu`` at each anchor (`windows.wiener_fit` on all points).
    """
    unc = anchors.where(F.col("censored") == 0)
    rows = L.rul_predict(unc, z, heads).join(train_means(anchors), "family")
    # Both sides are cut to (trajectory, index), a unique key, so a hot trajectory spreads.
    rows = rows.join(fits.select(KEY, scan.POS, "mu"), [KEY, scan.POS]).withColumn("horizon", F.lit(-1))
    y = F.col("rul_days")
    errs = {
        "constant_mean": F.col("train_mean") - y,
        "slope_extrapolation": slope_rul(F.col("last"), F.col("slope_full")) - y,
        "wiener_process": wiener_rul(F.col("mu"), F.col("last")) - y,
        "censoring_aware_ridge": F.col("pred_rul") - y,
    }
    return _arm_table(_arms(rows, errs), "MISSION_SPAN_RUL")


def rul_outer(anchors: DataFrame, heads: DataFrame, z: Sequence[str]) -> DataFrame:
    """Held-out remaining-life errors, the censored check and fit facts, per family."""
    scored = L.rul_predict(anchors, z, heads).join(train_means(anchors), "family")
    unc, cen = F.col("censored") == 0, F.col("censored") == 1
    e = F.when(unc, F.col("pred_rul") - F.col("rul_days"))
    slope = F.when(unc, slope_rul(F.col("last"), F.col("slope_full")) - F.col("rul_days"))
    const = F.when(unc, F.col("train_mean") - F.col("rul_days"))
    ok = F.when(cen, F.col("pred_rul") >= F.col("rul_lower_bound_days"))
    return scored.groupBy("family").agg(
        F.first("alpha").alias("alpha"), F.count(e).alias("n_anchors_uncensored"), F.count(ok).alias("n_anchors_censored"),
        F.avg(F.abs(e)).alias("mae_days"), F.sqrt(F.avg(e * e)).alias("rmse_days"),
        F.avg(F.abs(slope)).alias("mae_days_slope_extrapolation"), F.avg(F.abs(const)).alias("mae_days_constant_mean"),
        F.avg(ok.cast("double")).alias("censored_consistent_fraction"), F.count_if(~ok).alias("n_censored_violations"),
    )


def _fold_sums(df: DataFrame, names: Sequence[str], y: str, fams: list, lo: np.ndarray, hi: np.ndarray,
               middle: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted sums of products of (1, clipped features, target): of each family's rows that no fold clips, and of
    each fold's training rows that some fold clips; and the rows by family.

    Columns: family, features, target, weight. Features are given in units of ``spread`` from ``middle``.
    """
    k, n = len(names), len(fams)
    core_lo, core_hi = lo.max(axis=0), hi.min(axis=0)
    upper = np.triu_indices(k + 2)

    def products(x, t, w):
        v = np.column_stack([np.ones(len(x)), (x - middle) / spread, t])
        return (v * w[:, None]).T @ v

    def run(batches):
        core, edge, rows = np.zeros((n, k + 2, k + 2)), np.zeros((n, k + 2, k + 2)), np.zeros(n, np.int64)
        for g, v in wide.blocks(batches, fams, k + 2):
            use = (g >= 0) & ~np.isnan(v).any(axis=1)
            g, x, t, w = g[use], v[use, :k], v[use, k], v[use, k + 1]
            rows += np.bincount(g, minlength=n)
            inside = ((x >= core_lo) & (x <= core_hi)).all(axis=1)
            order = np.flatnonzero(inside)[np.argsort(g[inside], kind="stable")]
            for mine in np.split(order, np.searchsorted(g[order], np.arange(1, n))):
                if len(mine):
                    core[g[mine[0]]] += products(x[mine], t[mine], w[mine])
            g, x, t, w = g[~inside], x[~inside], t[~inside], w[~inside]
            for f in range(n):
                out = g != f
                edge[f] += products(np.clip(x[out], lo[f], hi[f]), t[out], w[out])
        for kind, sums in enumerate((core, edge)):
            for f in range(n):
                yield pa.RecordBatch.from_pydict({"kind": [kind], "f": [f], "n": [int(rows[f])], "sums": [sums[f][upper].tolist()]})

    src = df.select("family", *names, y, "weight")
    each = src.mapInArrow(run, "kind long, f long, n long, sums array<double>").select("kind", "f", "n", F.posexplode("sums"))
    got = collect_bounded(each.groupBy("kind", "f", "pos").agg(F.sum("col").alias("s"), F.sum("n").alias("n")), SMALL_ROWS, "fold sums")
    sums, rows = np.zeros((2, n, k + 2, k + 2)), np.zeros(n, np.int64)
    for r in got:
        i, j = upper[0][r["pos"]], upper[1][r["pos"]]
        sums[r["kind"], r["f"], i, j] = sums[r["kind"], r["f"], j, i] = r["s"]
        if r["kind"] == 0:
            rows[r["f"]] = r["n"]
    return sums[0], sums[1], rows


def own_space_arm(df: DataFrame, names: Sequence[str], alpha: float, h: int = 8) -> DataFrame:
    """Target-only heads on a space fitted on each fold's own training families: held, n_test_rows, mae_delta.

    Rows are read a fixed number of times and none is copied, whatever the number of families. Spaces come from
    histograms and clipped moments with one family left out at a time (`aggregates.fold_spaces`). Rows between the
    folds' bounds have one sum of products per family, which every other fold takes over; only rows outside some
    fold's bounds are clipped fold by fold, inside the task. Spaces are linear, so z sums follow from these.

    A row with a missing feature or target is neither trained on nor tested; its other features still count in
    the percentiles. Needs two families or more, of `wide.MAX_GROUPS` at most.
    """
    k = len(names)
    rows = cut(df.where(F.col("horizon") == h).select("horizon", "family", KEY, *names, "y_delta"))
    spaces = A.fold_spaces(rows, names, "family")
    fams = sorted(f for f in spaces if f is not None)
    kind = dict(df.dtypes)["family"]
    if len(fams) < 2 or any(v is None for f in fams for v in spaces[f].mean):
        return grid(df.sparkSession, [], f"held {kind}, n_test_rows long, mae_delta double")
    real = F.lit(True)
    for c in (*names, "y_delta"):
        x = F.col(c).cast("double")
        real = real & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    complete = cut(L.equal_weights(rows.where(real), ()))
    par = {c: np.array([getattr(spaces[f], c) for f in fams], float) for c in ("clip_lo", "clip_hi", "mean", "std")}
    middle, spread = (np.array(getattr(spaces[None], c), float) for c in ("mean", "std"))
    core, edge, counts = _fold_sums(complete, names, "y_delta", fams, par["clip_lo"], par["clip_hi"], middle, spread)
    heads = []
    for i, f in enumerate(fams):
        raw = core.sum(axis=0) - core[i] + edge[i]
        scale = spread / par["std"][i]
        t = np.eye(k + 2)
        t[range(1, k + 1), range(1, k + 1)] = scale
        t[1:k + 1, 0] = (middle - par["mean"][i]) / par["std"][i]
        m = t @ raw @ t.T
        z = slice(1, k + 1)
        sums = L.Moments(m[z, z], m[z, -1], m[z, 0], m[0, -1], m[-1, -1], m[0, 0], int(counts.sum() - counts[i]), 0)
        coef, b = L.fit_ridge(sums, alpha)
        heads.append((f, *[float(v[i][j]) for j in range(k) for v in par.values()], *map(float, coef), b))
    cols = [f"{c}_{j}" for j in range(k) for c in ("lo", "hi", "mean", "std")] + [f"c{j}" for j in range(k)] + ["c_b"]
    table = grid(df.sparkSession, heads, f"family {kind}, " + ", ".join(f"{c} double" for c in cols))
    pred = F.col("c_b")
    for j, n in enumerate(names):
        pred = pred + F.col(f"c{j}") * (clip(F.col(n), F.col(f"lo_{j}"), F.col(f"hi_{j}")) - F.col(f"mean_{j}")) / F.col(f"std_{j}")
    scored = complete.join(table, "family")
    return scored.groupBy(F.col("family").alias("held")).agg(
        F.count("*").alias("n_test_rows"), F.avg(F.abs(pred - F.col("y_delta"))).alias("mae_delta"))
