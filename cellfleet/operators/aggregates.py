"""Aggregations, error metrics and report tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellfleet.functions.space import EOL_SOH, FEATURES, Space
from cellfleet.operators import windows as W
from cellfleet.plans import ranks, scan, wide
from cellfleet.plans.scan import KEY, POS
from cellfleet.plans.small import beside, cut, each_case, grid, settle

# Percentiles of the clip bounds.
CLIP_SHARES = (0.01, 0.99)


def envelope_columns() -> dict[str, Column]:
    """The telemetry envelope; every aggregate is mergeable, so it serves batch and stream."""
    c = F.col
    return {
        "n_samples": F.count("*"),
        "mean_temp_c": F.avg("temperature_c"),
        "max_temp_c": F.max("temperature_c"),
        "min_voltage_v": F.min("voltage_v"),
        "max_voltage_v": F.max("voltage_v"),
        "max_abs_current_a": F.max(F.abs(c("current_a"))),
        "max_dod": F.max("dod_orbit"),
        "mean_dod": F.avg("dod_orbit"),
        "final_efc": F.max("efc"),
        "final_ah_throughput": F.max("ah_throughput"),
        "final_wh_throughput": F.max("wh_throughput"),
        "min_soh_true": F.min("soh_true"),
        "max_rint_ohm": F.max("rint_ohm_true"),
    }


def telemetry_envelope(df: DataFrame, keys: Sequence[str] = ("scenario_id", "family")) -> DataFrame:
    """One row per scenario, by partial and final hash aggregation."""
    return df.groupBy(*keys).agg(*[e.alias(n) for n, e in envelope_columns().items()])


def channel_ranges(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fleet minimum and maximum per channel, in one pass."""
    wide = df.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    pairs = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"lo_{c}").alias("min_value"),
                               F.col(f"hi_{c}").alias("max_value")) for c in cols])
    return wide.select(F.inline(pairs))


def layer_agreement(l1: DataFrame, l2: DataFrame) -> DataFrame:
    """Family means of the telemetry envelope against the first two reference points."""
    a = l1.groupBy("family").agg(
        F.avg("mean_temp_c").alias("mean_temp_c_l1"), F.max("max_temp_c").alias("max_temp_c_l1"),
        F.avg("mean_dod").alias("mean_dod_l1"),
    )
    b = l2.where(F.col(POS) <= 1).groupBy("family").agg(
        F.avg("mean_temp_c").alias("mean_temp_c_l2"), F.max("max_temp_c").alias("max_temp_c_l2"),
        F.avg("dod").alias("mean_dod_l2"),
    )
    return a.join(b, "family", "left").withColumns(
        {
            "temp_mean_abs_diff": F.abs(F.col("mean_temp_c_l1") - F.col("mean_temp_c_l2")),
            "dod_mean_abs_diff": F.abs(F.col("mean_dod_l1") - F.col("mean_dod_l2")),
        }
    )


def timescale(l1: DataFrame, l2: DataFrame, seconds: str = "scenario_epoch_s", orbit: str = "orbit_no",
              drift: str = "soh_true") -> DataFrame:
    """Drift inside one telemetry template against the mean step of the reference grid."""
    tpl = l1.agg(
        ((F.max(seconds) - F.min(seconds)) / 3600).alias("template_hours"),
        F.count_distinct(orbit).alias("template_orbits"),
        (F.max("efc") - F.min("efc")).alias("template_efc_span"),
        F.avg(F.when(F.col("dod_orbit") > 0, F.col("dod_orbit"))).alias("template_dod_mean"),
        (F.max("temperature_c") - F.min("temperature_c")).alias("template_temp_span_c"),
        (F.max(drift) - F.min(drift)).alias("template_soh_drift"),
    )
    step = W.with_lag(l2.select(KEY, POS, "soh_true", "reference_day"), ["soh_true", "reference_day"])
    # One window pass gives the mean and the range of both; on an even grid the median is known from it.
    both = wide.Folds(cut(step.select(F.abs("diff_soh_true").alias("_s"), F.col("diff_reference_day").alias("_d"))), ["_s", "_d"])
    seen = both.n.sum(axis=0) if len(both.n) else (0, 0)
    mean_abs = float(both.shift[0]) if seen[0] else None
    days = float(both.percentiles((0.5,), ["_d"])[None][1, 0]) if seen[1] else None
    return (
        tpl.withColumns({"soh_step_mean_abs": F.lit(mean_abs).cast("double"), "step_days": F.lit(days).cast("double")})
        .withColumn("separation_ratio",
                    F.col("soh_step_mean_abs") / F.greatest(F.col("template_soh_drift"), F.lit(1e-9)))
        .withColumn("separated", F.col("soh_step_mean_abs") > F.col("template_soh_drift"))
    )


def summarise(df: DataFrame) -> DataFrame:
    """Rows, trajectories and families, in total and per horizon."""
    out = df.groupingSets([[], ["horizon"]], "horizon").agg(
        F.grouping("horizon").alias("all_horizons"),
        F.count("*").alias("n_rows"),
        F.count_distinct(KEY).alias("n_trajectories"),
        F.count_distinct("family").alias("n_families"),
    )
    return out.withColumn("horizon", F.coalesce("horizon", F.lit(0)))


def rul_summary(anchors: DataFrame) -> DataFrame:
    """Label statistics of the uncensored anchors, and counts of both kinds."""
    unc = F.col("censored") == 0
    y = F.when(unc, F.col("rul_days"))
    return anchors.agg(
        F.count("*").alias("anchors_total"),
        F.count_if(unc).alias("anchors_uncensored"),
        F.count_if(~unc).alias("anchors_censored"),
        F.count_distinct(KEY).alias("trajectories_total"),
        F.count_distinct(F.when(unc, F.col(KEY))).alias("trajectories_uncensored"),
        F.count_distinct(F.when(~unc, F.col(KEY))).alias("trajectories_censored"),
        F.avg(y).alias("rul_mean_days"),
        F.stddev_pop(y).alias("rul_std_days"),
        F.min(y).alias("rul_min_days"),
        F.max(y).alias("rul_max_days"),
    ).withColumn("degeneracy", F.when(F.col("rul_std_days") > 1, "NON-DEGENERATE").otherwise("DEGENERATE"))


def _error_aggs(truth: Column, pred: Column) -> list[Column]:
    e = pred - truth
    sst = F.var_pop(truth) * F.count(truth)
    return [
        F.count("*").alias("n_rows"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.max(F.abs(e)).alias("max_abs_error"),
        F.when(sst > 0, 1 - F.sum(e * e) / F.when(sst > 0, sst)).otherwise(F.lit(1.0)).alias("r2"),
    ]


def error_metrics(df: DataFrame, truth: str, pred: str, sets: Sequence[Sequence[str]] = ((),)) -> DataFrame:
    """MAE, RMSE, largest error and R2 for every grouping set, in one pass."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    aggs = _error_aggs(F.col(truth), F.col(pred))
    if not cols:
        return df.agg(*aggs)
    return df.groupingSets([list(s) for s in sets], *cols).agg(*aggs)


def macro_metrics(df: DataFrame, err: str, keys: Sequence[str] = ()) -> DataFrame:
    """Means over trajectories and over families, so that size does not weigh.

    Two aggregation levels, each map-side combined; the family level is exact because sums and
    counts are carried along.
    """
    k = list(keys)
    per = df.groupBy(*k, "family", KEY).agg(F.avg(err).alias("_t"), F.sum(err).alias("_s"), F.count(err).alias("_n"))
    fam = per.groupBy(*k, "family").agg(
        (F.sum("_s") / F.when(F.sum("_n") > 0, F.sum("_n"))).alias("_f"),
        F.sum("_t").alias("_ts"), F.count("_t").alias("_tn"), F.sum("_s").alias("_s"), F.sum("_n").alias("_n"),
    )
    return fam.groupBy(*k).agg(
        F.sum("_n").alias("n_rows"),
        F.sum("_tn").alias("n_trajectories"),
        F.count("_f").alias("n_families"),
        (F.sum("_s") / F.sum("_n")).alias("mae"),
        (F.sum("_ts") / F.sum("_tn")).alias("trajectory_macro"),
        F.avg("_f").alias("family_macro"),
        F.max("_f").alias("worst_family_mae"),
        F.max_by("family", "_f").alias("worst_family"),
        F.stddev_pop("_f").alias("across_family_std"),
    )


def worst(df: DataFrame, key: str, measure: str, keys: Sequence[str] = (), largest: bool = True) -> DataFrame:
    """The member with the largest (or smallest) measure."""
    by, ext = (F.max_by, F.max) if largest else (F.min_by, F.min)
    return df.groupBy(*keys).agg(by(key, measure).alias("worst"), ext(measure).alias("worst_value"))


def rank_arms(results: DataFrame) -> DataFrame:
    """Arms of each task best first, with the top margin against the mean family spread.

    ``results`` has one row per (task, arm, horizon), so the ranking windows are tiny.
    """
    per = results.groupBy("task", "arm").agg(
        F.avg("family_macro").alias("family_macro"), F.avg("across_family_std").alias("_std")
    )
    w = Window.partitionBy("task").orderBy("family_macro", "arm")
    whole = Window.partitionBy("task")
    gap = F.lead("family_macro").over(w) - F.col("family_macro")
    ranked = per.withColumns(
        {
            "arm_rank": F.row_number().over(w).cast("long"),
            "gap_to_next": gap,
            "mean_across_family_std": F.avg("_std").over(whole),
        }
    )
    top = F.first("gap_to_next").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranked.withColumn("separable", F.coalesce(top > F.col("mean_across_family_std"), F.lit(False))).drop("_std")


def selection_counts(selected: DataFrame, col: str) -> DataFrame:
    """How often each grid value won, and its share."""
    per = selected.groupBy(col).agg(F.count("*").alias("n_cells"))
    return per.withColumn("share", F.col("n_cells") / F.sum("n_cells").over(Window.partitionBy()))


def fold_spaces(df: DataFrame, names: Sequence[str] = FEATURES, key: str | None = None, approximate: bool = False) -> dict:
    """Clip bounds at the 1 % and 99 % percentiles, then mean and spread of the clipped values, as `Space`s.

    None names the space of all rows; with ``key``, each group names the space of the rows outside it. Missing
    values count nowhere. Exact percentiles come from wide histograms (`plans.wide`); with ``approximate`` one
    sketch pass replaces them for the space of all rows. A column without values has NULL parameters.
    """
    kept = cut(df.select(*([key] if key else []), *names))
    folds = wide.Folds(kept, names, key)
    if approximate and key is None:
        finite = lambda n: F.when(~F.isnan(n), F.col(n).cast("double"))
        row = kept.agg(*[F.percentile_approx(finite(n), list(CLIP_SHARES), 100_000).alias(n) for n in names]).first()
        bounds = {None: np.array([row[n] or (np.nan, np.nan) for n in names], float)}
    else:
        bounds = folds.percentiles(CLIP_SHARES)
    spaces = {}
    for fold, (mean, std) in folds.clipped_moments(bounds).items():
        flat = lambda v: tuple(None if np.isnan(x) else float(x) for x in v)
        spaces[folds.name(fold)] = Space(tuple(names), *(flat(v) for v in (*bounds[fold].T, mean, np.where(std == 0, 1.0, std))))
    return spaces


def space_table(df: DataFrame, names: Sequence[str] = FEATURES, approximate: bool = False) -> DataFrame:
    """`fold_spaces` of all rows as a table with one row per feature."""
    s = fold_spaces(df, names, approximate=approximate)[None]
    return grid(df.sparkSession, list(zip(s.names, s.clip_lo, s.clip_hi, s.mean, s.std)),
                "feature string, clip_lo double, clip_hi double, mean double, std double")


def fit_space(df: DataFrame, names: Sequence[str] = FEATURES, approximate: bool = False) -> Space:
    """The space of all rows as frozen parameters."""
    return fold_spaces(df, names, approximate=approximate)[None]


def rul_corr(df: DataFrame, eol: float = EOL_SOH) -> DataFrame:
    """Mean correlation of SOH with the days left, over trajectories that reach end of life.

    The days left differ from the negated day by a constant per trajectory, which a correlation
    does not see, so one aggregation is enough.
    """
    per = df.groupBy(KEY).agg(*_corr_sums(F.col("soh_true"), F.col("reference_day"), eol))
    corr, ok = _corr_of_sums()
    return per.where(ok).agg(F.avg(corr).alias("rul_corr_mean"), F.count("*").alias("n_trajectories"))


def _corr_sums(s: Column, d: Column, eol: float) -> list[Column]:
    return [F.count_if(s <= eol).alias("_e"), F.count("*").alias("_c_n"), F.stddev_pop(s).alias("_ss"),
            F.stddev_pop(d).alias("_sd"), F.covar_pop(s, -d).alias("_c")]


def _corr_of_sums() -> tuple[Column, Column]:
    """The correlation of a trajectory from its sums, and whether it counts."""
    ok = (F.col("_e") > 0) & (F.col("_c_n") >= 4) & (F.col("_ss") >= 1e-9) & (F.col("_sd") >= 1e-9)
    return F.col("_c") / (F.col("_ss") * F.col("_sd")), ok


def directionality(df: DataFrame, eol: float = EOL_SOH) -> DataFrame:
    """The six direction checks as one row, from one ordered pass.

    A row's step and its half of the series come from one window; everything else is a sum per trajectory: steps,
    halves, ends, end of life, and the moments of the correlation.
    """
    s, d, at = F.col("soh_true"), F.col("reference_day"), F.col(POS)
    rows = scan.halo(df.select(KEY, POS, "reference_day", "soh_true", "soh_observed"), back=1)
    rows = scan.attach(rows, total={"_n": (F.count_if("home"), F.sum)})
    rows = rows.withColumns({"_step": s - F.lag("soh_true").over(scan.series()), "_mid": F.expr("_n div 2")}).where("home")
    step = F.col("_step")
    per = rows.groupBy(KEY).agg(
        F.avg(F.when(step.isNotNull(), (step <= 1e-6).cast("double"))).alias("share"),
        F.coalesce(F.avg(F.when(at.between(1, F.col("_mid") - 1), step)), F.lit(0.0)).alias("early"),
        F.coalesce(F.avg(F.when(at > F.col("_mid"), step)), F.lit(0.0)).alias("late"),
        F.min_by("soh_true", POS).alias("first"), F.max_by("soh_true", POS).alias("last"),
        F.max(F.abs(s - F.col("soh_observed"))).alias("err"), *_corr_sums(s, d, eol),
    )
    corr, ok = _corr_of_sums()
    return per.agg(
        F.avg("share").alias("soh_non_increasing_frac"), F.avg("first").alias("init_mean"), F.avg("last").alias("end_mean"),
        F.avg("early").alias("delta_early_mean"), F.avg("late").alias("delta_late_mean"), F.max("err").alias("obs_err_max"),
        F.count_if(F.col("_e") > 0).alias("eol_trajectories"), F.avg(F.when(ok, corr)).alias("rul_corr_mean"),
    ).withColumns(
        {
            "check_1": F.col("soh_non_increasing_frac") > 0.9,
            "check_2": F.col("end_mean") < F.col("init_mean"),
            "check_3": F.col("delta_late_mean") <= F.col("delta_early_mean"),
            "check_4": F.col("obs_err_max") < 0.02,
            "check_5": F.col("eol_trajectories") >= 10,
            "check_6": F.coalesce(F.col("rul_corr_mean") > 0.5, F.lit(False)),
        }
    )


def threshold_sensitivity(df: DataFrame, base: float = EOL_SOH, factors: Sequence[float] = (0.8, 1.0, 1.2),
                          x: str = "soh_observed") -> DataFrame:
    """Mean first-crossing day at scaled thresholds; trajectories that never cross are left out."""
    cols = [F.min(F.when(F.col(x) <= base * f, F.col("reference_day"))).alias(f"_c{i}") for i, f in enumerate(factors)]
    per = df.groupBy(KEY).agg(*cols)
    wide = per.agg(*[f(f"_c{i}").alias(f"_{n}{i}") for i in range(len(factors)) for n, f in (("m", F.avg), ("n", F.count))])
    rows = [F.struct(F.lit(float(f)).alias("factor"), F.col(f"_m{i}").alias("mean_crossing_day"),
                     F.col(f"_n{i}").alias("n_crossing")) for i, f in enumerate(factors)]
    return wide.select(F.inline(F.array(*rows)))


def ordinal_slope(df: DataFrame, cols: Sequence[str], key: str = KEY) -> DataFrame:
    """Slope of each column over the row number of the concatenated trajectories.

    Sums per trajectory and the offset of each trajectory give the global sums, so no row ever
    needs its global number: sum over rows of (offset + i) * y = offset * sum(y) + sum(i * y).
    """
    i = F.col(POS).cast("double")
    aggs = [F.count("*").alias("_n"), F.sum(i).alias("_i"), F.sum(i * i).alias("_ii")]
    for c in cols:
        aggs += [F.sum(c).alias(f"_y_{c}"), F.sum(i * F.col(c)).alias(f"_iy_{c}")]
    offs = scan.global_offsets(df.groupBy(key).agg(*aggs), [key], "_n", "_o")
    o = F.col("_o").cast("double")
    total = [F.sum("_n").cast("double").alias("n"), F.sum(o * F.col("_n") + F.col("_i")).alias("sx"),
             F.sum(o * o * F.col("_n") + 2 * o * F.col("_i") + F.col("_ii")).alias("sxx")]
    for c in cols:
        total += [F.sum(f"_y_{c}").alias(f"sy_{c}"), F.sum(o * F.col(f"_y_{c}") + F.col(f"_iy_{c}")).alias(f"sxy_{c}")]
    t = offs.agg(*total)
    den = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = {c: (F.col("n") * F.col(f"sxy_{c}") - F.col("sx") * F.col(f"sy_{c}")) / den for c in cols}
    return t.select(*[e.alias(f"slope_{c}") for c, e in slope.items()])


def direction_accuracy(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Share of steps with a real change whose sign the prediction shares; 1 where there are none."""
    step = W.with_lag(df.select(KEY, POS, truth, pred), [truth, pred])
    hit = F.signum(f"diff_{truth}") == F.signum(f"diff_{pred}")
    moved = F.abs(f"diff_{truth}") > 1e-9
    return step.groupBy(KEY).agg(
        F.coalesce(F.avg(F.when(moved, hit.cast("double"))), F.lit(1.0)).alias("direction_accuracy")
    )


def slope_error(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Relative slope error per trajectory; a flat truth gives the absolute slope, or 0."""
    x = F.col(POS).cast("double")
    per = df.groupBy(KEY).agg(F.regr_slope(F.col(truth), x).alias("_t"), F.regr_slope(F.col(pred), x).alias("_p"))
    flat = F.abs("_t") < 1e-9
    err = F.when(flat, F.when(F.abs("_p") > 1e-9, F.abs("_p")).otherwise(F.lit(0.0))).otherwise(
        F.abs(F.col("_p") - F.col("_t")) / F.abs(F.when(flat, F.lit(None)).otherwise(F.col("_t")))
    )
    return per.select(KEY, err.alias("slope_error"))


def family_curve(df: DataFrame) -> DataFrame:
    return df.groupBy("family", "reference_day").agg(
        F.avg("soh_observed").alias("mean_observed"), F.avg("soh_true").alias("mean_true"), F.count("*").alias("n")
    )


def feature_drift(df: DataFrame, stored_prefix: str = "frozen_", names: Sequence[str] = FEATURES) -> DataFrame:
    """Largest difference per feature between stored columns and a recomputation from ``ctx``.

    Stored columns are named ``<prefix><NN>_<feature>``.
    """
    stored = {n: f"{stored_prefix}{i:02d}_{n}" for i, n in enumerate(names)}
    got = W.features_of_ctx(df)
    wide = got.agg(*[F.max(F.abs(F.col(n) - F.col(s))).alias(n) for n, s in stored.items()])
    return wide.unpivot([], list(names), "feature", "max_abs_diff")


def head_facts(df: DataFrame, keys: Sequence[str] = ("horizon",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct(KEY).alias("n_trajectories"))


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width bins over the observed range, the last one closed; empty bins are listed too."""
    src = df.where(F.col(col).isNotNull())
    span = settle(src.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi")))
    width = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.when(width > 0, F.least(F.floor((F.col(col) - F.col("_lo")) / F.when(width > 0, width)), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = src.join(span, F.lit(True)).groupBy(slot.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    frame = each_case(span, [(i,) for i in range(bins)], "bin int")
    return frame.join(counts, "bin", "left").select(
        F.col("bin").cast("long").alias("bin"),
        (F.col("_lo") + F.col("bin") * width).alias("bin_lo"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def distribution(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Quartiles, mean and extremes per group."""
    k = list(keys)
    src = df.where(F.col(col).isNotNull())
    quart = ranks.percentile_columns(src, k, col, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    rest = src.groupBy(*k).agg(F.count("*").alias("n"), F.avg(col).alias("mean"), F.min(col).alias("min"), F.max(col).alias("max"))
    return rest.join(quart, k) if k else beside(rest, quart)
