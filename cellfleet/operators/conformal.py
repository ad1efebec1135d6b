"""Conformal half-widths and coverage. Half-widths are order statistics, not percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellfleet.plans.ranks import pick_ranks
from cellfleet.plans.scan import KEY
from cellfleet.plans.small import settle


def family_half_widths(df: DataFrame, resid: str, coverage: float, keys: Sequence[str] = ()) -> DataFrame:
    """Per family: the k-th smallest absolute residual, k = min(ceil((n + 1) * coverage), n).

    A family is a large share of all rows, so the rank is found by repeated histograms
    instead of sorting a family in one task.
    """
    k = [*keys, "family"]
    src = df.select(*k, F.abs(F.col(resid)).alias("_r"))
    got = pick_ranks(src, k, "_r", lambda n: F.array(F.least(F.ceil((n + 1) * F.lit(float(coverage))), n)))
    return settle(got.select(*k, "n", F.col("value").alias("half_width")))


def family_quantile(df: DataFrame, resid: str, coverage: float, keys: Sequence[str] = ()) -> DataFrame:
    """Family-balanced half-width: the mean of the families' own."""
    return family_half_widths(df, resid, coverage, keys).groupBy(*keys).agg(
        F.avg("half_width").alias("half_width"), F.count("*").alias("n_families"), F.sum("n").alias("n_calibration")
    )


def calibrate(df: DataFrame, resid: str, coverage: float) -> DataFrame:
    """The calibration record, on uncensored anchors only."""
    unc = df.where(F.col("censored") == 0) if "censored" in df.columns else df
    return family_quantile(unc, resid, coverage).withColumn("coverage_target", F.lit(float(coverage)))


def crossfit(df: DataFrame, resid: str, coverage: float) -> DataFrame:
    """Each family covered by the mean half-width of the other families; one row per family."""
    per = family_half_widths(df, resid, coverage)
    tot = per.agg(F.sum("half_width").alias("_s"), F.count("*").alias("_n"))
    others = F.col("_n") - 1
    hw = per.join(tot, F.lit(True)).where(others > 0).select(
        "family", ((F.col("_s") - F.col("half_width")) / others).alias("crossfit_half_width")
    )
    rows = df.where(F.col(resid).isNotNull()).select("family", F.abs(F.col(resid)).alias("_r"))
    # One row per family, settled above.
    return rows.join(settle(hw), "family").groupBy("family").agg(
        F.first("crossfit_half_width").alias("crossfit_half_width"),
        F.avg((F.col("_r") <= F.col("crossfit_half_width")).cast("double")).alias("coverage"),
        F.count("*").alias("n"),
    )


def crossfit_summary(per_family: DataFrame) -> DataFrame:
    return per_family.agg(
        F.avg("coverage").alias("mean_coverage"), F.min("coverage").alias("worst_coverage"),
        F.min_by("family", "coverage").alias("worst_family"),
    )


def _inside(truth: str, pred: str, half_width: str):
    t, p, h = F.col(truth), F.col(pred), F.col(half_width)
    return ((t >= p - h) & (t <= p + h)).cast("double")


def coverage(df: DataFrame, truth: str, pred: str, half_width: str, keys: Sequence[str] = ()) -> DataFrame:
    """Marginal coverage with inclusive bounds, and mean width."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(_inside(truth, pred, half_width)).alias("empirical_coverage"),
        F.avg(2 * F.col(half_width)).alias("mean_width"),
    )


def coverage_report(df: DataFrame, truth: str, pred: str, half_width: str, keys: Sequence[str] = ()) -> DataFrame:
    """Coverage over windows, trajectories and families, with the worst of each."""
    k = list(keys)
    src = df.select(*k, "family", KEY, F.col(half_width).alias("_h"), _inside(truth, pred, half_width).alias("_i"))
    per = src.groupBy(*k, "family", KEY).agg(F.sum("_i").alias("_s"), F.count("*").alias("_n"), F.sum("_h").alias("_w"))
    share = F.col("_s") / F.col("_n")
    fam = per.groupBy(*k, "family").agg(
        F.sum("_s").alias("_s"), F.sum("_n").alias("_n"), F.sum("_w").alias("_w"), F.sum(share).alias("_ts"),
        F.min(share).alias("_tm"), F.count("*").alias("_tn"),
    ).withColumn("_f", F.col("_s") / F.col("_n"))
    return fam.groupBy(*k).agg(
        F.sum("_n").alias("n_windows"),
        (F.sum("_s") / F.sum("_n")).alias("window_micro_coverage"),
        (2 * F.sum("_w") / F.sum("_n")).alias("mean_interval_width"),
        (F.sum("_ts") / F.sum("_tn")).alias("trajectory_macro_coverage"),
        F.min("_tm").alias("worst_trajectory_coverage"),
        F.sum("_tn").alias("n_trajectories"),
        F.avg("_f").alias("family_macro_coverage"),
        F.min("_f").alias("worst_family_coverage"),
        F.min_by("family", F.struct("_f", "family")).alias("worst_family"),
        F.count("*").alias("n_families"),
    )


def censored_check(df: DataFrame, pred: str, half_width: float = 0.0, bound: str = "rul_lower_bound_days",
                   keys: Sequence[str] = ()) -> DataFrame:
    """Censored anchors whose upper interval end reaches the observed follow-up."""
    ok = F.col(pred) + F.lit(float(half_width)) >= F.col(bound)
    return df.where(F.col("censored") == 1).groupBy(*keys).agg(
        F.avg(ok.cast("double")).alias("consistent_fraction"), F.count("*").alias("n_censored"),
        F.count_if(~ok).alias("n_violations"),
    )


def apply_half_width(df: DataFrame, quantiles: DataFrame, protocol: str, arm: str, level: float,
                     pred: str = "pred_soh") -> DataFrame:
    """Stored half-width per horizon, applied as it is and labelled with its source.

    A level without a stored half-width is refused by `contracts.half_width_refusals`.
    """
    table = settle(
        quantiles.where((F.col("protocol") == protocol) & (F.col("arm") == arm) & (F.col("coverage") == level))
    )
    return (
        df.join(table, "horizon")
        .withColumns(
            {
                "interval_lo": F.col(pred) - F.col("half_width"),
                "interval_hi": F.col(pred) + F.col("half_width"),
                "interval_is_per_horizon_marginal": F.lit(True),
            }
        )
        .withColumnRenamed("coverage", "interval_coverage_nominal")
    )
