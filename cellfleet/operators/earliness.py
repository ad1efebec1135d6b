"""How early and how credibly a fleet is warned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellfleet.functions.forecast import alarm_outcome
from cellfleet.functions.space import EOL_SOH, WARN_SOH
from cellfleet.plans import ranks, scan
from cellfleet.plans.small import beside, cut
from cellfleet.plans.scan import KEY, POS

# Share of remaining life that counts as accurate, and its least width.
ALPHA = 0.2
MIN_BAND = 1e-12


def first_crossing(df: DataFrame, threshold: float = EOL_SOH, x: str = "soh_true", day: str = "reference_day",
                   out: str = "t_true_cross_day", keys: Sequence[str] = (KEY,)) -> DataFrame:
    """First day at or below the threshold on the full grid, else NULL; not interpolated."""
    return df.groupBy(*keys).agg(F.min(F.when(F.col(x) <= threshold, F.col(day))).alias(out))


def first_alarm(df: DataFrame, threshold: float = WARN_SOH, pred: str = "pred_soh", day: str = "reference_day",
                keys: Sequence[str] = (KEY,)) -> DataFrame:
    """First anchor whose prediction is at or below the threshold; missing ones are no alarm."""
    return first_crossing(df, threshold, pred, day, "t_alarm_day", keys)


def lead_time(points: DataFrame, predictions: DataFrame, threshold: float = WARN_SOH) -> DataFrame:
    """Days from the first alarm to the true crossing, and the outcome, per trajectory."""
    cross = first_crossing(points, threshold, keys=("family", KEY))
    both = cross.join(first_alarm(predictions, threshold), KEY, "left")
    t, a = F.col("t_true_cross_day"), F.col("t_alarm_day")
    return both.withColumns(
        {
            "dt_warn_days": t - a,
            "outcome": alarm_outcome(t, a),
            "crossed": t.isNotNull(),
            "alarmed": a.isNotNull(),
        }
    )


def _banded(df: DataFrame, alpha: float, floor: float, clamp: bool, truth: str, pred: str) -> DataFrame:
    p = F.greatest(F.col(pred), F.lit(0.0)) if clamp else F.col(pred)
    band = F.greatest(alpha * F.col(truth), F.lit(float(floor)), F.lit(MIN_BAND))
    valid = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull())
    return scan.halo(valid.withColumn("inside", F.abs(p - F.col(truth)) <= band)).drop("home")


def prognostic_horizon(df: DataFrame, alpha: float = ALPHA, floor: float = 0.0, clamp: bool = False,
                       truth: str = "rul_days", pred: str = "pred_rul") -> DataFrame:
    """Days before end of life from which every later prediction stays inside the band.

    The entry is the first anchor after the last one outside, so no backward scan is needed.
    """
    out_day = F.max(F.when(~F.col("inside"), F.col("reference_day")))
    ctx = scan.attach(_banded(df, alpha, floor, clamp, truth, pred), total={"_last_out": (out_day, F.max)})
    stays = F.col("_last_out").isNull() | (F.col("reference_day") > F.col("_last_out"))
    per = ctx.groupBy(KEY).agg(
        F.min(F.when(stays, F.col("reference_day"))).alias("ph_entry_day"),
        F.max(F.col("reference_day") + F.col(truth)).alias("_eol"),
        F.count_if("inside").alias("n_anchors_inside_band"),
        F.count("*").alias("n_anchors"),
    )
    return per.withColumn("ph_days", F.coalesce(F.col("_eol") - F.col("ph_entry_day"), F.lit(0.0))).drop("_eol")


def credible_window(df: DataFrame, alpha: float = ALPHA, truth: str = "rul_days", pred: str = "pred_rul") -> DataFrame:
    """The longest run of anchors inside the band, by day span; the first of equals.

    A run is what shares the number of outside anchors before it. Single-point runs span 0.
    """
    outside = F.when(F.col("inside"), F.lit(0)).otherwise(F.lit(1))
    runs = scan.running_sums(_banded(df, alpha, 0.0, False, truth, pred), {"run": outside})
    day = F.when(F.col("inside"), F.col("reference_day"))
    per_run = runs.groupBy(KEY, "run").agg(
        F.min(day).alias("lo"), F.max(day).alias("hi"), F.max(F.col("reference_day") + F.col(truth)).alias("_eol")
    )
    best = per_run.groupBy(KEY).agg(
        F.max(F.struct(F.coalesce(F.col("hi") - F.col("lo"), F.lit(0.0)).alias("span"), (-F.col("lo")).alias("neg"),
                       F.col("hi").alias("hi"))).alias("b"),
        F.max("_eol").alias("_eol"),
    )
    real = F.col("b.span") > 0
    return best.select(
        KEY,
        F.col("b.span").alias("credible_window_days"),
        F.when(real, -F.col("b.neg")).alias("credible_window_start_day"),
        F.when(real, F.col("b.hi")).alias("credible_window_end_day"),
        F.when(real, F.col("_eol") + F.col("b.neg")).alias("credible_window_lead_before_eol_days"),
    )


def prognostic_records(points: DataFrame, soh: DataFrame, rul: DataFrame, warn: float = WARN_SOH,
                       eol: float = EOL_SOH, grid_floor: float = 14.0) -> DataFrame:
    """One row per trajectory: alarm outcome, both horizons and the credible window.

    Three operators read the remaining-life predictions, so these are evaluated once.
    """
    rul = cut(rul.select(KEY, POS, "reference_day", "rul_days", "pred_rul"))
    lead = lead_time(points, soh, warn)
    end = first_crossing(points, eol, out="t_eol_day")
    strict = prognostic_horizon(rul)
    floored = prognostic_horizon(rul, floor=grid_floor, clamp=True).select(
        KEY,
        F.col("ph_days").alias("ph_days_gridfloor"),
        F.col("ph_entry_day").alias("ph_entry_day_gridfloor"),
        F.col("n_anchors_inside_band").alias("n_anchors_inside_band_gridfloor"),
    )
    out = lead.join(end, KEY)
    for part in (strict, floored, credible_window(rul)):
        out = out.join(part, KEY, "left")
    return out.withColumn("ph_defined", F.col("ph_days").isNotNull())


def earliness_summary(records: DataFrame) -> DataFrame:
    """Outcome counts and rates, lead times of true positives, and horizon statistics.

    The record table is evaluated once and read by all parts of the summary.
    """
    records = cut(records)
    o = F.col("outcome")
    n = lambda word: F.count_if(o == word)
    crossed, never = F.count_if("crossed"), F.count_if(~F.col("crossed"))
    dt = F.when(o == "TRUE_POSITIVE", F.col("dt_warn_days"))
    one = records.agg(
        F.count("*").alias("n_trajectories"),
        crossed.alias("n_crossed"),
        never.alias("n_never_crossed"),
        n("TRUE_POSITIVE").alias("n_true_positive"),
        n("LATE").alias("n_late"),
        n("MISSED").alias("n_missed"),
        n("FALSE_POSITIVE").alias("n_false_positive"),
        n("TRUE_NEGATIVE").alias("n_true_negative"),
        F.try_divide(n("MISSED"), crossed).alias("miss_rate_of_crossers"),
        F.try_divide(n("LATE"), crossed).alias("late_rate_of_crossers"),
        F.try_divide(n("FALSE_POSITIVE"), never).alias("false_alarm_rate_of_non_crossers"),
        F.count(dt).alias("dt_warn_n"),
        F.avg(dt).alias("dt_warn_mean_days"),
        F.min(dt).alias("dt_warn_min_days"),
        F.max(dt).alias("dt_warn_max_days"),
    )
    full = "ph_days" in records.columns
    named = {"dt_warn_median_days": ("_dt", 0.5), "dt_warn_p10_days": ("_dt", 0.1), "dt_warn_p90_days": ("_dt", 0.9)}
    parts = [one]
    if full:
        named |= {
            "ph_median_days": ("ph_days", 0.5), "ph_p10_days": ("ph_days", 0.1), "ph_p90_days": ("ph_days", 0.9),
            "ph_gridfloor_median_days": ("ph_days_gridfloor", 0.5), "ph_gridfloor_p90_days": ("ph_days_gridfloor", 0.9),
            "credible_window_median_days": ("credible_window_days", 0.5),
            "credible_window_p90_days": ("credible_window_days", 0.9),
            "credible_window_lead_median_days": ("credible_window_lead_before_eol_days", 0.5),
        }
        parts.append(
            records.agg(
                F.count("ph_days").alias("ph_n_defined"), F.avg("ph_days").alias("ph_mean_days"),
                F.avg("ph_days_gridfloor").alias("ph_gridfloor_mean_days"),
                F.count_if(F.col("ph_days_gridfloor") > 0).alias("ph_gridfloor_n_nonzero"),
                F.sum("n_anchors_inside_band").alias("anchors_inside_band_strict"),
                F.sum("n_anchors_inside_band_gridfloor").alias("anchors_inside_band_gridfloor"),
                F.sum("n_anchors").alias("rul_anchors_total"),
                F.count("credible_window_days").alias("credible_window_n"),
                F.avg("credible_window_days").alias("credible_window_mean_days"),
                F.avg("credible_window_lead_before_eol_days").alias("credible_window_lead_mean_days"),
            )
        )
    return beside(*parts, ranks.percentile_table(records.withColumn("_dt", dt), named))


def lead_by_family(records: DataFrame) -> DataFrame:
    """Mean lead time of true positives by family, and the mean of the families as family NULL."""
    dt = F.when(F.col("outcome") == "TRUE_POSITIVE", F.col("dt_warn_days"))
    per = records.groupBy("family").agg(F.avg(dt).alias("dt_warn_mean_days"), F.count(dt).alias("n"))
    macro = per.agg(F.avg("dt_warn_mean_days").alias("dt_warn_mean_days"), F.sum("n").alias("n"))
    return per.unionByName(macro, allowMissingColumns=True)


