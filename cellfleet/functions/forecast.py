"""Forecast, remaining-life, crossing and alarm expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellfleet.functions.space import (
    EOL_SOH, FLAT_RUL_DAYS, MAX_RUL_DAYS, STEP_DAYS, WARN_SOH, clip, dot,
)
from cellfleet.plans.small import each_case

# Status words of the crossing read-out.
AT_ANCHOR = "CROSSED_AT_ANCHOR"
INTERPOLATED = "CROSSED_BY_INTERPOLATION"
NO_CROSSING = "NO_CROSSING_WITHIN_FORECAST_HORIZON"
MAX_FORECAST_DAYS = 112
NODE_DAYS = (0, 28, 56, 112)


def predict(df: DataFrame, zcols: Sequence[str], coefs: Sequence[str | float], intercept: str | float,
            anchor: str = "anchor_soh_observed") -> DataFrame:
    """Linear prediction on the delta scale and, added to the anchor, on the absolute scale."""
    b = F.col(intercept) if isinstance(intercept, str) else F.lit(float(intercept))
    return df.withColumn("pred_delta", b + dot(zcols, coefs)).withColumn(
        "pred_soh", F.col(anchor) + F.col("pred_delta")
    )


def persistence(df: DataFrame) -> DataFrame:
    """No change from the anchor."""
    return df.withColumn("pred_delta", F.lit(0.0))


def local_trend(df: DataFrame, horizon: str | int = "horizon", slope: str = "slope_full") -> DataFrame:
    """The observed context slope carried on over the horizon."""
    h = F.col(horizon) if isinstance(horizon, str) else F.lit(horizon)
    return df.withColumn("pred_delta", F.col(slope) * h)


def slope_rul(last: Column, slope: Column, eol: float = EOL_SOH) -> Column:
    """Days until the observed slope reaches the end-of-life level; flat or rising gives 2000."""
    days = F.when(slope < 0, (F.lit(eol) - last) / F.when(slope < 0, slope) * STEP_DAYS)
    return clip(F.coalesce(days, F.lit(FLAT_RUL_DAYS)), 0.0, MAX_RUL_DAYS)


def wiener_rul(mu: Column, level: Column, eol: float = EOL_SOH, cap: float = MAX_RUL_DAYS) -> Column:
    """Mean first-passage time of a drifting process; never later than ``cap`` days."""
    gap = level - F.lit(eol)
    falling = F.when(mu > 0, mu)
    return (
        F.when(gap <= 0, F.lit(0.0))
        .when(mu <= 0, F.lit(cap))
        .otherwise(F.least(gap / falling, F.lit(cap)))
    )


def interval(df: DataFrame, half_width: str, pred: str = "pred_soh") -> DataFrame:
    return df.withColumns(
        {"interval_lo": F.col(pred) - F.col(half_width), "interval_hi": F.col(pred) + F.col(half_width)}
    )


def path_crossing(levels: Sequence[Column], threshold: Column | float,
                  days: Sequence[int] = NODE_DAYS) -> dict[str, Column]:
    """First crossing on a piecewise-linear path: day, status and segment; never extrapolated."""
    if len(levels) != len(days) or len(days) < 2:
        raise ValueError("a path needs at least two aligned nodes")
    if days[-1] > MAX_FORECAST_DAYS:
        raise ValueError(f"a path may not reach past day {MAX_FORECAST_DAYS}")
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    at_anchor = levels[0] <= thr
    day = F.when(at_anchor, F.lit(0.0))
    segment = F.when(at_anchor, F.lit("anchor"))
    status = F.when(at_anchor, F.lit(AT_ANCHOR))
    for (d0, a), (d1, b) in zip(zip(days, levels), zip(days[1:], levels[1:])):
        fall = F.when(a > b, a - b)
        day = day.when(b <= thr, F.lit(float(d0)) + (a - thr) / fall * float(d1 - d0))
        segment = segment.when(b <= thr, F.lit(f"{d0}->{d1}d"))
        status = status.when(b <= thr, F.lit(INTERPOLATED))
    return {"days": day, "segment": segment, "status": status.otherwise(F.lit(NO_CROSSING))}


def rul_readout(df: DataFrame, anchor: str = "anchor_soh_observed",
                nodes: Sequence[str] = ("soh_h2", "soh_h4", "soh_h8")) -> DataFrame:
    """Remaining life and warning day of each forecast path, with their status columns."""
    levels = [F.col(anchor), *[F.col(n) for n in nodes]]
    eol = path_crossing(levels, EOL_SOH)
    warn = path_crossing(levels, WARN_SOH)
    return df.withColumns(
        {
            "rul_days": eol["days"],
            "rul_status": eol["status"],
            "rul_segment": eol["segment"],
            "rul_crossed_within_112d": eol["days"].isNotNull(),
            "warning_days": warn["days"],
            "warning_status": warn["status"],
            "warning_is_forecast": F.coalesce(warn["days"] > 0, F.lit(False)),
        }
    )


def alarm_outcome(true_day: Column, alarm_day: Column) -> Column:
    """Outcome of one trajectory's alarm against its true crossing."""
    crossed, alarmed = true_day.isNotNull(), alarm_day.isNotNull()
    return (
        F.when(crossed & alarmed, F.when(true_day >= alarm_day, "TRUE_POSITIVE").otherwise("LATE"))
        .when(crossed, "MISSED")
        .when(alarmed, "FALSE_POSITIVE")
        .otherwise("TRUE_NEGATIVE")
    )


CASE_SCHEMA = "case string, temperature_delta_c double, dod_multiplier double, crate_multiplier double"


def scale_drivers(df: DataFrame, cases: Sequence[tuple]) -> DataFrame:
    """All stress cases in one pass: temperature shift, DoD and C-rate multipliers."""
    if any(dod <= 0 or crate <= 0 for _, _, dod, crate in cases):
        raise ValueError("DoD and C-rate multipliers must be positive")
    return (
        each_case(df, cases, CASE_SCHEMA)
        .withColumns(
            {
                "mean_temp_c": F.col("mean_temp_c") + F.col("temperature_delta_c"),
                "max_temp_c": F.col("max_temp_c") + F.col("temperature_delta_c"),
                "dod": clip(F.col("dod") * F.col("dod_multiplier"), 0.0, 1.0),
                "mean_c_rate": F.col("mean_c_rate") * F.col("crate_multiplier"),
            }
        )
        .drop("temperature_delta_c", "dod_multiplier", "crate_multiplier")
    )


# Temperature correction per degree C, and its reference temperature.
TEMP_COEF_PER_C = 0.004
T_REF_C = 20.0


def temperature_corrected(df: DataFrame, cases: Sequence[tuple], soh: str = "soh_observed") -> DataFrame:
    """State of health corrected for temperature, once per (case, temp_factor) pair."""
    return each_case(df, cases, "case string, temp_factor double").withColumn(
        "soh_corrected",
        F.col(soh) / (1 + F.lit(TEMP_COEF_PER_C) * F.col("temp_factor") * (F.col("mean_temp_c") - T_REF_C)),
    )


def pack_json(df: DataFrame, keys: Sequence[str], name: str, value: str, digits: int = 8) -> DataFrame:
    """One JSON object of rounded values per group; ``name`` must be bounded, like families."""
    pair = F.struct(F.col(name).cast("string").alias("k"), F.round(value, digits).alias("v"))
    return df.groupBy(*keys).agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(pair)))).alias("packed")
    )


