"""Degradation replay, what-if scenarios and fault stress tests over driver tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellfleet.functions.forecast import alarm_outcome, scale_drivers
from cellfleet.functions.space import EOL_SOH, WARN_SOH, Space, apply_space, clip
from cellfleet.operators import aggregates as A
from cellfleet.operators import learning as L
from cellfleet.operators import windows as W
from cellfleet.operators.contracts import checked_join
from cellfleet.plans import ranks, scan
from cellfleet.plans.scan import KEY, POS
from cellfleet.plans.small import collect_bounded, each_case, grid

# Columns of the driver and parameter tables, and truth that may not be a driver.
DRIVER_COLUMNS = (
    "trajectory_id", "environment_family_id", "split", "reference_index", "timestamp_utc", "age_days",
    "mean_temp_c", "max_temp_c", "mean_c_rate", "dod", "ah_throughput", "wh_throughput", "efc",
    "eclipse_h_per_day", "mission_comm_ratio", "mean_beta_deg", "mean_abs_beta_deg", "mean_solar_power_w",
    "max_solar_power_w", "mean_effective_area_m2", "altitude_km", "inclination_deg", "raan_deg",
    "day_of_year", "mean_soc",
)
PARAMETER_COLUMNS = (
    "trajectory_id", "environment_family_id", "split", "seed_index", "q0_ah", "initial_rint_ohm", "k_cal",
    "k_cyc", "dod_exponent", "crate_exponent", "temperature_sensitivity", "knee_start_loss", "knee_gain",
    "beta_cal", "beta_cyc", "rint_exponent", "sensor_soh_sigma", "start_day_of_year",
)
TRUTH_COLUMNS = (
    "soh", "soh_observed", "soh_true", "capacity_ah", "rint_ohm", "eol_reached", "eol_day_exact",
    "final_soh_true", "target_soh",
)
POSITIVE_PARAMETERS = (
    "q0_ah", "initial_rint_ohm", "k_cal", "k_cyc", "dod_exponent", "crate_exponent", "temperature_sensitivity",
)


def declared_contract() -> dict[str, tuple[str, ...]]:
    """The declared columns, as arguments of `contracts.driver_violations`."""
    return {"required": DRIVER_COLUMNS, "forbidden": TRUTH_COLUMNS, "positive": POSITIVE_PARAMETERS,
            "param_required": PARAMETER_COLUMNS}


# Parameters that the replay itself reads.
USED_PARAMETERS = (
    "q0_ah", "initial_rint_ohm", "k_cal", "k_cyc", "dod_exponent", "crate_exponent", "temperature_sensitivity",
    "knee_start_loss", "knee_gain", "beta_cal", "beta_cyc", "rint_exponent",
)
# The what-if cases and their unchanged baseline.
CASES = (
    ("baseline", 0.0, 1.0, 1.0),
    ("temperature_plus_5c", 5.0, 1.0, 1.0),
    ("dod_x1_2", 0.0, 1.2, 1.0),
    ("crate_x1_2", 0.0, 1.0, 1.2),
)


@dataclass(frozen=True)
class ReplayConfig:
    """Global coefficients of the replay."""

    calendar_scale: float = 1.0
    cycle_scale: float = 1.0
    knee_gain_scale: float = 1.0
    knee_start_offset: float = 0.0
    rint_growth_scale: float = 1.0
    temperature_reference_c: float = 25.0


def prepare_drivers(l2: DataFrame, params: DataFrame, calendar: DataFrame, drivers: Sequence[str],
                    truth: Sequence[str] = ("soh_true", "rint_ohm", "capacity_ah")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split a full reference table into drivers, parameters and renamed truth.

    The calendar must cover every (family, day_of_year) of the table exactly once.
    """
    dim = calendar.select("family", "day_of_year", "mean_soc")
    full = checked_join(l2, dim, ["family", "day_of_year"], "left", "m:1", cover=True)
    out = full.select(*drivers)
    ref = l2.select(KEY, "family", "split", POS, "age_days",
                    *[F.col(c).alias(f"{c}_reference") for c in truth if c in l2.columns])
    return out, params, ref


def _keys(df: DataFrame) -> list[str]:
    return [c for c in ("case", KEY) if c in df.columns]


def _with_increments(drivers: DataFrame, params: DataFrame, t_ref: float = 25.0) -> DataFrame:
    """Drivers with ``chunk``, the used parameters and both loss increments."""
    keys = _keys(drivers)
    cut = scan.halo(drivers, back=1, spread=False)
    cut = scan.attach_dim(cut, params.select(KEY, *USED_PARAMETERS))
    c, w = F.col, scan.series(keys)
    prev = lambda n: F.coalesce(F.lag(n).over(w), F.lit(0.0))
    heat = lambda t: F.exp(c("temperature_sensitivity") * (c(t) - t_ref))
    cal = (
        c("k_cal") * (F.sqrt("age_days") - F.sqrt(prev("age_days"))) * heat("max_temp_c")
        * (1 + c("beta_cal") * c("mean_soc"))
    )
    cyc = (
        c("k_cyc") * (c("efc") - prev("efc")) * F.pow("dod", "dod_exponent")
        * F.pow("mean_c_rate", "crate_exponent") * heat("mean_temp_c")
        * (1 + c("beta_cyc") * c("mean_abs_beta_deg") / 90.0)
    )
    first = c(POS) == 0
    return (
        cut.withColumns(
            {
                "calendar_base": F.when(first, F.lit(0.0)).otherwise(cal),
                "cycle_base": F.when(first, F.lit(0.0)).otherwise(cyc),
            }
        )
        .where("home")
        .drop("home")
    )


def damage_increments(drivers: DataFrame, params: DataFrame, t_ref: float = 25.0) -> DataFrame:
    """Calendar and cycling loss of every step, before global scales; the first step loses nothing."""
    return _with_increments(drivers, params, t_ref).select(*_keys(drivers), POS, "calendar_base", "cycle_base")


def _loss(raw: Column, scale: Column | float, offset: Column | float) -> Column:
    """Raw loss with the knee: growth beyond the knee start counts again by the knee gain."""
    extra = scale * F.col("knee_gain") * F.greatest(F.lit(0.0), raw - (F.col("knee_start_loss") + offset))
    return raw + extra


def replay_damage(drivers: DataFrame, params: DataFrame, cfg: ReplayConfig = ReplayConfig()) -> DataFrame:
    """Accumulate loss and read out SOH, capacity and resistance; all cases of a table in one job."""
    keys = _keys(drivers)
    inc = _with_increments(drivers, params, cfg.temperature_reference_c).withColumns(
        {
            "calendar_increment": cfg.calendar_scale * F.col("calendar_base"),
            "cycle_increment": cfg.cycle_scale * F.col("cycle_base"),
        }
    )
    out = scan.running_sums(inc, {"raw_loss": F.col("calendar_increment") + F.col("cycle_increment")}, key=keys)
    total = F.greatest(F.lit(0.0), _loss(F.col("raw_loss"), cfg.knee_gain_scale, F.lit(cfg.knee_start_offset)))
    return (
        out.withColumn("_total", total)
        .withColumn("soh_true", clip(1 - F.col("_total"), 0.0, 1.0))
        .withColumns(
            {
                "capacity_ah": F.col("q0_ah") * F.col("soh_true"),
                "rint_ohm": F.col("initial_rint_ohm")
                * (1 + cfg.rint_growth_scale * F.pow("_total", "rint_exponent")),
            }
        )
        .drop("_total", "chunk", "calendar_base", "cycle_base", *USED_PARAMETERS)
    )


def replay_metrics(generated: DataFrame, reference: DataFrame, test_split: str = "test") -> DataFrame:
    """Errors against reference truth: all rows, calibration or held-out, and per (split, family)."""
    ref = reference.select(KEY, POS, "split", "family", "soh_true_reference")
    both = checked_join(generated.select(KEY, POS, "soh_true"), ref, [KEY, POS], "inner", "1:1")
    both = both.withColumn("held_out", F.col("split") == test_split)
    return A.error_metrics(both, "soh_true_reference", "soh_true", [[], ["held_out"], ["split", "family"]])


def compare_scenarios(drivers: DataFrame, params: DataFrame, cfg: ReplayConfig = ReplayConfig(),
                      cases: Sequence[tuple] = CASES) -> tuple[DataFrame, DataFrame]:
    """Final SOH of every trajectory under every case against the baseline, and a summary per case.

    All cases run keyed in one job; the last point is a mergeable aggregate, and the baseline is
    picked inside each trajectory's few case rows, so no self-join is needed.
    """
    final = W.first_last(replay_damage(scale_drivers(drivers, cases), params, cfg), ["soh_true"], ["case", KEY])
    base = F.max(F.when(F.col("case") == "baseline", F.col("last_soh_true"))).alias("baseline_final_soh")
    pairs = F.collect_list(F.struct("case", F.col("last_soh_true").alias("final_soh"))).alias("_c")
    detail = (
        final.groupBy(KEY).agg(base, pairs)
        .select(KEY, "baseline_final_soh", F.inline("_c"))
        .where(F.col("case") != "baseline")
        .withColumn("delta_soh", F.col("final_soh") - F.col("baseline_final_soh"))
    )
    d = F.col("delta_soh")
    summary = detail.groupBy("case").agg(
        F.count("*").alias("n_trajectories"), F.avg(d).alias("mean_final_soh_change"),
        F.max(d).alias("max_final_soh_change"), F.count_if(d > 1e-12).alias("n_direction_violations"),
        F.count_if(d < -1e-8).alias("n_strictly_faster"),
    )
    return detail, summary


def score_scenarios(generated: DataFrame, heads: DataFrame, z: Sequence[str], space: Space, h: int = 8) -> DataFrame:
    """Error of frozen out-of-family heads on every case, and its rise over the baseline.

    ``generated`` carries case, family and the noise-free ``soh_true`` as both channels.
    """
    rows = generated.withColumn("reference_day", 14.0 * F.col(POS))
    win = W.with_target(rows, (h,), "soh_true", "soh_true", key=["case", KEY])
    scored = L.attach_heads(apply_space(win, space), heads, z)
    e = F.col("pred_soh") - F.col("target_soh_true")
    per = scored.groupBy("case").agg(F.count("*").alias("n_windows"), F.sqrt(F.avg(e * e)).alias("rmse_soh"))
    base = per.where(F.col("case") == "baseline").select(F.col("rmse_soh").alias("baseline_rmse_soh"))
    return per.join(base, F.lit(True)).withColumn("delta_rmse", F.col("rmse_soh") - F.col("baseline_rmse_soh"))


def calibrate_grid(drivers: DataFrame, params: DataFrame, reference: DataFrame, candidates: Sequence[tuple],
                   test_split: str = "test") -> DataFrame:
    """Squared error of every candidate (calendar, cycle, knee scale, knee offset) on fitting splits.

    Running sums are linear in the two scales, so they are taken once; candidates multiply rows
    only in the map tasks, where their squared errors are summed.
    """
    inc = _with_increments(drivers, params)
    cum = scan.running_sums(inc, {"_cal": "calendar_base", "_cyc": "cycle_base"})
    truth = reference.where(F.col("split") != test_split).select(KEY, POS, "soh_true_reference")
    rows = cum.select(KEY, POS, "_cal", "_cyc", "knee_gain", "knee_start_loss").join(truth, [KEY, POS])
    cand = each_case(
        rows, [(i, *map(float, c)) for i, c in enumerate(candidates)],
        "cand int, calendar_scale double, cycle_scale double, knee_scale double, knee_offset double",
    )
    raw = F.col("calendar_scale") * F.col("_cal") + F.col("cycle_scale") * F.col("_cyc")
    err = _loss(raw, F.col("knee_scale"), F.col("knee_offset")) - (1 - F.col("soh_true_reference"))
    return cand.groupBy("cand", "calendar_scale", "cycle_scale", "knee_scale", "knee_offset").agg(
        F.sum(err * err).alias("sse"), F.count("*").alias("n_rows")
    )


def best_candidate(scored: DataFrame) -> DataFrame:
    return scored.agg(F.min_by(F.struct(*scored.columns), F.struct("sse", "cand")).alias("b")).select("b.*")


def refine(drivers: DataFrame, params: DataFrame, reference: DataFrame, start: Sequence[float],
           step: Sequence[float], bounds: Sequence[tuple[float, float]], rounds: int = 6,
           test_split: str = "test") -> tuple[float, ...]:
    """Shrink a grid around the winner: one `calibrate_grid` job per round."""
    at = tuple(map(float, start))
    for _ in range(rounds):
        axes = [sorted({min(max(a + k * s, lo), hi) for k in (-1, 0, 1)}) for a, s, (lo, hi) in zip(at, step, bounds)]
        cands = [at] + [(a, b, c, d) for a in axes[0] for b in axes[1] for c in axes[2] for d in axes[3] if (a, b, c, d) != at]
        row = collect_bounded(best_candidate(calibrate_grid(drivers, params, reference, cands, test_split)), 1, "winner")[0]
        won = (row["calendar_scale"], row["cycle_scale"], row["knee_scale"], row["knee_offset"])
        if won == at:
            step = [s / 2 for s in step]
        at = won
    return at


def resistance_scale(reference: DataFrame, params: DataFrame, test_split: str = "test") -> DataFrame:
    """Closed-form growth scale of resistance over loss, on fitting splits: sum xy / sum xx."""
    dim = params.select(KEY, "initial_rint_ohm", "rint_exponent")
    cut = scan.halo(reference.where(F.col("split") != test_split), spread=False).drop("home")
    rows = scan.attach_dim(cut, dim)
    x = F.pow(F.greatest(1 - F.col("soh_true_reference"), F.lit(0.0)), F.col("rint_exponent"))
    y = F.col("rint_ohm_reference") / F.col("initial_rint_ohm") - 1
    return rows.agg((F.sum(x * y) / F.sum(x * x)).alias("rint_growth_scale"), F.count("*").alias("n_rows"))


# ---------------------------------------------------------------- faults


#: Share of the fleet that each fault class takes: 15 of 120 trajectories in the published protocol.
FAULT_SHARE = 0.125


def assign_faults(df: DataFrame, share: float = FAULT_SHARE, faults: Sequence[tuple] = W.FAULTS) -> DataFrame:
    """Consecutive blocks of ids, in id order, one block per fault class and of one size, a share of the fleet.

    Ids are numbered by one range-partitioned sort at any size; a share of less than one id is one id.
    """
    ids = scan.global_offsets(df.select("family", KEY).distinct().withColumn("_one", F.lit(1)), [KEY], "_one", "_o")
    size = ids.agg(F.greatest(F.floor(F.count("*") * F.lit(float(share))), F.lit(1)).alias("n")).first()["n"]
    table = grid(df.sparkSession, [(i, *f) for i, f in enumerate(faults)], "_b int, " + W.FAULT_SCHEMA)
    return (
        ids.where(F.col("_o") < size * len(faults)).withColumn("_b", F.floor(F.col("_o") / size).cast("int"))
        .join(table, "_b")
        .drop("_b", "_o", "_one")
    )


def faulted(df: DataFrame, assigned: DataFrame) -> DataFrame:
    """The perturbed subset: every point of the assigned trajectories with both channels."""
    cols = [c for c in assigned.columns if c != "family"]
    # Rows of other trajectories go before any window; a hot one is joined chunk by chunk.
    cut = scan.halo(df, spread=False).drop("home")
    rows = scan.attach_dim(cut, assigned.select(*cols)).drop("chunk")
    return W.perturb(rows)


def fault_records(points: DataFrame) -> DataFrame:
    """Onset, both crossings before and after, and days lost, per perturbed trajectory."""
    day = F.col("reference_day")
    hit = lambda c, t: F.min(F.when(F.col(c) <= t, day))
    onset = F.col(POS) == F.col("onset_index")
    per = points.groupBy(KEY, "family", "fault_type").agg(
        F.first("onset_index").alias("onset_index"),
        F.max(F.when(onset, day)).alias("onset_day"),
        F.max(F.when(onset, F.col("soh_true"))).alias("soh_at_onset"),
        hit("soh_true", EOL_SOH).alias("baseline_eol_day"),
        hit("soh_true_faulted", EOL_SOH).alias("faulted_eol_day"),
        hit("soh_true", WARN_SOH).alias("baseline_warn_day"),
        hit("soh_true_faulted", WARN_SOH).alias("faulted_warn_day"),
        F.count("*").alias("n_points"),
    )
    return per.withColumns(
        {
            "eol_advance_days": F.col("baseline_eol_day") - F.col("faulted_eol_day"),
            "warn_advance_days": F.col("baseline_warn_day") - F.col("faulted_warn_day"),
        }
    )


def fault_summary(points: DataFrame, records: DataFrame) -> DataFrame:
    """Per fault: mean onset and advances, SOH spans, points below end of life, marked points."""
    a = records.groupBy("fault_type").agg(
        F.count("*").alias("n_trajectories"), F.avg("onset_day").alias("mean_onset_day"),
        F.avg("eol_advance_days").alias("mean_eol_advance_days"),
        F.avg("warn_advance_days").alias("mean_warn_advance_days"),
    )
    span = lambda c: F.max(c) - F.min(c)
    b = points.groupBy("fault_type").agg(
        span("soh_true").alias("baseline_span"), span("soh_true_faulted").alias("faulted_span"),
        F.count_if(F.col("soh_true") <= EOL_SOH).alias("below_eol_baseline"),
        F.count_if(F.col("soh_true_faulted") <= EOL_SOH).alias("below_eol_faulted"),
        F.count_if(F.col("dod_event") > 0).alias("deep_discharge_events"),
        F.count_if(F.col("temperature_bias_c") > 0).alias("thermal_bias_points"),
        F.count_if(F.col("rint_multiplier") > 1).alias("elevated_rint_points"),
    )
    return a.join(b, "fault_type")


def fault_windows(points: DataFrame, h: int = 8) -> DataFrame:
    """Anchors of both channels as one table keyed by ``channel``."""
    both = points.select(
        KEY, "family", "fault_type", POS, "reference_day",
        F.inline(
            F.array(
                F.struct(F.lit("baseline").alias("channel"), "soh_observed", "soh_true"),
                F.struct(F.lit("faulted").alias("channel"), F.col("soh_observed_faulted").alias("soh_observed"),
                         F.col("soh_true_faulted").alias("soh_true")),
            )
        ),
    )
    return W.with_target(both, (h,), key=["channel", KEY])


def fault_evaluation(scored: DataFrame, warn: float = WARN_SOH) -> tuple[DataFrame, DataFrame]:
    """Absolute error before and after per fault, and alarm statistics per channel.

    The alarm side reads its crossing off the anchors' target column, on anchor days.
    """
    err = F.abs(F.col("pred_soh") - F.col("target_soh_true"))
    on = lambda ch: F.when(F.col("channel") == ch, err)
    mae = scored.groupBy("fault_type").agg(
        F.count(on("faulted")).alias("n_rows"),
        F.avg(on("baseline")).alias("mae_absolute_soh_baseline"),
        F.avg(on("faulted")).alias("mae_absolute_soh_faulted"),
    )
    mae = mae.withColumn("degradation_ratio", F.try_divide("mae_absolute_soh_faulted", "mae_absolute_soh_baseline"))
    day = F.col("reference_day")
    per = scored.groupBy("channel", KEY).agg(
        F.min(F.when(F.col("target_soh_true") <= warn, day)).alias("t"),
        F.min(F.when(F.col("pred_soh") <= warn, day)).alias("a"),
    )
    per = per.withColumn("outcome", alarm_outcome(F.col("t"), F.col("a")))
    tp = F.col("outcome") == "TRUE_POSITIVE"
    per = per.withColumn("dt", F.when(tp, F.col("t") - F.col("a")))
    alarms = per.groupBy("channel").agg(
        F.count("*").alias("n"), F.count_if(tp).alias("n_true_positive"),
        F.count_if(F.col("outcome") == "MISSED").alias("n_missed"),
        F.count_if(F.col("outcome") == "LATE").alias("n_late"), F.avg("dt").alias("dt_warn_mean_days"),
    )
    med = ranks.percentile_columns(per, ["channel"], "dt", {"dt_warn_median_days": 0.5})
    return mae, alarms.join(med, "channel", "left")
