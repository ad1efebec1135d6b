"""Aggregation, metric, conformal and earliness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellfleet.catalog.contract_queries import DRIVERS
from cellfleet.catalog.registry import (
    ANCHORS, FEATURE_NAMES, TRAJ, WIN, points, query, sql, stored_points, windows,
)
from cellfleet.catalog.series_queries import HALVES, SLOPE_RUL
from cellfleet.functions.forecast import local_trend, slope_rul
from cellfleet.operators import aggregates as A
from cellfleet.operators import conformal as C
from cellfleet.operators import earliness as P
from cellfleet.operators import windows as W
from cellfleet.plans.scan import KEY, POS
from cellfleet.sources import testbed as B

TEL = """tel AS (SELECT l_suppkey AS scenario_id, l_suppkey % 6 AS family, l_shipdate AS ts, 28 + 50 * l_tax AS voltage_v,
  CASE WHEN l_returnflag = 'R' THEN -l_quantity / 2 ELSE l_quantity / 2 END AS current_a, 15 + 100 * l_discount AS temperature_c,
  0.3::double * l_quantity / 50 AS dod_orbit, l_quantity / 50 AS efc, l_quantity * 0.8::double AS ah_throughput, l_quantity * 24 AS wh_throughput,
  1 - l_discount AS soh_true, 0.045::double + l_tax / 10 AS rint_ohm_true, l_linenumber AS orbit_no FROM lineitem),
env AS (SELECT scenario_id, family, count(*) AS n_samples, avg(temperature_c) AS mean_temp_c, max(temperature_c) AS max_temp_c, min(voltage_v) AS min_voltage_v,
  max(voltage_v) AS max_voltage_v, max(abs(current_a)) AS max_abs_current_a, max(dod_orbit) AS max_dod, avg(dod_orbit) AS mean_dod, max(efc) AS final_efc,
  max(ah_throughput) AS final_ah_throughput, max(wh_throughput) AS final_wh_throughput, min(soh_true) AS min_soh_true, max(rint_ohm_true) AS max_rint_ohm
  FROM tel GROUP BY 1, 2)"""


@query(sql(TEL, "env", "scenario_id family n_samples", "mean_temp_c max_temp_c min_voltage_v max_voltage_v max_abs_current_a max_dod mean_dod final_efc final_ah_throughput final_wh_throughput min_soh_true max_rint_ohm"))
def telemetry_envelope(spark, d):
    """A1: envelope per scenario."""
    return A.telemetry_envelope(B.telemetry(spark, d))


CH = ["voltage_v", "current_a", "temperature_c", "dod_orbit"]


@query(sql(TEL + ", o AS (" + " UNION ALL ".join(f"SELECT '{c}' AS channel, min({c})::double AS min_value, max({c})::double AS max_value FROM tel" for c in CH) + ")",
           "o", "channel", "min_value max_value"))
def channel_ranges(spark, d):
    """A2: fleet range of each channel."""
    return A.channel_ranges(B.telemetry(spark, d), CH)


@query(sql(TEL + "," + DRIVERS + """, a AS (SELECT family, avg(mean_temp_c) AS mean_temp_c_l1, max(max_temp_c) AS max_temp_c_l1, avg(mean_dod) AS mean_dod_l1 FROM env GROUP BY 1),
  b AS (SELECT family, avg(mean_temp_c) AS mean_temp_c_l2, max(max_temp_c) AS max_temp_c_l2, avg(dod) AS mean_dod_l2 FROM drv WHERE reference_index <= 1 GROUP BY 1),
  o AS (SELECT *, abs(mean_temp_c_l1 - mean_temp_c_l2) AS temp_mean_abs_diff, abs(mean_dod_l1 - mean_dod_l2) AS dod_mean_abs_diff FROM a LEFT JOIN b USING (family))""",
           "o", "family", "mean_temp_c_l1 max_temp_c_l1 mean_dod_l1 mean_temp_c_l2 max_temp_c_l2 mean_dod_l2 temp_mean_abs_diff dod_mean_abs_diff"))
def layer_agreement(spark, d):
    """Family aggregates of two layers side by side."""
    return A.layer_agreement(A.telemetry_envelope(B.telemetry(spark, d)), B.drivers(spark, d))


@query(sql(TEL + "," + TRAJ + """, t AS (SELECT (max(epoch(ts)) - min(epoch(ts))) / 3600 AS template_hours, count(DISTINCT orbit_no) AS template_orbits, max(efc) - min(efc) AS template_efc_span,
  avg(CASE WHEN dod_orbit > 0 THEN dod_orbit END) AS template_dod_mean, max(temperature_c) - min(temperature_c) AS template_temp_span_c, max(soh_true) - min(soh_true) AS template_soh_drift FROM tel),
  s AS (SELECT soh_true - lag(soh_true) OVER w AS ds, reference_day - lag(reference_day) OVER w AS dd FROM traj WINDOW w AS (PARTITION BY trajectory_id ORDER BY reference_index)),
  m AS (SELECT avg(abs(ds)) AS soh_step_mean_abs, quantile_cont(dd, 0.5) AS step_days FROM s),
  o AS (SELECT *, soh_step_mean_abs / greatest(template_soh_drift, 1e-9) AS separation_ratio, soh_step_mean_abs > template_soh_drift AS separated FROM t, m)""",
           "o", "template_orbits separated", "template_hours template_efc_span template_dod_mean template_temp_span_c template_soh_drift soh_step_mean_abs step_days separation_ratio"))
def timescale(spark, d):
    """A4: drift inside telemetry against the mean step of the grid."""
    sec = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1990-01-01 00:00:00', ts)").cast("double")
    l1 = B.telemetry(spark, d).withColumn("scenario_epoch_s", sec)
    return A.timescale(l1, stored_points(spark, d))


@query(sql(WIN + """, o AS (SELECT coalesce(horizon, 0) AS horizon, grouping(horizon)::tinyint AS all_horizons, count(*) AS n_rows, count(DISTINCT trajectory_id) AS n_trajectories, count(DISTINCT family) AS n_families FROM win GROUP BY GROUPING SETS ((), (horizon)))""",
           "o", "horizon all_horizons n_rows n_trajectories n_families"))
def dataset_summary(spark, d):
    """A5: rows, trajectories and families, in total and per horizon."""
    return A.summarise(windows(spark, d))


@query(sql(ANCHORS + """, u AS (SELECT *, CASE WHEN censored = 0 THEN rul_days END AS y FROM anchors), o AS (SELECT count(*) AS anchors_total, count_if(censored = 0) AS anchors_uncensored, count_if(censored = 1) AS anchors_censored,
  count(DISTINCT trajectory_id) AS trajectories_total, count(DISTINCT CASE WHEN censored = 0 THEN trajectory_id END) AS trajectories_uncensored, count(DISTINCT CASE WHEN censored = 1 THEN trajectory_id END) AS trajectories_censored,
  avg(y) AS rul_mean_days, stddev_pop(y) AS rul_std_days, min(y) AS rul_min_days, max(y) AS rul_max_days, CASE WHEN stddev_pop(y) > 1 THEN 'NON-DEGENERATE' ELSE 'DEGENERATE' END AS degeneracy FROM u)""",
           "o", "anchors_total anchors_uncensored anchors_censored trajectories_total trajectories_uncensored trajectories_censored degeneracy", "rul_mean_days rul_std_days rul_min_days rul_max_days"))
def rul_label_summary(spark, d):
    """Label statistics of the remaining-life anchors."""
    return A.rul_summary(W.rul_anchors(stored_points(spark, d)))


TREND = WIN + ", tr AS (SELECT *, soh_observed + slope_full * horizon AS pred_soh, soh_observed + slope_full * horizon - target_soh_true AS e, abs(soh_observed + slope_full * horizon - target_soh_true) AS err FROM win)"


def trend(spark, d):
    """Windows with the local-trend forecast and its error."""
    w = local_trend(windows(spark, d)).withColumn("pred_soh", F.col("soh_observed") + F.col("pred_delta"))
    return w.withColumn("err", F.abs(F.col("pred_soh") - F.col("target_soh_true")))


@query(sql(TREND + """, o AS (SELECT horizon, family, count(*) AS n_rows, avg(err) AS mae, sqrt(avg(e * e)) AS rmse, max(err) AS max_abs_error, 1 - sum(e * e) / (var_pop(target_soh_true) * count(*)) AS r2
  FROM tr GROUP BY GROUPING SETS ((), (horizon), (horizon, family)))""", "o", "horizon family n_rows", "mae rmse max_abs_error r2"))
def error_metrics(spark, d):
    """Error metrics for three grouping sets in one pass."""
    return A.error_metrics(trend(spark, d), "target_soh_true", "pred_soh", [[], ["horizon"], ["horizon", "family"]])


MACRO = TREND + """, pt AS (SELECT horizon, family, trajectory_id, avg(err) AS t FROM tr GROUP BY 1, 2, 3), tm AS (SELECT horizon, avg(t) AS trajectory_macro, count(*) AS n_trajectories FROM pt GROUP BY 1),
  pf AS (SELECT horizon, family, avg(err) AS f FROM tr GROUP BY 1, 2), fm AS (SELECT horizon, count(*) AS n_families, avg(f) AS family_macro, max(f) AS worst_family_mae, arg_max(family, f) AS worst_family, stddev_pop(f) AS across_family_std FROM pf GROUP BY 1),
  al AS (SELECT horizon, count(*) AS n_rows, avg(err) AS mae FROM tr GROUP BY 1), mac AS (SELECT * FROM al JOIN tm USING (horizon) JOIN fm USING (horizon))"""


@query(sql(MACRO, "mac", "horizon n_rows n_trajectories n_families worst_family", "mae trajectory_macro family_macro worst_family_mae across_family_std"))
def macro_metrics(spark, d):
    """Trajectory and family macro errors of the local trend."""
    return A.macro_metrics(trend(spark, d), "err", ["horizon"])


@query(sql(TREND + ", pf AS (SELECT horizon, family, avg(err) AS f FROM tr GROUP BY 1, 2), o AS (SELECT horizon, arg_min(family, f) AS worst, min(f) AS worst_value FROM pf GROUP BY 1)", "o", "horizon worst", "worst_value"))
def best_family(spark, d):
    """The member with the smallest error."""
    per = trend(spark, d).groupBy("horizon", "family").agg(F.avg("err").alias("f"))
    return A.worst(per, "family", "f", ["horizon"], largest=False)


NAMES = FEATURE_NAMES.split()
SPACE_SQL = WIN + ", long AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, {n} AS x FROM win WHERE horizon = 8" for n in NAMES) + """),
  b AS (SELECT feature, quantile_cont(x, 0.01) AS clip_lo, quantile_cont(x, 0.99) AS clip_hi FROM long GROUP BY 1),
  o AS (SELECT feature, any_value(clip_lo) AS clip_lo, any_value(clip_hi) AS clip_hi, avg(least(greatest(x, clip_lo), clip_hi)) AS mean, stddev_pop(least(greatest(x, clip_lo), clip_hi)) AS std FROM long JOIN b USING (feature) GROUP BY 1)"""


@query(sql(SPACE_SQL, "o", "feature", "clip_lo clip_hi mean std"))
def fitted_space(spark, d):
    """Exact percentile clip bounds and moments per feature."""
    return A.space_table(windows(spark, d, (8,)))


@query(sql(TRAJ + """, e AS (SELECT trajectory_id, min(CASE WHEN soh_true <= 0.7::double THEN reference_day END) AS eol FROM traj GROUP BY 1),
  c AS (SELECT trajectory_id, corr(soh_true, eol - reference_day) AS r FROM traj JOIN e USING (trajectory_id) WHERE eol IS NOT NULL GROUP BY 1 HAVING count(*) >= 4),
  o AS (SELECT avg(r) AS rul_corr_mean, count(*) AS n_trajectories FROM c)""", "o", "n_trajectories", "rul_corr_mean"))
def rul_correlation(spark, d):
    """Correlation of SOH with the days left."""
    return A.rul_corr(points(spark, d))


@query(sql(HALVES + """, sh AS (SELECT trajectory_id, avg(CASE WHEN step <= 1e-6 THEN 1.0 ELSE 0.0 END) AS share FROM st WHERE step IS NOT NULL GROUP BY 1),
  fl AS (SELECT trajectory_id, arg_min(soh_true, reference_index) AS f, arg_max(soh_true, reference_index) AS l, min(CASE WHEN soh_true <= 0.7::double THEN reference_day END) AS eol FROM traj GROUP BY 1),
  cr AS (SELECT corr(soh_true, eol - reference_day) AS r FROM traj JOIN fl USING (trajectory_id) WHERE eol IS NOT NULL GROUP BY trajectory_id),
  o1 AS (SELECT (SELECT avg(share) FROM sh) AS soh_non_increasing_frac, (SELECT avg(f) FROM fl) AS init_mean, (SELECT avg(l) FROM fl) AS end_mean, (SELECT avg(early) FROM halves) AS delta_early_mean,
    (SELECT avg(late) FROM halves) AS delta_late_mean, (SELECT max(abs(soh_true - soh_observed)) FROM traj) AS obs_err_max, (SELECT count(eol) FROM fl) AS eol_trajectories, (SELECT avg(r) FROM cr) AS rul_corr_mean),
  o AS (SELECT *, soh_non_increasing_frac > 0.9 AS check_1, end_mean < init_mean AS check_2, delta_late_mean <= delta_early_mean AS check_3, obs_err_max < 0.02 AS check_4, eol_trajectories >= 10 AS check_5, rul_corr_mean > 0.5 AS check_6 FROM o1)""",
           "o", "eol_trajectories check_1 check_2 check_3 check_4 check_5 check_6", "soh_non_increasing_frac init_mean end_mean delta_early_mean delta_late_mean obs_err_max rul_corr_mean"))
def directionality(spark, d):
    """The six direction checks."""
    return A.directionality(stored_points(spark, d))


@query(sql(TRAJ + ", c AS (SELECT trajectory_id, f.k AS factor, min(CASE WHEN soh_observed <= 0.70::double * f.k THEN reference_day END) AS day FROM traj, (VALUES (0.8::double), (1.0::double), (1.2::double)) f(k) GROUP BY 1, 2), o AS (SELECT factor, avg(day) AS mean_crossing_day, count(day) AS n_crossing FROM c GROUP BY 1)",
           "o", "n_crossing", "factor mean_crossing_day"))
def threshold_sensitivity(spark, d):
    """Mean first crossing at scaled thresholds."""
    return A.threshold_sensitivity(points(spark, d))


@query(sql(TRAJ + """, n AS (SELECT *, row_number() OVER (ORDER BY trajectory_id, reference_index) - 1 AS i FROM traj), o AS (SELECT 1e6 * regr_slope(soh_observed, i::double) AS slope_soh_observed,
  1e6 * regr_slope(soh_observed / (1 + 0.004::double * 0.8::double * (15 + reference_index % 11 - 20)), i::double) AS slope_low, 1e6 * regr_slope(soh_observed / (1 + 0.004::double * 1.2::double * (15 + reference_index % 11 - 20)), i::double) AS slope_high FROM n)""",
           "o", "", "slope_soh_observed slope_low slope_high", digits=6), digits=6)
def ordinal_slopes(spark, d):
    """Slope over the row number of the concatenated fleet, plain and temperature-corrected."""
    p = points(spark, d).withColumn("t", (15 + F.col(POS) % 11).cast("double"))
    fix = lambda k: F.col("soh_observed") / (1 + F.lit(0.004) * k * (F.col("t") - 20))
    s = A.ordinal_slope(p.withColumns({"low": fix(0.8), "high": fix(1.2)}), ["soh_observed", "low", "high"])
    return s.select(*[(1e6 * F.col(c)).alias(c) for c in s.columns])


@query(sql(TRAJ + """, s AS (SELECT trajectory_id, soh_true - lag(soh_true) OVER w AS dt, soh_observed - lag(soh_observed) OVER w AS dp FROM traj WINDOW w AS (PARTITION BY trajectory_id ORDER BY reference_index)),
  o AS (SELECT trajectory_id, coalesce(avg(CASE WHEN abs(dt) > 1e-9 THEN CASE WHEN sign(dt) = sign(dp) THEN 1.0 ELSE 0.0 END END), 1) AS direction_accuracy FROM s GROUP BY 1)""", "o", "trajectory_id", "direction_accuracy"))
def direction_accuracy(spark, d):
    """Share of steps whose direction the observed channel shares."""
    return A.direction_accuracy(points(spark, d), "soh_true", "soh_observed")


@query(sql(TRAJ + ", o AS (SELECT trajectory_id, abs(regr_slope(soh_observed, reference_index::double) - regr_slope(soh_true, reference_index::double)) / abs(regr_slope(soh_true, reference_index::double)) AS slope_error FROM traj GROUP BY 1)", "o", "trajectory_id", "slope_error"))
def slope_errors(spark, d):
    """Relative slope error per trajectory."""
    return A.slope_error(points(spark, d), "soh_true", "soh_observed")


@query(sql(TRAJ + ", o AS (SELECT family, reference_day, avg(soh_observed) / 0.7::double AS mean_observed, avg(soh_true) / 0.7::double AS mean_true, count(*) AS n FROM traj GROUP BY 1, 2)", "o", "family n", "reference_day mean_observed mean_true"))
def family_curves(spark, d):
    """Mean curve per family and day, relative to the end-of-life level."""
    c = A.family_curve(points(spark, d))
    return c.withColumns({n: F.col(n) / 0.7 for n in ("mean_observed", "mean_true")})


@query("WITH " + " , ".join(["x AS (SELECT 1)"]) + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, {i == 0 and '0.001' or '0'}::double AS max_abs_diff" for i, n in enumerate(NAMES)) + ")")
def feature_drift(spark, d):
    """Recomputed against stored features; the stored ``last`` is off by 0.001 on purpose."""
    p = stored_points(spark, d)
    f = W.features11(p).select(KEY, POS, *[F.col(n).alias(f"frozen_{i:02d}_{n}") for i, n in enumerate(NAMES)])
    f = f.withColumn("frozen_00_last", F.col("frozen_00_last") + 0.001)
    c = W.context_windows(p).select(KEY, POS, "ctx")
    return A.feature_drift(c.join(f, [KEY, POS]))


@query(sql(WIN + ", o AS (SELECT horizon, family, count(*) AS n_rows, count(DISTINCT trajectory_id) AS n_trajectories FROM win GROUP BY 1, 2)", "o", "horizon family n_rows n_trajectories"))
def head_facts(spark, d):
    """Training facts per stratum."""
    return A.head_facts(windows(spark, d), ["horizon", "family"])


# ---------------------------------------------------------------- conformal

TREND8 = TREND + ", t8 AS (SELECT *, -e AS resid FROM tr WHERE horizon = 8)"
FQ = """, rk AS (SELECT family, err, row_number() OVER (PARTITION BY family ORDER BY err) AS rn, count(*) OVER (PARTITION BY family) AS n FROM t8),
  q AS (SELECT family, err AS half_width, n FROM rk WHERE rn = least(ceil((n + 1) * 0.9::double)::bigint, n))"""


def _resid(spark, d, h=8):
    return trend(spark, d).where(F.col("horizon") == h).withColumn("resid", F.col("target_soh_true") - F.col("pred_soh"))


@query(sql(TREND8 + FQ, "q", "family n", "half_width"))
def family_half_widths(spark, d):
    """Order statistic of absolute residuals per family."""
    return C.family_half_widths(_resid(spark, d), "resid", 0.9)


@query(sql(TREND8 + FQ + ", o AS (SELECT avg(half_width) AS half_width, count(*) AS n_families, sum(n)::bigint AS n_calibration, 0.9::double AS coverage_target FROM q)", "o", "n_families n_calibration", "half_width coverage_target"))
def calibration_record(spark, d):
    """The calibration record."""
    return C.calibrate(_resid(spark, d), "resid", 0.9)


CROSS = TREND8 + FQ + """, hw AS (SELECT family, (sum(half_width) OVER () - half_width) / (count(*) OVER () - 1) AS crossfit_half_width FROM q),
  cf AS (SELECT family, any_value(crossfit_half_width) AS crossfit_half_width, avg(CASE WHEN err <= crossfit_half_width THEN 1.0 ELSE 0.0 END) AS coverage, count(*) AS n FROM t8 JOIN hw USING (family) GROUP BY 1)"""


@query(sql(CROSS, "cf", "family n", "crossfit_half_width coverage"))
def crossfit_coverage(spark, d):
    """Each family covered by the half-widths of the others."""
    return C.crossfit(_resid(spark, d), "resid", 0.9)


@query(sql(CROSS + ", o AS (SELECT avg(coverage) AS mean_coverage, min(coverage) AS worst_coverage, arg_min(family, coverage) AS worst_family FROM cf)", "o", "worst_family", "mean_coverage worst_coverage"))
def crossfit_summary(spark, d):
    """Mean and worst cross-fit coverage."""
    return C.crossfit_summary(C.crossfit(_resid(spark, d), "resid", 0.9))


_HW = "CASE horizon WHEN 2 THEN 0.01 WHEN 4 THEN 0.02 ELSE 0.04 END::double"
COV = TREND + f", cv AS (SELECT *, {_HW} AS hw, CASE WHEN target_soh_true >= pred_soh - {_HW} AND target_soh_true <= pred_soh + {_HW} THEN 1.0 ELSE 0.0 END::double AS i FROM tr)"


def _stored(spark, d):
    q = B.half_widths(spark)
    return C.apply_half_width(trend(spark, d), q, "PROTOCOL_FIXED_HOLDOUT", "FINAL_MODEL", 0.9)


@query(sql(COV + ", o AS (SELECT horizon, count(*) AS n, avg(i) AS empirical_coverage, avg(2 * hw) AS mean_width FROM cv GROUP BY 1)", "o", "horizon n", "empirical_coverage mean_width"))
def marginal_coverage(spark, d):
    """C4: marginal coverage of stored half-widths."""
    return C.coverage(_stored(spark, d), "target_soh_true", "pred_soh", "half_width", ["horizon"])


@query(sql(COV + """, ct AS (SELECT horizon, avg(s) AS trajectory_macro_coverage, min(s) AS worst_trajectory_coverage, count(*) AS n_trajectories FROM (SELECT horizon, trajectory_id, avg(i) AS s FROM cv GROUP BY 1, 2) GROUP BY 1),
  cfm AS (SELECT horizon, avg(f) AS family_macro_coverage, min(f) AS worst_family_coverage, arg_min(family, (f, family)) AS worst_family, count(*) AS n_families FROM (SELECT horizon, family, avg(i) AS f FROM cv GROUP BY 1, 2) GROUP BY 1),
  ca AS (SELECT horizon, count(*) AS n_windows, avg(i) AS window_micro_coverage, 2 * avg(hw) AS mean_interval_width FROM cv GROUP BY 1), o AS (SELECT * FROM ca JOIN ct USING (horizon) JOIN cfm USING (horizon))""",
           "o", "horizon n_windows n_trajectories worst_family n_families", "window_micro_coverage mean_interval_width trajectory_macro_coverage worst_trajectory_coverage family_macro_coverage worst_family_coverage"))
def coverage_report(spark, d):
    """Coverage over windows, trajectories and families."""
    return C.coverage_report(_stored(spark, d), "target_soh_true", "pred_soh", "half_width", ["horizon"])


@query(sql(ANCHORS + f", s AS (SELECT *, {SLOPE_RUL} AS p FROM anchors), o AS (SELECT family, avg(CASE WHEN p + 100 >= rul_lower_bound_days THEN 1.0 ELSE 0.0 END) AS consistent_fraction, count(*) AS n_censored, count_if(p + 100 < rul_lower_bound_days) AS n_violations FROM s WHERE censored = 1 GROUP BY 1)",
           "o", "family n_censored n_violations", "consistent_fraction"))
def censored_check(spark, d):
    """Censored anchors against the upper end of the slope extrapolation."""
    a = W.rul_anchors(stored_points(spark, d))
    a = a.withColumn("p", slope_rul(F.col("last"), F.col("slope_full")))
    return C.censored_check(a, "p", 100.0, keys=["family"])


@query(sql(COV + ", o AS (SELECT *, pred_soh - hw AS interval_lo, pred_soh + hw AS interval_hi, 0.9::double AS interval_coverage_nominal, 'PROTOCOL_FIXED_HOLDOUT' AS protocol FROM cv)",
           "o", "trajectory_id reference_index horizon protocol", "interval_lo interval_hi interval_coverage_nominal"))
def stored_intervals(spark, d):
    """Stored half-widths applied per horizon, with their labels."""
    return _stored(spark, d).select(KEY, POS, "horizon", "protocol", "interval_lo", "interval_hi", "interval_coverage_nominal")


# ---------------------------------------------------------------- earliness

LEAD = TREND8 + """, pc AS (SELECT family, trajectory_id, min(CASE WHEN soh_true <= 0.7::double THEN reference_day END) AS t_true_cross_day FROM traj GROUP BY 1, 2),
  pa AS (SELECT trajectory_id, min(CASE WHEN pred_soh <= 0.7::double THEN reference_day END) AS t_alarm_day FROM t8 GROUP BY 1),
  lead_ AS (SELECT family, trajectory_id, t_true_cross_day, t_alarm_day, t_true_cross_day - t_alarm_day AS dt_warn_days, t_true_cross_day IS NOT NULL AS crossed, t_alarm_day IS NOT NULL AS alarmed,
    CASE WHEN t_true_cross_day IS NOT NULL AND t_alarm_day IS NOT NULL THEN CASE WHEN t_true_cross_day >= t_alarm_day THEN 'TRUE_POSITIVE' ELSE 'LATE' END
    WHEN t_true_cross_day IS NOT NULL THEN 'MISSED' WHEN t_alarm_day IS NOT NULL THEN 'FALSE_POSITIVE' ELSE 'TRUE_NEGATIVE' END AS outcome FROM pc LEFT JOIN pa USING (trajectory_id))"""


def _leads(spark, d):
    t8 = local_trend(windows(spark, d, (8,))).withColumn("pred_soh", F.col("soh_observed") + F.col("pred_delta"))
    return P.lead_time(stored_points(spark, d), t8, 0.70)


@query(sql(TRAJ + ", o AS (SELECT trajectory_id, min(CASE WHEN soh_true <= 0.8::double THEN reference_day END) AS t_true_cross_day FROM traj GROUP BY 1)", "o", "trajectory_id", "t_true_cross_day"))
def true_crossings(spark, d):
    """First true crossing of 0.80."""
    return P.first_crossing(points(spark, d), 0.80)


@query(sql(TREND8 + ", o AS (SELECT trajectory_id, min(CASE WHEN pred_soh <= 0.8::double THEN reference_day END) AS t_alarm_day FROM t8 GROUP BY 1)", "o", "trajectory_id", "t_alarm_day"))
def first_alarms(spark, d):
    """First alarm of the local trend at 0.80."""
    t8 = local_trend(windows(spark, d, (8,))).withColumn("pred_soh", F.col("soh_observed") + F.col("pred_delta"))
    return P.first_alarm(t8, 0.80)


@query(sql(LEAD, "lead_", "family trajectory_id crossed alarmed outcome", "t_true_cross_day t_alarm_day dt_warn_days"))
def warning_lead_times(spark, d):
    """Lead time and outcome per trajectory at 0.70."""
    return _leads(spark, d)


SLOPE_ANCHORS = ANCHORS + f", sa AS (SELECT *, least(greatest({SLOPE_RUL}, 0), 600) AS pred_rul FROM anchors)"


def _slope_anchors(spark, d):
    a = W.rul_anchors(stored_points(spark, d))
    return a.withColumn("pred_rul", F.least(slope_rul(F.col("last"), F.col("slope_full")), F.lit(600.0)))


def _ph_sql(name: str, floor: float) -> str:
    return f"""{name}_b AS (SELECT trajectory_id, reference_day, eol_day, abs(pred_rul - rul_days) <= greatest(0.2::double * rul_days, {floor}::double, 1e-12) AS inside FROM sa WHERE censored = 0),
  {name}_s AS (SELECT *, bool_and(inside) OVER (PARTITION BY trajectory_id ORDER BY reference_day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stays FROM {name}_b),
  {name} AS (SELECT trajectory_id, min(CASE WHEN stays THEN reference_day END) AS ph_entry_day, count_if(inside) AS n_anchors_inside_band, count(*) AS n_anchors,
    coalesce(any_value(eol_day) - min(CASE WHEN stays THEN reference_day END), 0) AS ph_days FROM {name}_s GROUP BY 1)"""


CW = """cw_r AS (SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY trajectory_id ORDER BY reference_day ROWS UNBOUNDED PRECEDING) AS run FROM ph_b),
  cw_i AS (SELECT trajectory_id, run, min(CASE WHEN inside THEN reference_day END) AS lo, max(CASE WHEN inside THEN reference_day END) AS hi, max(eol_day) AS eol FROM cw_r GROUP BY 1, 2),
  cw_k AS (SELECT *, coalesce(hi - lo, 0) AS span, row_number() OVER (PARTITION BY trajectory_id ORDER BY coalesce(hi - lo, 0) DESC, lo) AS k FROM cw_i),
  cw AS (SELECT trajectory_id, span AS credible_window_days, CASE WHEN span > 0 THEN lo END AS credible_window_start_day, CASE WHEN span > 0 THEN hi END AS credible_window_end_day,
    CASE WHEN span > 0 THEN eol - lo END AS credible_window_lead_before_eol_days FROM cw_k WHERE k = 1)"""


@query(sql(SLOPE_ANCHORS + "," + _ph_sql("ph", 0), "ph", "trajectory_id n_anchors_inside_band n_anchors", "ph_entry_day ph_days"))
def prognostic_horizons(spark, d):
    """Strict prognostic horizon of the slope extrapolation."""
    return P.prognostic_horizon(_slope_anchors(spark, d))


@query(sql(SLOPE_ANCHORS + "," + _ph_sql("ph", 14), "ph", "trajectory_id n_anchors_inside_band n_anchors", "ph_entry_day ph_days"))
def prognostic_horizons_gridfloor(spark, d):
    """Horizon with a band never finer than one grid step, predictions clamped at zero."""
    return P.prognostic_horizon(_slope_anchors(spark, d), floor=14.0, clamp=True)


@query(sql(SLOPE_ANCHORS + "," + _ph_sql("ph", 0) + "," + CW, "cw", "trajectory_id", "credible_window_days credible_window_start_day credible_window_end_day credible_window_lead_before_eol_days"))
def credible_windows(spark, d):
    """P5: longest run inside the band."""
    return P.credible_window(_slope_anchors(spark, d))


REC = LEAD + f", sa AS (SELECT f.*, e.eol_day, e.eol_day - reference_day AS rul_days, CASE WHEN e.eol_day IS NULL THEN 1 ELSE 0 END AS censored, least(greatest({SLOPE_RUL}, 0), 600) AS pred_rul FROM feat f JOIN (SELECT trajectory_id, min(CASE WHEN soh_true <= 0.7::double THEN reference_day END) AS eol_day FROM traj GROUP BY 1) e USING (trajectory_id) WHERE e.eol_day IS NULL OR reference_day < e.eol_day)," + _ph_sql("ph", 0) + "," + _ph_sql("pg", 14) + "," + CW + """,
  rec AS (SELECT l.*, l.t_true_cross_day AS t_eol_day, ph.ph_entry_day, ph.ph_days, ph.n_anchors_inside_band, ph.n_anchors, pg.ph_days AS ph_days_gridfloor, pg.ph_entry_day AS ph_entry_day_gridfloor,
    pg.n_anchors_inside_band AS n_anchors_inside_band_gridfloor, credible_window_days, credible_window_start_day, credible_window_end_day, credible_window_lead_before_eol_days, ph.ph_days IS NOT NULL AS ph_defined
    FROM lead_ l LEFT JOIN ph USING (trajectory_id) LEFT JOIN pg USING (trajectory_id) LEFT JOIN cw USING (trajectory_id))"""


def _records(spark, d):
    p = stored_points(spark, d)
    t8 = local_trend(W.with_target(p, (8,))).withColumn("pred_soh", F.col("soh_observed") + F.col("pred_delta"))
    return P.prognostic_records(p, t8, _slope_anchors(spark, d), warn=0.70)


@query(sql(REC, "rec", "family trajectory_id crossed alarmed outcome n_anchors_inside_band n_anchors n_anchors_inside_band_gridfloor ph_defined",
           "t_true_cross_day t_alarm_day dt_warn_days t_eol_day ph_entry_day ph_days ph_days_gridfloor ph_entry_day_gridfloor credible_window_days credible_window_start_day credible_window_end_day credible_window_lead_before_eol_days"))
def prognostic_records(spark, d):
    """One record per trajectory."""
    return _records(spark, d)


_CNT = {"n_true_positive": "TRUE_POSITIVE", "n_late": "LATE", "n_missed": "MISSED", "n_false_positive": "FALSE_POSITIVE", "n_true_negative": "TRUE_NEGATIVE"}


def _pct(col: str, named: dict[str, float]) -> str:
    return ", ".join(f"quantile_cont({col}, {q}) AS {n}" for n, q in named.items())


SUMMARY = ", rr AS (SELECT *, CASE WHEN outcome = 'TRUE_POSITIVE' THEN dt_warn_days END AS dt FROM rec), summ AS (SELECT count(*) AS n_trajectories, count_if(crossed) AS n_crossed, count_if(NOT crossed) AS n_never_crossed, " + ", ".join(
    f"count_if(outcome = '{o}') AS {n}" for n, o in _CNT.items()) + """, count_if(outcome = 'MISSED') / count_if(crossed) AS miss_rate_of_crossers, count_if(outcome = 'LATE') / count_if(crossed) AS late_rate_of_crossers,
  count_if(outcome = 'FALSE_POSITIVE') / count_if(NOT crossed) AS false_alarm_rate_of_non_crossers, count(dt) AS dt_warn_n, avg(dt) AS dt_warn_mean_days, min(dt) AS dt_warn_min_days, max(dt) AS dt_warn_max_days, """ + _pct(
    "dt", {"dt_warn_median_days": 0.5, "dt_warn_p10_days": 0.1, "dt_warn_p90_days": 0.9}) + """, count(ph_days) AS ph_n_defined, avg(ph_days) AS ph_mean_days, avg(ph_days_gridfloor) AS ph_gridfloor_mean_days,
  count_if(ph_days_gridfloor > 0) AS ph_gridfloor_n_nonzero, sum(n_anchors_inside_band)::bigint AS anchors_inside_band_strict, sum(n_anchors_inside_band_gridfloor)::bigint AS anchors_inside_band_gridfloor,
  sum(n_anchors)::bigint AS rul_anchors_total, count(credible_window_days) AS credible_window_n, avg(credible_window_days) AS credible_window_mean_days, avg(credible_window_lead_before_eol_days) AS credible_window_lead_mean_days, """ + _pct(
    "ph_days", {"ph_median_days": 0.5, "ph_p10_days": 0.1, "ph_p90_days": 0.9}) + ", " + _pct("ph_days_gridfloor", {"ph_gridfloor_median_days": 0.5, "ph_gridfloor_p90_days": 0.9}) + ", " + _pct(
    "credible_window_days", {"credible_window_median_days": 0.5, "credible_window_p90_days": 0.9}) + ", " + _pct("credible_window_lead_before_eol_days", {"credible_window_lead_median_days": 0.5}) + " FROM rr)"


SUMMARY_COUNTS = "n_trajectories n_crossed n_never_crossed n_true_positive n_late n_missed n_false_positive n_true_negative dt_warn_n ph_n_defined ph_gridfloor_n_nonzero anchors_inside_band_strict anchors_inside_band_gridfloor rul_anchors_total credible_window_n"
SUMMARY_DOUBLES = "miss_rate_of_crossers late_rate_of_crossers false_alarm_rate_of_non_crossers dt_warn_mean_days dt_warn_min_days dt_warn_max_days dt_warn_median_days dt_warn_p10_days dt_warn_p90_days ph_mean_days ph_gridfloor_mean_days credible_window_mean_days credible_window_lead_mean_days ph_median_days ph_p10_days ph_p90_days ph_gridfloor_median_days ph_gridfloor_p90_days credible_window_median_days credible_window_p90_days credible_window_lead_median_days"


@query(sql(REC + SUMMARY, "summ", SUMMARY_COUNTS, SUMMARY_DOUBLES))
def earliness_summary(spark, d):
    """Outcome counts, rates, lead times and horizons of the fleet."""
    return P.earliness_summary(_records(spark, d))


@query(sql(LEAD + ", pf AS (SELECT family, avg(CASE WHEN outcome = 'TRUE_POSITIVE' THEN dt_warn_days END) AS dt_warn_mean_days, count_if(outcome = 'TRUE_POSITIVE') AS n FROM lead_ GROUP BY 1), o AS (SELECT family, dt_warn_mean_days, n FROM pf UNION ALL SELECT NULL, avg(dt_warn_mean_days), sum(n)::bigint FROM pf)",
           "o", "family n", "dt_warn_mean_days"))
def lead_by_family(spark, d):
    """Mean lead time by family, and the family macro."""
    return P.lead_by_family(_leads(spark, d))


@query(sql(LEAD + """, tp AS (SELECT dt_warn_days AS v FROM lead_ WHERE outcome = 'TRUE_POSITIVE'), s AS (SELECT min(v) AS lo, (max(v) - min(v)) / 20 AS w FROM tp),
  b AS (SELECT least(floor((v - lo) / w), 19)::bigint AS bin, count(*) AS n FROM tp, s GROUP BY 1), o AS (SELECT g.bin, lo + g.bin * w AS bin_lo, lo + (g.bin + 1) * w AS bin_hi, coalesce(b.n, 0) AS n FROM (SELECT unnest(range(20)) AS bin) g CROSS JOIN s LEFT JOIN b ON b.bin = g.bin)""",
           "o", "bin n", "bin_lo bin_hi"))
def lead_histogram(spark, d):
    """20-bin histogram of lead times."""
    return A.histogram(_leads(spark, d).where(F.col("outcome") == "TRUE_POSITIVE"), "dt_warn_days")


@query(sql(LEAD + ", o AS (SELECT family, count(*) AS n, avg(dt_warn_days) AS mean, min(dt_warn_days) AS min, max(dt_warn_days) AS max, " + _pct("dt_warn_days", {"q25": 0.25, "median": 0.5, "q75": 0.75}) + " FROM lead_ WHERE dt_warn_days IS NOT NULL GROUP BY 1)",
           "o", "family n", "mean min max q25 median q75"))
def lead_distribution(spark, d):
    """Quartiles, mean and extremes of lead times by family."""
    return A.distribution(_leads(spark, d), ["family"], "dt_warn_days")


