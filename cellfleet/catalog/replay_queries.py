"""Degradation replay, scenario, fault and stream queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellfleet.catalog.contract_queries import CAL, DRIVERS, calendar_tables
from cellfleet.catalog.learning_queries import ALPHA_FIX, blocks_sql, ridge_sql
from cellfleet.catalog.registry import FEAT, TRAJ, Z2, Z_SQL, features_sql, points, query, sql, stored_points, target_sql, z_windows
from cellfleet.catalog.report_queries import TEL, TREND8
from cellfleet.functions.forecast import scale_drivers
from cellfleet.functions.space import apply_space
from cellfleet.operators import learning as L
from cellfleet.operators import replay as D
from cellfleet.operators import windows as W
from cellfleet.plans.scan import KEY, POS
from cellfleet.plans.small import cut, local_table
from cellfleet.sources import testbed as B
from cellfleet.streaming import alarms as AL
from cellfleet.streaming import jobs as R
from cellfleet.streaming import scores as SC

CASES_SQL = ", ".join(f"('{c}', {t}::double, {m}::double, {q}::double)" for c, t, m, q in D.CASES)
SCALED = DRIVERS + f""", cases(case_name, dt, dm, cm) AS (VALUES {CASES_SQL}),
sdrv AS (SELECT case_name, trajectory_id, family, split, reference_index, age_days, efc, mean_soc, mean_abs_beta_deg, mean_temp_c + dt AS mean_temp_c, max_temp_c + dt AS max_temp_c,
  least(greatest(dod * dm, 0), 1) AS dod, mean_c_rate * cm AS mean_c_rate FROM drv, cases)"""


def damage_sql(src: str, out: str, key: str, cal: float = 1.0, cyc: float = 1.0, knee: float = 1.0, off: float = 0.0, rint: float = 1.0) -> str:
    """Increments, accumulated loss and read-outs of one driver table."""
    return f"""{out}_i AS (SELECT d.*, p.* EXCLUDE (trajectory_id), CASE WHEN reference_index = 0 THEN 0 ELSE k_cal * (sqrt(age_days) - sqrt(coalesce(lag(age_days) OVER w, 0))) * exp(temperature_sensitivity * (max_temp_c - 25)) * (1 + beta_cal * mean_soc) END AS calendar_base,
  CASE WHEN reference_index = 0 THEN 0 ELSE k_cyc * (efc - coalesce(lag(efc) OVER w, 0)) * pow(dod, dod_exponent) * pow(mean_c_rate, crate_exponent) * exp(temperature_sensitivity * (mean_temp_c - 25)) * (1 + beta_cyc * mean_abs_beta_deg / 90) END AS cycle_base
  FROM {src} d JOIN par p USING (trajectory_id) WINDOW w AS (PARTITION BY {key} ORDER BY reference_index)),
{out}_r AS (SELECT *, sum({cal}::double * calendar_base + {cyc}::double * cycle_base) OVER (PARTITION BY {key} ORDER BY reference_index ROWS UNBOUNDED PRECEDING) AS raw_loss FROM {out}_i),
{out}_l AS (SELECT *, greatest(0, raw_loss + {knee}::double * knee_gain * greatest(0, raw_loss - (knee_start_loss + {off}::double))) AS total_loss FROM {out}_r),
{out} AS (SELECT *, least(greatest(1 - total_loss, 0), 1) AS soh_true, q0_ah * least(greatest(1 - total_loss, 0), 1) AS capacity_ah, initial_rint_ohm * (1 + {rint}::double * pow(total_loss, rint_exponent)) AS rint_ohm FROM {out}_l)"""


DAMAGE = DRIVERS + "," + damage_sql("drv", "dmgd", "trajectory_id")
TRUTH = D.ReplayConfig(0.95, 1.05, 0.9, -0.01, 1.1)


def _tables(spark, d):
    """Drivers as a stored table, and their parameters."""
    return cut(B.drivers(spark, d)), B.parameters(spark, d)


def _reference(drv, par):
    """Reference truth: the same replay under other global coefficients."""
    g = D.replay_damage(drv, par, TRUTH)
    return cut(g.select(KEY, "family", "split", POS, F.col("soh_true").alias("soh_true_reference"),
                        F.col("rint_ohm").alias("rint_ohm_reference")))


@query(sql(CAL + ", o AS (SELECT l.trajectory_id, l.reference_index, l.day_of_year, l.efc, mean_soc_cal AS mean_soc FROM l2 l LEFT JOIN cal USING (family, day_of_year))", "o", "trajectory_id reference_index day_of_year", "efc mean_soc"))
def prepared_drivers(spark, d):
    """Drivers split off a full reference table, with the calendar's charge level."""
    l2, cal = calendar_tables(spark, d)
    l2 = cut(l2.withColumns({"soh_true": F.lit(1.0), "rint_ohm": F.lit(0.05), "capacity_ah": F.lit(40.0)}))
    out, _, _ = D.prepare_drivers(l2, B.parameters(spark, d), cal, [KEY, POS, "day_of_year", "efc", "mean_soc"])
    return out


@query(sql(DAMAGE, "dmgd", "trajectory_id reference_index", "calendar_base cycle_base"))
def damage_increments(spark, d):
    """Calendar and cycling loss per step."""
    return D.damage_increments(*_tables(spark, d))


@query(sql(DAMAGE, "dmgd", "trajectory_id reference_index", "raw_loss soh_true capacity_ah rint_ohm"))
def damage_replay(spark, d):
    """D3: accumulated loss, SOH, capacity and resistance."""
    return D.replay_damage(*_tables(spark, d)).select(KEY, POS, "raw_loss", "soh_true", "capacity_ah", "rint_ohm")


REFD = DAMAGE + ", " + damage_sql("drv", "ref", "trajectory_id", 0.95, 1.05, 0.9, -0.01, 1.1)


@query(sql(REFD + """, j AS (SELECT a.family, a.split, a.split = 'test' AS held_out, b.soh_true AS t, a.soh_true AS p FROM dmgd a JOIN ref b USING (trajectory_id, reference_index)),
  o AS (SELECT held_out, split, family, count(*) AS n_rows, avg(abs(p - t)) AS mae, sqrt(avg((p - t) ** 2)) AS rmse, max(abs(p - t)) AS max_abs_error, 1 - sum((p - t) ** 2) / (var_pop(t) * count(*)) AS r2 FROM j GROUP BY GROUPING SETS ((), (held_out), (split, family)))""",
           "o", "held_out split family n_rows", "mae rmse max_abs_error r2"))
def replay_metrics(spark, d):
    """Replay errors against reference truth, by three grouping sets."""
    drv, par = _tables(spark, d)
    return D.replay_metrics(D.replay_damage(drv, par), _reference(drv, par))


SCEN = SCALED + "," + damage_sql("sdrv", "sc", "case_name, trajectory_id")
SCENF = SCEN + """, fin AS (SELECT case_name, trajectory_id, arg_max(soh_true, reference_index) AS final_soh FROM sc GROUP BY 1, 2),
  det AS (SELECT a.case_name, a.trajectory_id, b.final_soh AS baseline_final_soh, a.final_soh, a.final_soh - b.final_soh AS delta_soh FROM fin a JOIN fin b ON a.trajectory_id = b.trajectory_id AND b.case_name = 'baseline' WHERE a.case_name <> 'baseline')"""


@query(sql(SCENF + ', o AS (SELECT case_name AS "case", * EXCLUDE (case_name) FROM det)', "o", '"case" trajectory_id', "baseline_final_soh final_soh delta_soh"))
def scenario_detail(spark, d):
    """Final SOH of every trajectory under every stress case."""
    return D.compare_scenarios(*_tables(spark, d))[0]


@query(sql(SCENF + ', o AS (SELECT case_name AS "case", count(*) AS n_trajectories, avg(delta_soh) AS mean_final_soh_change, max(delta_soh) AS max_final_soh_change, count_if(delta_soh > 1e-12) AS n_direction_violations, count_if(delta_soh < -1e-8) AS n_strictly_faster FROM det GROUP BY 1)',
           "o", '"case" n_trajectories n_direction_violations n_strictly_faster', "mean_final_soh_change max_final_soh_change"))
def scenario_summary(spark, d):
    """Change of final SOH per stress case."""
    return D.compare_scenarios(*_tables(spark, d))[1]


HEADS8 = FEAT + "," + target_sql("feat", "win", (8,)) + ", zw AS (SELECT *, (last - 0.85::double) / 0.07::double AS z1, (slope_full + 0.005::double) / 0.0013::double AS z2 FROM win)"
_M = {"g11": "z1 * z1", "g12": "z1 * z2", "g22": "z2 * z2", "s1": "z1", "s2": "z2", "b1": "z1 * y_delta", "b2": "z2 * y_delta", "sy": "y_delta"}
HEADS8 += f""", hb_t AS (SELECT family, trajectory_id, count(*) AS n, {', '.join(f'sum({e}) / count(*) AS {c}' for c, e in _M.items())} FROM zw GROUP BY ALL),
  hb AS (SELECT family, sum(n)::bigint AS n, 1.0::double AS sw, {', '.join(f'sum({c}) / count(*) AS {c}' for c in _M)} FROM hb_t GROUP BY ALL),
  ho AS (SELECT a.family AS held, sum(b.n) AS n, sum(b.sw) AS sw, {', '.join(f'sum(b.{c}) AS {c}' for c in _M)} FROM hb a JOIN hb b ON a.family <> b.family GROUP BY 1),
  ha AS (SELECT *, g11 * n / sw + 10 AS a11, g12 * n / sw AS a12, g22 * n / sw + 10 AS a22, b1 * n / sw AS r1, b2 * n / sw AS r2 FROM ho),
  hc AS (SELECT *, (a22 * r1 - a12 * r2) / (a11 * a22 - a12 * a12) AS c0, (a11 * r2 - a12 * r1) / (a11 * a22 - a12 * a12) AS c1 FROM ha),
  heads AS (SELECT held, c0, c1, sy / sw - (s1 * c0 + s2 * c1) / sw AS c_b FROM hc)"""


NESTED8 = FEAT + "," + target_sql("feat", "win", (8,)) + f", zwin AS (SELECT *, {Z_SQL} FROM win)," + blocks_sql("zwin", "blk") + "," + ridge_sql(
    "zwin", "blk", "rh") + ", heads AS (SELECT held, c0, c1, c_b FROM rh)"


def _heads8(spark, d):
    z = cut(z_windows(spark, d, (8,)).select("horizon", "family", KEY, *Z2, "y_delta"))
    return L.fixed_heads(z, Z2, {8: ALPHA_FIX[8]}, per_family=True)


@query(sql(SCEN + ", gen AS (SELECT case_name, trajectory_id, family, reference_index, 14.0::double * reference_index AS reference_day, soh_true, soh_true AS soh_observed FROM sc)," + features_sql(
    "gen", "gf", key="case_name, trajectory_id") + "," + target_sql("gf", "gw", (8,), "case_name, trajectory_id") + "," + HEADS8 + """,
  gs AS (SELECT case_name, soh_observed + c_b + c0 * (last - 0.85::double) / 0.07::double + c1 * (slope_full + 0.005::double) / 0.0013::double - target_soh_true AS e FROM gw JOIN heads ON family = held),
  gr AS (SELECT case_name AS "case", count(*) AS n_windows, sqrt(avg(e * e)) AS rmse_soh FROM gs GROUP BY 1),
  o AS (SELECT *, (SELECT rmse_soh FROM gr WHERE "case" = 'baseline') AS baseline_rmse_soh, rmse_soh - (SELECT rmse_soh FROM gr WHERE "case" = 'baseline') AS delta_rmse FROM gr)""",
           "o", '"case" n_windows', "rmse_soh baseline_rmse_soh delta_rmse"))
def scenario_scores(spark, d):
    """Frozen out-of-family heads scored on every stress case."""
    drv, par = _tables(spark, d)
    gen = D.replay_damage(scale_drivers(drv, D.CASES), par)
    return D.score_scenarios(gen, _heads8(spark, d), Z2, B.SPACE2)


CAND = [(a, b, c, o) for a in (0.95, 1.0) for b in (1.0, 1.05) for c in (0.9, 1.0) for o in (-0.01, 0.0)]
CAND_SQL = ", ".join(f"({i}, {a}::double, {b}::double, {c}::double, {o}::double)" for i, (a, b, c, o) in enumerate(CAND))
GRID_SQL = REFD + f""", cand(cand, calendar_scale, cycle_scale, knee_scale, knee_offset) AS (VALUES {CAND_SQL}),
  cu AS (SELECT *, sum(calendar_base) OVER w AS cc, sum(cycle_base) OVER w AS cy FROM dmgd_i WINDOW w AS (PARTITION BY trajectory_id ORDER BY reference_index ROWS UNBOUNDED PRECEDING)),
  ge AS (SELECT cand.*, calendar_scale * cc + cycle_scale * cy AS raw, cu.knee_gain AS kg, cu.knee_start_loss AS ks, 1 - r.soh_true AS t FROM cu JOIN ref r USING (trajectory_id, reference_index), cand WHERE r.split <> 'test'),
  gg AS (SELECT cand, calendar_scale, cycle_scale, knee_scale, knee_offset, sum((raw + knee_scale * kg * greatest(0, raw - (ks + knee_offset)) - t) ** 2) AS sse, count(*) AS n_rows FROM ge GROUP BY ALL)"""


@query(sql(GRID_SQL, "gg", "cand n_rows", "calendar_scale cycle_scale knee_scale knee_offset sse"))
def calibration_grid(spark, d):
    """Squared error of every candidate on the fitting splits."""
    drv, par = _tables(spark, d)
    return D.calibrate_grid(drv, par, _reference(drv, par), CAND)


@query(sql(GRID_SQL + ", o AS (SELECT * FROM gg ORDER BY sse, cand LIMIT 1)", "o", "cand n_rows", "calendar_scale cycle_scale knee_scale knee_offset sse"))
def calibrated_coefficients(spark, d):
    """The winning candidate, which is the one the reference truth was made with."""
    drv, par = _tables(spark, d)
    return D.best_candidate(D.calibrate_grid(drv, par, _reference(drv, par), CAND))


@query(sql(REFD + ", x AS (SELECT pow(greatest(1 - soh_true, 0), rint_exponent) AS x, rint_ohm / initial_rint_ohm - 1 AS y FROM ref WHERE split <> 'test'), o AS (SELECT sum(x * y) / sum(x * x) AS rint_growth_scale, count(*) AS n_rows FROM x)", "o", "n_rows", "rint_growth_scale"))
def resistance_scale(spark, d):
    """Closed-form resistance growth scale."""
    drv, par = _tables(spark, d)
    return D.resistance_scale(_reference(drv, par), par)


# ---------------------------------------------------------------- faults

FAULT_ROWS = ", ".join(f"({i}, '{n}', {o}::double, {r}::double, {q}::double, {t}::double, {dd}::double)" for i, (n, o, r, q, t, dd) in enumerate(W.FAULTS))
ASSIGN = TRAJ + f""", fspec(b, fault_type, onset_fraction, rint_mult, q_factor, temp_bias, dod_depth) AS (VALUES {FAULT_ROWS}),
  fid AS (SELECT family, trajectory_id, (row_number() OVER (ORDER BY trajectory_id) - 1) // greatest(1, floor(count(*) OVER () * {D.FAULT_SHARE})::bigint) AS b FROM (SELECT DISTINCT family, trajectory_id FROM traj)),
  asg AS (SELECT family, trajectory_id, fspec.* EXCLUDE (b) FROM fid JOIN fspec USING (b))"""


def _acc(c: str) -> str:
    return f"""sum(CASE WHEN reference_index = k THEN {c} WHEN reference_index > k THEN CASE WHEN d_{c} < 0 THEN d_{c} * accel ELSE d_{c} END ELSE 0 END) OVER v"""


FAULT = ASSIGN + f""", fp0 AS (SELECT t.*, asg.* EXCLUDE (family, trajectory_id), count(*) OVER (PARTITION BY t.trajectory_id) AS n, soh_true - lag(soh_true) OVER w AS d_soh_true, soh_observed - lag(soh_observed) OVER w AS d_soh_observed
    FROM traj t JOIN asg ON t.trajectory_id = asg.trajectory_id WINDOW w AS (PARTITION BY t.trajectory_id ORDER BY reference_index)),
  fp1 AS (SELECT *, least(greatest(round_even(onset_fraction * (n - 1), 0)::bigint, 1), n - 2) AS k, 1 + 0.9::double * greatest(rint_mult - 1, 0) + 0.05::double * greatest(temp_bias, 0) + 0.15::double * greatest(dod_depth, 0) AS accel FROM fp0),
  fp2 AS (SELECT *, {_acc('soh_true')} AS r_t, {_acc('soh_observed')} AS r_o FROM fp1 WINDOW v AS (PARTITION BY trajectory_id ORDER BY reference_index ROWS UNBOUNDED PRECEDING)),
  fpts AS (SELECT *, k AS onset_index, least(greatest(CASE WHEN reference_index >= k THEN r_t * q_factor ELSE soh_true END, 0), 1.2::double) AS soh_true_faulted,
    least(greatest(CASE WHEN reference_index >= k THEN r_o * q_factor ELSE soh_observed END, 0), 1.2::double) AS soh_observed_faulted, CASE WHEN reference_index >= k THEN 1 ELSE 0 END AS post_onset,
    CASE WHEN reference_index >= k THEN rint_mult ELSE 1 END AS rint_multiplier, CASE WHEN reference_index >= k THEN temp_bias ELSE 0 END AS temperature_bias_c, CASE WHEN reference_index = k THEN dod_depth ELSE 0 END AS dod_event FROM fp2),
  frec AS (SELECT trajectory_id, family, fault_type, any_value(k) AS onset_index, max(CASE WHEN reference_index = k THEN reference_day END) AS onset_day, max(CASE WHEN reference_index = k THEN soh_true END) AS soh_at_onset,
    min(CASE WHEN soh_true <= 0.7::double THEN reference_day END) AS baseline_eol_day, min(CASE WHEN soh_true_faulted <= 0.7::double THEN reference_day END) AS faulted_eol_day,
    min(CASE WHEN soh_true <= 0.8::double THEN reference_day END) AS baseline_warn_day, min(CASE WHEN soh_true_faulted <= 0.8::double THEN reference_day END) AS faulted_warn_day, count(*) AS n_points FROM fpts GROUP BY 1, 2, 3),
  frecs AS (SELECT *, baseline_eol_day - faulted_eol_day AS eol_advance_days, baseline_warn_day - faulted_warn_day AS warn_advance_days FROM frec)"""


def _faulted(spark, d):
    p = stored_points(spark, d)
    return D.faulted(p, D.assign_faults(p))


@query(sql(ASSIGN, "asg", "family trajectory_id fault_type", "onset_fraction"))
def fault_assignment(spark, d):
    """Disjoint blocks of trajectories per fault class."""
    return D.assign_faults(stored_points(spark, d)).select("family", KEY, "fault_type", "onset_fraction")


@query(sql(FAULT, "fpts", "trajectory_id reference_index fault_type onset_index post_onset", "soh_true_faulted soh_observed_faulted rint_multiplier temperature_bias_c dod_event", digits=10), digits=10)
def faulted_points(spark, d):
    """Perturbed channels with their onset markers."""
    return _faulted(spark, d).select(KEY, POS, "fault_type", "onset_index", "post_onset", "soh_true_faulted",
                                     "soh_observed_faulted", "rint_multiplier", "temperature_bias_c", "dod_event")


_ADV = "onset_day soh_at_onset baseline_eol_day faulted_eol_day baseline_warn_day faulted_warn_day eol_advance_days warn_advance_days"


@query(sql(FAULT, "frecs", "trajectory_id family fault_type onset_index n_points", _ADV))
def fault_records(spark, d):
    """Onset and advanced crossings per perturbed trajectory."""
    return D.fault_records(_faulted(spark, d))


@query(sql(FAULT + """, fa AS (SELECT fault_type, count(*) AS n_trajectories, avg(onset_day) AS mean_onset_day, avg(eol_advance_days) AS mean_eol_advance_days, avg(warn_advance_days) AS mean_warn_advance_days FROM frecs GROUP BY 1),
  fb AS (SELECT fault_type, max(soh_true) - min(soh_true) AS baseline_span, max(soh_true_faulted) - min(soh_true_faulted) AS faulted_span, count_if(soh_true <= 0.7::double) AS below_eol_baseline, count_if(soh_true_faulted <= 0.7::double) AS below_eol_faulted,
    count_if(dod_event > 0) AS deep_discharge_events, count_if(temperature_bias_c > 0) AS thermal_bias_points, count_if(rint_multiplier > 1) AS elevated_rint_points FROM fpts GROUP BY 1), o AS (SELECT * FROM fa JOIN fb USING (fault_type))""",
           "o", "fault_type n_trajectories below_eol_baseline below_eol_faulted deep_discharge_events thermal_bias_points elevated_rint_points", "mean_onset_day mean_eol_advance_days mean_warn_advance_days baseline_span faulted_span"))
def fault_summary(spark, d):
    """What each fault class did to the fleet."""
    pts = cut(_faulted(spark, d))
    return D.fault_summary(pts, D.fault_records(pts))


FEVAL = FAULT + """, ch AS (SELECT 'baseline' AS channel, trajectory_id, family, fault_type, reference_index, reference_day, soh_observed, soh_true FROM fpts UNION ALL
    SELECT 'faulted', trajectory_id, family, fault_type, reference_index, reference_day, soh_observed_faulted, soh_true_faulted FROM fpts),""" + features_sql("ch", "cf", key="channel, trajectory_id") + "," + target_sql(
    "cf", "cw", (8,), "channel, trajectory_id") + "," + NESTED8.replace(TRAJ + ",", "", 1) + """,
  fs AS (SELECT w.*, soh_observed + c_b + c0 * (last - 0.85::double) / 0.07::double + c1 * (slope_full + 0.005::double) / 0.0013::double AS pred_soh FROM cw w JOIN heads ON family = held)"""


def _fault_scores(spark, d):
    win = D.fault_windows(_faulted(spark, d))
    z = cut(z_windows(spark, d, (8,)).select("horizon", "family", KEY, *Z2, "y_delta"))
    return cut(L.attach_heads(apply_space(win, B.SPACE2), L.lofo_fit(z, Z2), Z2).select(
        "channel", KEY, "fault_type", "reference_day", "pred_soh", "target_soh_true"))


@query(sql(FEVAL + """, o1 AS (SELECT fault_type, count_if(channel = 'faulted') AS n_rows, avg(CASE WHEN channel = 'baseline' THEN abs(pred_soh - target_soh_true) END) AS mae_absolute_soh_baseline, avg(CASE WHEN channel = 'faulted' THEN abs(pred_soh - target_soh_true) END) AS mae_absolute_soh_faulted FROM fs GROUP BY 1),
  o AS (SELECT *, mae_absolute_soh_faulted / mae_absolute_soh_baseline AS degradation_ratio FROM o1)""", "o", "fault_type n_rows", "mae_absolute_soh_baseline mae_absolute_soh_faulted degradation_ratio"))
def fault_errors(spark, d):
    """Forecast errors before and after each fault, by heads of nested selection on sound windows."""
    return D.fault_evaluation(_fault_scores(spark, d))[0]


@query(sql(FEVAL + """, al AS (SELECT channel, trajectory_id, min(CASE WHEN target_soh_true <= 0.7::double THEN reference_day END) AS t, min(CASE WHEN pred_soh <= 0.7::double THEN reference_day END) AS a FROM fs GROUP BY 1, 2),
  ax AS (SELECT *, CASE WHEN t >= a THEN t - a END AS dt FROM al), o AS (SELECT channel, count(*) AS n, count(dt) AS n_true_positive, count_if(t IS NOT NULL AND a IS NULL) AS n_missed, count_if(t < a) AS n_late, avg(dt) AS dt_warn_mean_days, quantile_cont(dt, 0.5) AS dt_warn_median_days FROM ax GROUP BY 1)""",
           "o", "channel n n_true_positive n_missed n_late", "dt_warn_mean_days dt_warn_median_days"))
def fault_alarms(spark, d):
    """Alarm statistics on both channels of the perturbed trajectories, at 0.70."""
    return D.fault_evaluation(_fault_scores(spark, d), warn=0.70)[1]


@query(sql(FAULT + ", fd AS (SELECT fault_type, eol_advance_days AS v FROM frecs WHERE eol_advance_days IS NOT NULL), o AS (SELECT fault_type, count(*) AS n, avg(v) AS mean, min(v) AS min, max(v) AS max, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q75 FROM fd GROUP BY 1)",
           "o", "fault_type n", "mean min max q25 median q75"))
def fault_advance_distribution(spark, d):
    """Quartiles of the days lost, by fault."""
    from cellfleet.operators.aggregates import distribution

    return distribution(D.fault_records(_faulted(spark, d)), ["fault_type"], "eol_advance_days")


# ---------------------------------------------------------------- streams


def file_stream(spark, folder: str, name: str, schema, files_per_batch: int = 1):
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", name).parquet(folder)
    )


@query(sql(TEL, "env", "scenario_id family n_samples", "mean_temp_c max_temp_c min_voltage_v max_voltage_v max_abs_current_a max_dod mean_dod final_efc final_ah_throughput final_wh_throughput min_soh_true max_rint_ohm"))
def streamed_envelope(spark, d):
    """The telemetry envelope from a stream of four batches; the log's newest rows equal the batch result."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    folder = R.work_folder(spark, "samples")
    for part in _slices(li, F.pmod("l_orderkey", F.lit(4)), 4):
        part.write.mode("append").parquet(folder)
    sdf = B.telemetry_columns(file_stream(spark, folder, "*.parquet", li.schema, _share(spark, folder, 4)))
    return R.run_envelope(sdf, R.work_folder(spark, "envelope"), most=2)


def _share(spark, folder, n):
    """Files of one of n batches. Slices are written as their table is split, so tasks stay of one size as it grows."""
    return max(1, -(-len(spark.read.parquet(folder).inputFiles()) // n))


def _slices(df, number, n):
    """A table in n parts by a number from 0."""
    return [df.where(number == i) for i in range(n)]


def _request_stream(spark, d):
    """Reference points in four slices of time, the second with points of the first again, read back as a stream."""
    folder = R.work_folder(spark, "requests")
    p = cut(B.requests(stored_points(spark, d)))
    i = F.col(POS)
    again = p.where(i % 5 == 0).withColumn("arrival", F.col("arrival") + 1)
    for part in (p.where(i < 20), p.where((i >= 20) & (i < 40)).unionByName(again.where(i < 40)), p.where((i >= 40) & (i < 50)), p.where(i >= 50)):
        part.repartition(2, "battery_id").write.mode("append").parquet(folder)
    return file_stream(spark, folder, "*.parquet", p.schema, 2)


def _trend_score(df):
    f = W.features_of_ctx(df)
    return f.select("battery_id", POS, (14.0 * F.col(POS)).alias("reference_day"),
                    (F.col("last") + 8 * F.col("slope_full")).alias("pred_soh"))


@query(sql(FEAT + ", o AS (SELECT trajectory_id::varchar AS battery_id, reference_index, reference_day, last + 8 * slope_full AS pred_soh FROM feat)", "o", "battery_id reference_index", "reference_day pred_soh"))
def streamed_scores(spark, d):
    """R2: online 20-point scores over four batches with repeated and late points; equal to the batch scores."""
    return SC.run_scores(_request_stream(spark, d), R.work_folder(spark, "scores"), _trend_score)


@query(sql(TREND8 + ", ps AS (SELECT trajectory_id, reference_day, last + 8 * slope_full AS p FROM feat), o AS (SELECT trajectory_id::varchar AS battery_id, min(reference_day) AS t_alarm_day, arg_min(p, reference_day) AS pred_soh FROM ps WHERE p <= 0.7::double GROUP BY 1)", "o", "battery_id", "t_alarm_day pred_soh"))
def streamed_alarms(spark, d):
    """One alarm per battery from scores of which every third comes a batch late; equal to the batch first alarm."""
    f = W.features11(points(spark, d))
    scores = f.select(F.col(KEY).cast("string").alias("battery_id"), "reference_day",
                      (F.col("last") + 8 * F.col("slope_full")).alias("pred_soh"), POS)
    folder = R.work_folder(spark, "alarms-in")
    scores = cut(scores)
    longest = scores.agg(F.max(POS)).first()[0] or 0
    step = longest // 4 + 1
    for part in _slices(scores, F.expr(f"{POS} div {step}") + (F.col(POS) % 3 == 0).cast("int"), 5):
        part.drop(POS).repartition(2, "battery_id").write.mode("append").parquet(folder)
    # A heartbeat long after the last day lets the watermark pass all alarms.
    beat = local_table(spark, [(None, 14.0 * longest + 1e6, None)], scores.drop(POS).schema)
    beat.coalesce(1).write.mode("append").parquet(folder)
    sdf = file_stream(spark, folder, "*.parquet", scores.drop(POS).schema, 2)
    return AL.run_alarms(sdf, R.work_folder(spark, "alarms"), 0.70, late_days=14.0 * 2 * step)
