"""Queries over ordered series: scans, projections and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellfleet.catalog.registry import (
    ANCHORS, FEAT, FEATURE_NAMES, TRAJ, WIN, features_sql, points, query, sql, stored_points, target_sql,
    windows,
)
from cellfleet.functions import forecast as X
from cellfleet.functions.space import FEATURES, Space, apply_space, apply_space_array
from cellfleet.operators import windows as W
from cellfleet.plans.scan import KEY, POS
from cellfleet.plans.small import cut, grid
from cellfleet.sources import testbed as B
from cellfleet.sources.tables import finite, positioned, usable_cycles

IDS = "trajectory_id family reference_index"


@query(sql(TRAJ + """, dim AS (SELECT trajectory_id, max(CASE WHEN soh_true <= 0.7::double THEN 0 ELSE 1 END) AS x,
  min(CASE WHEN soh_true <= 0.7::double THEN 0 ELSE 1 END) AS right_censored FROM traj GROUP BY 1),
  o AS (SELECT t.*, right_censored FROM traj t JOIN dim USING (trajectory_id))""",
           "o", IDS + " right_censored", "reference_day soh_true soh_observed"))
def trajectories_with_manifest(spark, d):
    """Reference points with the censoring flag of their trajectory."""
    pts = stored_points(spark, d)
    dim = pts.groupBy(KEY).agg(F.min((F.col("soh_true") > 0.7).cast("int")).alias("right_censored"))
    from cellfleet.operators.joins import lookup

    return lookup(pts, dim, KEY)


@query(sql(WIN + ", o AS (SELECT *, concat(trajectory_id, '|', reference_index, '|', horizon) AS sample_uid FROM win)",
           "o", "sample_uid trajectory_id family horizon", "anchor_soh_observed target_soh_true y_delta", tail="ORDER BY sample_uid"))
def window_table(spark, d):
    """The window table keyed and sorted by its sample id."""
    uid = F.concat_ws("|", KEY, POS, "horizon")
    return windows(spark, d).withColumn("sample_uid", uid).select(
        "sample_uid", KEY, "family", "horizon", "anchor_soh_observed", "target_soh_true", "y_delta"
    ).orderBy("sample_uid")


@query(sql("o AS (SELECT l_suppkey AS scenario_id, count(*) AS n, avg(28 + 50 * l_tax) AS mean_voltage_v, max(15 + 100 * l_discount) AS max_temp_c FROM lineitem GROUP BY 1)",
           "o", "scenario_id n", "mean_voltage_v max_temp_c"))
def telemetry_pruned(spark, d):
    """S3: only the columns in use are read from the telemetry scan."""
    t = B.telemetry(spark, d).select("scenario_id", "voltage_v", "temperature_c")
    return t.groupBy("scenario_id").agg(
        F.count("*").alias("n"), F.avg("voltage_v").alias("mean_voltage_v"), F.max("temperature_c").alias("max_temp_c")
    )


CYCLES = TRAJ + """, raw AS (
  SELECT trajectory_id AS cell_id, reference_index AS cycle_no, CASE WHEN reference_index % 10 = 3 THEN NULL WHEN reference_index % 10 = 7 THEN 0
    ELSE 2.0::double * soh_observed * (1 + 0.1::double * (trajectory_id % 3)) END AS capacity FROM traj)"""


@query(sql(CYCLES + ", o AS (SELECT cell_id, cycle_no, capacity, row_number() OVER (PARTITION BY cell_id ORDER BY cycle_no) - 1 AS cycle_idx FROM raw WHERE capacity > 0)",
           "o", "cell_id cycle_no cycle_idx", "capacity"))
def usable_cell_cycles(spark, d):
    """Unusable capacities are dropped and the rest re-indexed per cell."""
    bad = F.when(F.col("cycle_idx") % 10 == 3, F.lit(None)).when(F.col("cycle_idx") % 10 == 7, F.lit(0.0))
    raw = B.cell_cycles(stored_points(spark, d))
    raw = raw.withColumn("capacity", bad.when(F.lit(True), F.col("capacity")))
    return usable_cycles(raw).select("cell_id", "cycle_no", "cycle_idx", "capacity")


@query(sql(TRAJ + ", o AS (SELECT a.trajectory_id, a.reference_index, list_sum(list(b.soh_observed)) AS ctx_sum, count(*) AS n_ctx, min(b.soh_observed) AS ctx_first_min FROM traj a JOIN traj b ON a.trajectory_id = b.trajectory_id AND b.reference_index BETWEEN a.reference_index - 19 AND a.reference_index WHERE a.reference_index >= 19 GROUP BY 1, 2)",
           "o", "trajectory_id reference_index n_ctx", "ctx_sum ctx_first_min"))
def context_windows(spark, d):
    """20-point contexts, shown by their sums."""
    c = W.context_windows(points(spark, d))
    total = F.aggregate("ctx", F.lit(0.0), lambda a, x: a + x)
    return c.select(KEY, POS, F.size("ctx").cast("long").alias("n_ctx"), total.alias("ctx_sum"),
                    F.array_min("ctx").alias("ctx_first_min"))


@query(sql(FEAT, "feat", IDS, FEATURE_NAMES))
def features(spark, d):
    """The 11 context features at every anchor."""
    return W.features11(points(spark, d)).select(*IDS.split(), *FEATURES)


@query(sql(WIN, "win", IDS + " horizon", "reference_day target_day anchor_soh_observed target_soh_true y_delta"))
def labelled_windows(spark, d):
    """Labels 2, 4 and 8 steps ahead."""
    return windows(spark, d).select(*IDS.split(), "horizon", "reference_day", "target_day", "anchor_soh_observed",
                                    "target_soh_true", "y_delta")


SRC = TRAJ + """, cyc AS (SELECT trajectory_id, reference_index, 2.0::double * soh_observed * (1 + 0.1::double * (trajectory_id % 3)) AS capacity FROM traj),
sohs AS (SELECT trajectory_id, reference_index, capacity / first_value(capacity) OVER (PARTITION BY trajectory_id ORDER BY reference_index) AS soh,
  count(*) OVER (PARTITION BY trajectory_id) AS n FROM cyc),""" + features_sql(
    "(SELECT * FROM sohs WHERE n >= 29)", "src", "soh", extra=", lead(soh, 8) OVER w AS nxt")
SRC += ", srcw AS (SELECT *, trajectory_id AS cell_id, reference_index AS cycle_idx, nxt - soh AS y_delta FROM src WHERE nxt IS NOT NULL)"


@query(sql(SRC, "srcw", "cell_id cycle_idx", "y_delta " + FEATURE_NAMES))
def source_windows(spark, d):
    """Windows of public cells, relative to each cell's first capacity."""
    return W.source_windows(B.cell_cycles(stored_points(spark, d))).select("cell_id", "cycle_idx", "y_delta", *FEATURES)


@query(sql(ANCHORS, "anchors", IDS + " censored", "reference_day rul_days rul_lower_bound_days last slope_full"))
def rul_anchors(spark, d):
    """Remaining-life anchors with censored trajectories kept."""
    return W.rul_anchors(stored_points(spark, d)).select(*IDS.split(), "censored", "reference_day", "rul_days",
                                                  "rul_lower_bound_days", "last", "slope_full")


# The whole table damaged by rule: rows are missing, and some values are NULL or NaN.
GAPS = TRAJ + """, gap AS (SELECT trajectory_id, family, reference_index AS raw_index, row_number() OVER (PARTITION BY trajectory_id ORDER BY reference_index) - 1 AS reference_index,
    reference_day, soh_true, CASE WHEN (reference_index * 5 + trajectory_id) % 37 IN (4, 9) THEN NULL ELSE soh_observed END AS soh_observed
  FROM traj WHERE (reference_index * 7 + trajectory_id) % 11 <> 3),""" + features_sql("gap", "gfeat")


def gapped(spark, d):
    """The damaged points as the reader hands them on: by position, missing values as NULL."""
    p, i, t = stored_points(spark, d), F.col(POS), F.col(KEY)
    hole = (i * 5 + t) % 37
    bad = F.when(hole == 4, F.lit(float("nan"))).when(hole == 9, F.lit(None)).otherwise(F.col("soh_observed"))
    return cut(positioned(finite(p.where((i * 7 + t) % 11 != 3).withColumn("soh_observed", bad))))


@query(sql(GAPS, "gfeat", IDS + " raw_index", FEATURE_NAMES))
def gapped_features(spark, d):
    """W2 on an index with gaps and missing values: features by row position."""
    return W.features11(gapped(spark, d)).select(*IDS.split(), "raw_index", *FEATURES)


@query(sql(GAPS + "," + target_sql("gfeat", "gwin"), "gwin", IDS + " horizon", "target_day target_soh_true y_delta"))
def gapped_windows(spark, d):
    """W3 on the damaged table: the label is h rows on, and missing anchors have no difference."""
    return W.with_target(gapped(spark, d), (2, 4, 8)).select(*IDS.split(), "horizon", "target_day", "target_soh_true", "y_delta")


@query(sql(GAPS + """, gend AS (SELECT trajectory_id, min(CASE WHEN soh_true <= 0.70::double THEN reference_day END) AS eol_day, max(reference_day) AS last_day, count(*) AS n FROM gap GROUP BY 1),
  o AS (SELECT f.*, eol_day - reference_day AS rul_days, last_day - reference_day AS rul_lower_bound_days, CASE WHEN eol_day IS NULL THEN 1 ELSE 0 END AS censored, n - 19 AS n_censored_rows
    FROM gfeat f JOIN gend USING (trajectory_id) WHERE eol_day IS NULL OR reference_day < eol_day)""",
           "o", IDS + " censored n_censored_rows", "rul_days rul_lower_bound_days last slope_full"))
def gapped_anchors(spark, d):
    """W5 on the damaged table."""
    return W.rul_anchors(gapped(spark, d)).select(*IDS.split(), "censored", "n_censored_rows", "rul_days",
                                                  "rul_lower_bound_days", "last", "slope_full")


@query(sql(GAPS + """, o AS (SELECT *, (last - 0.85::double) / 0.07::double AS z_last, (diff1 - 0.01::double) / 0.5::double AS z_diff1 FROM gfeat)""", "o", IDS, "z_last z_diff1"))
def missing_z_scores(spark, d):
    """A missing feature has no z score; it is not taken for a clip bound."""
    space = Space(("last", "diff1"), (0.0, -5.0), (2.0, 5.0), (0.85, 0.01), (0.07, 0.5))
    return apply_space(W.features11(gapped(spark, d)), space).select(*IDS.split(), "z_last", "z_diff1")


@query(sql(TRAJ + """, o AS (SELECT *, soh_true - coalesce(lag(soh_true) OVER w, 0) AS d_soh_true, soh_true - lag(soh_true) OVER w AS diff_soh_true,
  sum(soh_observed) OVER (w ROWS UNBOUNDED PRECEDING) AS sum_soh_observed FROM traj WINDOW w AS (PARTITION BY trajectory_id ORDER BY reference_index))""",
           "o", "trajectory_id reference_index", "d_soh_true diff_soh_true sum_soh_observed"))
def lags_and_running_sums(spark, d):
    """Differences to the previous point, and running sums."""
    out = W.running_sum(W.with_lag(stored_points(spark, d), ["soh_true"]), "soh_observed")
    return out.select(KEY, POS, "d_soh_true", "diff_soh_true", "sum_soh_observed")


@query(sql(TRAJ + ", o AS (SELECT trajectory_id, arg_min(soh_true, reference_index) AS first_soh_true, arg_max(soh_true, reference_index) AS last_soh_true FROM traj GROUP BY 1)",
           "o", "trajectory_id", "first_soh_true last_soh_true"))
def first_and_last(spark, d):
    """First and last value per trajectory."""
    return W.first_last(points(spark, d), ["soh_true"])


MONO = TRAJ + """, st AS (SELECT trajectory_id, soh_observed - lag(soh_observed) OVER (PARTITION BY trajectory_id ORDER BY reference_index) AS step FROM traj),
per AS (SELECT trajectory_id, count_if(step > 1e-12) AS rises, avg(CASE WHEN step <= 1e-6 THEN 1.0 ELSE 0.0 END) AS share FROM st WHERE step IS NOT NULL GROUP BY 1),
o AS (SELECT sum(rises)::bigint AS rises, avg(share) AS non_increasing_share FROM per)"""


@query(sql(MONO, "o", "rises", "non_increasing_share"))
def monotonicity(spark, d):
    """Rises of the noisy channel, and the mean share of steps that do not rise."""
    return W.monotonicity(points(spark, d), "soh_observed")


HALVES = TRAJ + """, st AS (SELECT trajectory_id, reference_index, soh_true - lag(soh_true) OVER w AS step, count(*) OVER (PARTITION BY trajectory_id) // 2 AS mid
  FROM traj WINDOW w AS (PARTITION BY trajectory_id ORDER BY reference_index)),
halves AS (SELECT trajectory_id, coalesce(avg(CASE WHEN reference_index BETWEEN 1 AND mid - 1 THEN step END), 0) AS early,
  coalesce(avg(CASE WHEN reference_index > mid THEN step END), 0) AS late FROM st GROUP BY 1)"""


@query(sql(HALVES, "halves", "trajectory_id", "early late"))
def half_rates(spark, d):
    """Mean step of the first and the second half."""
    return W.half_rates(stored_points(spark, d))


@query(sql(TRAJ + ", o AS (SELECT a.trajectory_id, a.reference_index, " + ", ".join(
    f"max(CASE WHEN b.reference_index = a.reference_index - {19 - i} THEN b.soh_observed END) AS ctx_soh_{i:02d}" for i in range(20)
) + " FROM traj a JOIN traj b ON a.trajectory_id = b.trajectory_id AND b.reference_index BETWEEN a.reference_index - 19 AND a.reference_index WHERE a.reference_index >= 19 GROUP BY 1, 2)",
           "o", "trajectory_id reference_index", " ".join(f"ctx_soh_{i:02d}" for i in range(20))))
def wide_contexts(spark, d):
    """Contexts as wide columns, packed and unpacked once more."""
    wide = W.unpack_ctx(W.context_windows(points(spark, d)).select(KEY, POS, "ctx"))
    return W.unpack_ctx(W.pack_ctx(wide))


@query(sql(ANCHORS + ", unc AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY trajectory_id, reference_index) - 1 AS k FROM anchors WHERE censored = 0)",
           "unc", IDS, "rul_days", tail="WHERE k % 10 = 0"))
def every_tenth_anchor(spark, d):
    """Every tenth uncensored anchor of each family, in order."""
    unc = W.rul_anchors(stored_points(spark, d)).where(F.col("censored") == 0).select(*IDS.split(), "rul_days")
    return W.stride(unc, 10)


@query(sql(TRAJ + ", ids AS (SELECT DISTINCT family, trajectory_id FROM traj), b AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY trajectory_id) AS r FROM ids), o AS (SELECT t.family, t.trajectory_id, count(*) AS n FROM traj t JOIN b USING (family, trajectory_id) WHERE r <= 5 GROUP BY 1, 2)",
           "o", "family trajectory_id n"))
def budget_subset(spark, d):
    """The first five trajectories of each family."""
    return W.budget_subset(stored_points(spark, d), 5).groupBy("family", KEY).agg(F.count("*").alias("n"))


@query(sql(TRAJ + """, o AS (SELECT *, count(*) OVER w AS prefix_n, avg(soh_observed) OVER w AS prefix_mean, min(soh_observed) OVER w AS prefix_min,
  max(soh_observed) OVER w AS prefix_max FROM traj WINDOW w AS (PARTITION BY trajectory_id ORDER BY reference_index ROWS UNBOUNDED PRECEDING)),
  oo AS (SELECT *, prefix_mean / 0.9713::double AS prefix_mean_vs_start FROM o)""",
           "oo", "trajectory_id reference_index prefix_n", "prefix_mean_vs_start prefix_min prefix_max"))
def prefix_statistics(spark, d):
    """Statistics of all points up to each anchor."""
    vs = (F.col("prefix_mean") / 0.9713).alias("prefix_mean_vs_start")
    return W.prefix_stats(stored_points(spark, d)).select(KEY, POS, "prefix_n", vs, "prefix_min", "prefix_max")


WIENER = TRAJ + """, inc AS (SELECT *, reference_day - lag(reference_day) OVER w AS dt, soh_observed - lag(soh_observed) OVER w AS ds
  FROM traj WINDOW w AS (PARTITION BY trajectory_id ORDER BY reference_index)),
run AS (SELECT *, count(dt) OVER w AS n, sum(dt) OVER w AS sdt, sum(ds) OVER w AS sds, sum(ds * ds / dt) OVER w AS sq
  FROM inc WINDOW w AS (PARTITION BY trajectory_id ORDER BY reference_index ROWS UNBOUNDED PRECEDING)),
mus AS (SELECT *, CASE WHEN n >= 2 THEN -sds / sdt ELSE 0 END AS mu FROM run),
wiener AS (SELECT *, n AS n_steps, CASE WHEN n >= 2 THEN sqrt(greatest((sq + 2 * mu * sds + mu * mu * sdt) / n, 1e-18)) ELSE 1e-9 END AS sigma FROM mus)"""
WRUL = "CASE WHEN {s} - 0.70::double <= 0 THEN 0 WHEN mu <= 0 THEN 3000 ELSE least(({s} - 0.70::double) / mu, 3000) END"


@query(sql(WIENER + f", o AS (SELECT *, {WRUL.format(s='soh_observed')} AS wiener_rul FROM wiener)",
           "o", "trajectory_id reference_index n_steps", "mu sigma wiener_rul", digits=6), digits=6)
def wiener_passage(spark, d):
    """Drift and diffusion at every anchor, and the mean passage time."""
    fit = W.wiener_fit(stored_points(spark, d))
    rul = X.wiener_rul(F.col("mu"), F.col("soh_observed"))
    return fit.withColumn("wiener_rul", rul).select(KEY, POS, "n_steps", "mu", "sigma", "wiener_rul")


# ---------------------------------------------------------------- projections

_S = B.SPACE11
_APPLIED = ", ".join(
    f"(least(greatest({n}, {lo}::double), {hi}::double) - {m}::double) / {s}::double AS z_{n}"
    for n, lo, hi, m, s in zip(_S.names, _S.clip_lo, _S.clip_hi, _S.mean, _S.std)
)


@query(sql(FEAT + f", o AS (SELECT *, {_APPLIED} FROM feat)", "o", IDS, " ".join(_S.columns())))
def clipped_z_scores(spark, d):
    """Clip and z-score in the frozen 11-feature space."""
    return apply_space(W.features11(points(spark, d)), _S).select(*IDS.split(), *_S.columns())


@query(sql(FEAT + f", o AS (SELECT trajectory_id, reference_index, z_last, z_slope_full FROM (SELECT *, {_APPLIED} FROM feat))",
           "o", "trajectory_id reference_index", "z_last z_slope_full"))
def array_z_scores(spark, d):
    """X1 on arrays, with the space as a one-row table."""
    names = ["last", "slope_full"]
    i = [_S.names.index(n) for n in names]
    pick = lambda v: [v[j] for j in i]
    space = grid(spark, [(pick(_S.clip_lo), pick(_S.clip_hi), pick(_S.mean), pick(_S.std))],
                 "lo array<double>, hi array<double>, m array<double>, s array<double>")
    f = W.features11(points(spark, d)).select(KEY, POS, F.array(*names).alias("x")).join(space, F.lit(True))
    c = F.col
    z = apply_space_array(c("x"), c("lo"), c("hi"), c("m"), c("s"))
    return f.withColumn("z", z).select(KEY, POS, c("z")[0].alias("z_last"), c("z")[1].alias("z_slope_full"))


# A fixed head per horizon, for the projections that need one.
_HEAD = {2: (-0.0004, 0.003, -0.01), 4: (-0.0009, 0.006, -0.02), 8: (-0.002, 0.012, -0.04)}
_PRED = "CASE horizon " + " ".join(
    f"WHEN {h} THEN {b}::double + {c0}::double * z1 + {c1}::double * z2" for h, (c0, c1, b) in _HEAD.items()) + " END"
_Z = "(last - 0.85::double) / 0.07::double AS z1, (slope_full + 0.005::double) / 0.0013::double AS z2"


def _predicted(spark, d):
    z = apply_space(windows(spark, d), B.SPACE2)
    head = grid(spark, [(h, *v) for h, v in _HEAD.items()], "horizon int, c0 double, c1 double, c_b double")
    return X.predict(z.join(head, "horizon"), B.SPACE2.columns(), ["c0", "c1"], "c_b")


PRED = WIN + f", zz AS (SELECT *, {_Z} FROM win), pr AS (SELECT *, {_PRED} AS pred_delta FROM zz), pred AS (SELECT *, anchor_soh_observed + pred_delta AS pred_soh FROM pr)"


@query(sql(PRED, "pred", IDS + " horizon", "pred_delta pred_soh"))
def linear_prediction(spark, d):
    """Linear prediction on the delta and the absolute scale."""
    return _predicted(spark, d).select(*IDS.split(), "horizon", "pred_delta", "pred_soh")


@query(sql(WIN + ", o AS (SELECT *, 0.0::double AS persistence, slope_full * horizon AS local_trend FROM win)", "o", IDS + " horizon", "persistence local_trend"))
def baselines(spark, d):
    """Persistence and local trend."""
    p = X.persistence(windows(spark, d)).withColumnRenamed("pred_delta", "persistence")
    return X.local_trend(p).withColumnRenamed("pred_delta", "local_trend").select(*IDS.split(), "horizon", "persistence", "local_trend")


SLOPE_RUL = "least(greatest(coalesce(CASE WHEN slope_full < 0 THEN (0.70::double - last) / slope_full * 14 END, 2000), 0), 3000)"


@query(sql(FEAT + f", o AS (SELECT *, {SLOPE_RUL} AS slope_rul FROM feat)", "o", IDS, "slope_rul", digits=6), digits=6)
def slope_extrapolation(spark, d):
    """Remaining life by the observed slope."""
    f = W.features11(points(spark, d))
    return f.select(*IDS.split(), X.slope_rul(F.col("last"), F.col("slope_full")).alias("slope_rul"))


@query(sql(PRED + ", o AS (SELECT *, CASE horizon WHEN 2 THEN 0.01::double WHEN 4 THEN 0.02::double ELSE 0.04::double END AS hw FROM pred), oo AS (SELECT *, pred_soh - hw AS interval_lo, pred_soh + hw AS interval_hi FROM o)",
           "oo", IDS + " horizon", "interval_lo interval_hi"))
def symmetric_intervals(spark, d):
    """Symmetric intervals around the prediction."""
    hw = F.when(F.col("horizon") == 2, 0.01).when(F.col("horizon") == 4, 0.02).otherwise(0.04)
    out = X.interval(_predicted(spark, d).withColumn("hw", hw), "hw")
    return out.select(*IDS.split(), "horizon", "interval_lo", "interval_hi")


def _cross_sql(t: str, thr: float) -> str:
    th = f"{thr}::double"
    nodes = [(0, "s0"), (28, "s1"), (56, "s2"), (112, "s3")]
    day, seg, st = f"CASE WHEN s0 <= {th} THEN 0", f"CASE WHEN s0 <= {th} THEN 'anchor'", f"CASE WHEN s0 <= {th} THEN '{X.AT_ANCHOR}'"
    for (d0, a), (d1, b) in zip(nodes, nodes[1:]):
        day += f" WHEN {b} <= {th} THEN {d0} + ({a} - {th}) / ({a} - {b}) * {d1 - d0}"
        seg += f" WHEN {b} <= {th} THEN '{d0}->{d1}d'"
        st += f" WHEN {b} <= {th} THEN '{X.INTERPOLATED}'"
    return f"{day} END AS {t}_days, {seg} END AS {t}_segment, {st} ELSE '{X.NO_CROSSING}' END AS {t}_status"


PATHS = FEAT + ", paths AS (SELECT *, last AS s0, last + 2 * slope_full AS s1, last + 4 * slope_full AS s2, last + 8 * slope_full AS s3 FROM feat)"
READOUT = PATHS + f""", ro AS (SELECT *, {_cross_sql('rul', 0.7)}, {_cross_sql('warning', 0.8)} FROM paths),
readout AS (SELECT *, rul_days IS NOT NULL AS rul_crossed_within_112d, coalesce(warning_days > 0, false) AS warning_is_forecast FROM ro)"""


def _paths(spark, d):
    f = W.features11(points(spark, d)).withColumn("anchor_soh_observed", F.col("last"))
    return f.withColumns({f"soh_h{h}": F.col("last") + h * F.col("slope_full") for h in (2, 4, 8)})


@query(sql(READOUT, "readout", IDS + " rul_segment rul_status", "rul_days"))
def path_crossings(spark, d):
    """First crossing of 0.70 on the four-node forecast path."""
    p = _paths(spark, d)
    c = X.path_crossing([F.col(n) for n in ("last", "soh_h2", "soh_h4", "soh_h8")], 0.70)
    return p.select(*IDS.split(), c["segment"].alias("rul_segment"), c["status"].alias("rul_status"), c["days"].alias("rul_days"))


@query(sql(READOUT, "readout", IDS + " rul_status rul_segment rul_crossed_within_112d warning_status warning_is_forecast", "rul_days warning_days"))
def rul_readouts(spark, d):
    """Remaining-life and warning read-out of every anchor."""
    return X.rul_readout(_paths(spark, d)).select(*IDS.split(), "rul_status", "rul_segment", "rul_crossed_within_112d",
                                                  "warning_status", "warning_is_forecast", "rul_days", "warning_days")


@query(sql(TRAJ + ", o AS (SELECT trajectory_id, reference_index, f.case_name AS \"case\", soh_observed / (1 + 0.004::double * f.k * (15.3::double + reference_index % 11 - 20)) AS soh_corrected FROM traj, (VALUES ('low', 0.8::double), ('base', 1.0::double), ('high', 1.2::double)) f(case_name, k))",
           "o", 'trajectory_id reference_index "case"', "soh_corrected", digits=8), digits=8)
def temperature_correction(spark, d):
    """Temperature-corrected SOH at three coefficients in one pass."""
    t = points(spark, d).withColumn("mean_temp_c", (F.lit(15.3) + F.col(POS) % 11))
    return X.temperature_corrected(t, [("low", 0.8), ("base", 1.0), ("high", 1.2)]).select(KEY, POS, "case", "soh_corrected")


@query(sql(WIN + ", m AS (SELECT horizon, family, round(avg(y_delta), 8) AS m FROM win GROUP BY 1, 2), o AS (SELECT horizon, concat('{', string_agg(concat('\"', family, '\":', m), ',' ORDER BY family), '}') AS packed FROM m GROUP BY 1)",
           "o", "horizon packed"))
def packed_family_means(spark, d):
    """Family means as one JSON object per horizon."""
    per = windows(spark, d).groupBy("horizon", "family").agg(F.avg("y_delta").alias("m"))
    return X.pack_json(per, ["horizon"], "family", "m")


