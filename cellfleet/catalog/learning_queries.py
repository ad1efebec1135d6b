"""Learning queries on two features, whose solves are written out in SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from cellfleet.catalog.registry import ANCHORS, FIRST2, Z2, ZWIN, points, query, sql, stored_points, windows, z_anchors, z_windows
from cellfleet.catalog.series_queries import SLOPE_RUL, SRC, WIENER, WRUL
from cellfleet.functions.space import Space, apply_space
from cellfleet.operators import aggregates as A
from cellfleet.operators import conformal as C
from cellfleet.operators import fleet as G
from cellfleet.operators import learning as L
from cellfleet.operators import windows as W
from cellfleet.plans.scan import KEY, POS
from cellfleet.plans.small import cut, settle
from cellfleet.sources import testbed as B

PRIOR = L.Prior(B.PRIOR2)
P0, P1 = B.PRIOR2[2]


def _grid_sql(alphas: Sequence[float], lambdas: Sequence[float]) -> str:
    cells = [(lam, a) for lam in lambdas for a in alphas]
    return ", ".join(f"({i}, {lam}::double, {a}::double)" for i, (lam, a) in enumerate(cells))


def blocks_sql(rows: str, out: str, y: str = "y_delta", keys: Sequence[str] = ("horizon",), where: str = "true") -> str:
    """Per-family sufficient statistics with weights 1 / rows / trajectories."""
    k = ", ".join(keys)
    m = {"g11": "z1 * z1", "g12": "z1 * z2", "g22": "z2 * z2", "s1": "z1", "s2": "z2", "b1": f"z1 * {y}",
         "b2": f"z2 * {y}", "sy": y, "syy": f"{y} * {y}"}
    return f"""{out}_t AS (SELECT {k}, family, trajectory_id, count(*) AS n, {', '.join(f'sum({e}) / count(*) AS {c}' for c, e in m.items())}
  FROM {rows} WHERE {where} GROUP BY ALL),
{out} AS (SELECT {k}, family, sum(n)::bigint AS n_rows, count(*) AS n_traj, 1.0::double AS sw, {', '.join(f'sum({c}) / count(*) AS {c}' for c in m)} FROM {out}_t GROUP BY ALL)"""


SUMS = "sum(n_rows) AS n, sum(n_traj)::bigint AS n_traj, sum(sw) AS sw, sum(g11) AS g11, sum(g12) AS g12, sum(g22) AS g22, sum(s1) AS s1, sum(s2) AS s2, sum(b1) AS b1, sum(b2) AS b2, sum(sy) AS sy, sum(syy) AS syy"


def ridge_sql(rows: str, blocks: str, p: str, alphas=L.ALPHAS, lambdas=(0.0,), y: str = "y_delta",
              keys: Sequence[str] = ("horizon",), prior: tuple[float, float] = (0.0, 0.0), score_where: str = "true") -> str:
    """Nested leave-one-family-out ridge or L2-SP on two features, down to the selected heads."""
    k = list(keys)
    ks = ", ".join(k)
    on = " AND ".join(f"a.{c} = b.{c}" for c in k)
    tk = ", ".join(f"a.{c}" for c in k)

    def solve(src: str, extra: str) -> str:
        return f"""SELECT {ks}, {extra}, cand, lam, alpha, n_traj, n, c0, c1, sy / sw - (s1 * c0 + s2 * c1) / sw AS c_b FROM (
  SELECT *, (a22 * r1 - a12 * r2) / (a11 * a22 - a12 * a12) AS c0, (a11 * r2 - a12 * r1) / (a11 * a22 - a12 * a12) AS c1 FROM (
  SELECT t.*, cand, lam, alpha, g11 * n / sw + alpha + lam AS a11, g12 * n / sw AS a12, g22 * n / sw + alpha + lam AS a22,
    b1 * n / sw + lam * {prior[0]}::double AS r1, b2 * n / sw + lam * {prior[1]}::double AS r2 FROM {src} t, {p}_grid))"""

    return f"""{p}_grid(cand, lam, alpha) AS (VALUES {_grid_sql(alphas, lambdas)}),
{p}_in AS (SELECT {tk}, a.family AS held, c.family AS inner_family, {', '.join(s.replace('sum(', 'sum(b.') for s in SUMS.split(', '))}
  FROM {blocks} a JOIN {blocks} c ON {on.replace('b.', 'c.')} AND a.family <> c.family JOIN {blocks} b ON {on} AND b.family <> a.family AND b.family <> c.family GROUP BY ALL),
{p}_out AS (SELECT {tk}, a.family AS held, {', '.join(s.replace('sum(', 'sum(b.') for s in SUMS.split(', '))} FROM {blocks} a JOIN {blocks} b ON {on} AND b.family <> a.family GROUP BY ALL),
{p}_fin AS ({solve(f'{p}_in', 'held, inner_family')}), {p}_fout AS ({solve(f'{p}_out', 'held')}),
{p}_sc AS (SELECT {tk}, held, inner_family, cand, avg(abs(c0 * z1 + c1 * z2 + c_b - a.{y})) AS score FROM {rows} a JOIN {p}_fin b ON {on} AND a.family = b.inner_family WHERE {score_where} GROUP BY ALL),
{p}_ms AS (SELECT {ks}, held, cand, avg(score) AS mean_score FROM {p}_sc GROUP BY ALL),
{p}_sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {ks}, held ORDER BY round(mean_score, 15), cand) AS r FROM {p}_ms) WHERE r = 1),
{p} AS (SELECT b.*, a.mean_score FROM {p}_sel a JOIN {p}_fout b ON {on} AND a.held = b.held AND a.cand = b.cand)"""


GRAM = ZWIN + "," + blocks_sql("zwin", "blk")
RIDGE = GRAM + "," + ridge_sql("zwin", "blk", "rh")
L2SP_A, L2SP_L = L.TRANSFER_ALPHAS, L.LAMBDAS
L2SP = GRAM + "," + ridge_sql("zwin", "blk", "lh", L2SP_A, L2SP_L, prior=(P0, P1))


@query(sql(ZWIN + ", c AS (SELECT *, count(*) OVER (PARTITION BY horizon, trajectory_id) AS nw FROM zwin), t AS (SELECT horizon, family, count(DISTINCT trajectory_id) AS m FROM zwin GROUP BY 1, 2), o AS (SELECT *, 1.0::double / nw / m AS weight FROM c JOIN t USING (horizon, family))",
           "o", "trajectory_id reference_index horizon", "weight"))
def row_weights(spark, d):
    """M1: trajectory-equal, family-balanced weights per stratum."""
    return L.equal_weights(windows(spark, d)).select(KEY, POS, "horizon", "weight")


@query(sql(GRAM, "blk", "horizon family n_rows n_traj", "sw g11 g12 g22 s1 s2 b1 b2 sy syy", digits=8), digits=8)
def sufficient_statistics(spark, d):
    """M2: normal-equation sums per horizon and family."""
    names = {"n_trajectories": "n_traj", "g0_0": "g11", "g0_1": "g12", "g1_1": "g22", "s0": "s1", "s1": "s2", "b0": "b1", "b1": "b2"}
    g = L.gram(z_windows(spark, d), Z2)
    return g.select(*[F.col(c).alias(names.get(c, c)) for c in g.columns])


ALPHA_FIX = {2: 0.1, 4: 1.0, 8: 10.0}
FIX_SQL = ", ".join(f"({h}, {a}::double)" for h, a in ALPHA_FIX.items())
DEPLOY = GRAM + f""", fx(horizon, alpha) AS (VALUES {FIX_SQL}), dp_s AS (SELECT horizon, {SUMS} FROM blk GROUP BY 1),
  dp_a AS (SELECT s.*, alpha, g11 * n / sw + alpha AS a11, g12 * n / sw AS a12, g22 * n / sw + alpha AS a22, b1 * n / sw AS r1, b2 * n / sw AS r2 FROM dp_s s JOIN fx USING (horizon)),
  dp_c AS (SELECT *, (a22 * r1 - a12 * r2) / (a11 * a22 - a12 * a12) AS c0, (a11 * r2 - a12 * r1) / (a11 * a22 - a12 * a12) AS c1 FROM dp_a),
  dp AS (SELECT horizon, alpha, n::bigint AS n_train_rows, n_traj AS n_train_trajectories, c0, c1, sy / sw - (s1 * c0 + s2 * c1) / sw AS c_b FROM dp_c)"""


@query(sql(DEPLOY, "dp", "horizon n_train_rows n_train_trajectories", "alpha c0 c1 c_b"))
def deployment_heads(spark, d):
    """One ridge head per horizon on all families, at fixed strengths."""
    return L.deploy_heads(z_windows(spark, d), Z2, ALPHA_FIX).drop("lam")


@query(sql(L2SP, "lh_fout", "horizon held cand", "lam alpha c0 c1 c_b"))
def l2sp_candidates(spark, d):
    """M4: every outer L2-SP candidate, pulled towards the source head."""
    blocks = L.moments(L.gram(z_windows(spark, d), Z2), 2)
    h = L.candidate_heads(blocks, L2SP_A, L2SP_L, PRIOR)
    schema = "horizon int, held long, cand int, c0 double, c1 double, c_b double"
    from cellfleet.plans.small import grid

    return grid(spark, h.outer, schema).join(grid(spark, h.grid, "cand int, lam double, alpha double"), "cand")


@query(sql("f AS (SELECT DISTINCT user_id % 6 AS family FROM events), o AS (SELECT a.family AS held, b.family AS inner_family FROM f a JOIN f b ON a.family <> b.family)", "o", "held inner_family"))
def lofo_folds(spark, d):
    """M6: leave-one-family-out pairs."""
    ev = spark.read.parquet(f"{d}/events.parquet")
    return L.lofo(ev.select((F.col("user_id") % 6).alias("family")))


@query(sql(RIDGE, "rh_sc", "horizon held inner_family cand", "score"))
def inner_scores(spark, d):
    """M7: inner-fold error of every candidate."""
    z = cut(z_windows(spark, d).select("horizon", "family", KEY, *Z2, "y_delta"))
    heads = L.candidate_heads(L.moments(L.gram(z, Z2), 2), L.ALPHAS)
    return L.score_candidates(z, Z2, heads).drop("n_rows")


@query(sql(RIDGE, "rh", "horizon held cand", "alpha mean_score c0 c1 c_b"))
def selected_heads(spark, d):
    """M7: the strength chosen on inner folds, and its outer head."""
    z = cut(z_windows(spark, d).select("horizon", "family", KEY, *Z2, "y_delta"))
    return L.lofo_fit(z, Z2).drop("lam")


def _lofo(spark, d, **kw):
    keep = ["horizon", "family", KEY, POS, "last", "slope_full", *Z2, "y_delta", "anchor_soh_observed", "target_soh_true"]
    z = cut(z_windows(spark, d).select(*keep))
    return z, L.lofo_fit(z, Z2, **kw)


SCORED = RIDGE + ", so AS (SELECT w.*, alpha, lam, c_b + c0 * z1 + c1 * z2 AS pred_delta, anchor_soh_observed + (c_b + c0 * z1 + c1 * z2) AS pred_soh FROM zwin w JOIN rh ON w.horizon = rh.horizon AND w.family = rh.held)"


@query(sql(SCORED + """, o AS (SELECT horizon, family AS held, any_value(alpha) AS alpha, any_value(lam) AS lam, count(*) AS n_test_rows, avg(abs(pred_delta - y_delta)) AS mae_delta,
  sqrt(avg((pred_delta - y_delta) ** 2)) AS rmse_delta, avg(abs(pred_soh - target_soh_true)) AS mae_absolute_soh, false AS selector_saw_outer_test FROM so GROUP BY 1, 2)""",
           "o", "horizon held n_test_rows selector_saw_outer_test", "alpha lam mae_delta rmse_delta mae_absolute_soh"))
def outer_evaluation(spark, d):
    """M8: errors on each held-out family."""
    z, heads = _lofo(spark, d)
    return L.lofo_evaluate(z, Z2, heads)


@query(sql(SCORED, "so", "trajectory_id reference_index horizon", "pred_delta pred_soh"))
def out_of_family_predictions(spark, d):
    """M9: prediction of every window by the head that never saw its family."""
    z, heads = _lofo(spark, d)
    return L.attach_heads(z, heads, Z2).select(KEY, POS, "horizon", "pred_delta", "pred_soh")


BUD = L.BUDGETS
ADAPT = ZWIN + f""", bg(budget, budget_share) AS (VALUES {', '.join(f"('{b}', {n}::double)" for b, n in BUD)}), ids AS (SELECT DISTINCT family, trajectory_id FROM zwin),
  bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY trajectory_id) AS r, count(*) OVER (PARTITION BY family) AS m FROM ids), bg WHERE r <= ceil(budget_share * m - 1e-9)),
  btrain AS (SELECT w.*, budget FROM zwin w JOIN bm USING (family, trajectory_id)),""" + blocks_sql("btrain", "bb", keys=("budget", "horizon")) + "," + ridge_sql(
    "btrain", "bb", "ah", L2SP_A, L2SP_L, keys=("budget", "horizon"), prior=(P0, P1)) + """,
  ao AS (SELECT budget, w.*, alpha, lam, c_b + c0 * z1 + c1 * z2 AS pred_delta FROM zwin w JOIN ah ON w.horizon = ah.horizon AND w.family = ah.held),
  cells AS (SELECT budget, horizon, family AS held, any_value(alpha) AS alpha, any_value(lam) AS lam, count(*) AS n_test_rows, avg(abs(pred_delta - y_delta)) AS mae_delta,
    sqrt(avg((pred_delta - y_delta) ** 2)) AS rmse_delta, avg(abs(anchor_soh_observed + pred_delta - target_soh_true)) AS mae_absolute_soh FROM ao GROUP BY 1, 2, 3)"""


def _adaptation(spark, d):
    keep = ["horizon", "family", KEY, *Z2, "y_delta", "anchor_soh_observed", "target_soh_true"]
    z = cut(z_windows(spark, d).select(*keep))
    return L.adaptation_curve(z, Z2, BUD, L2SP_A, L2SP_L, PRIOR)


@query(sql(ADAPT, "cells", "budget horizon held n_test_rows", "alpha lam mae_delta rmse_delta mae_absolute_soh"))
def adaptation_cells(spark, d):
    """Protocol cells at growing trajectory budgets."""
    return _adaptation(spark, d)[0].drop("selector_saw_outer_test")


@query(sql(ADAPT + """, per AS (SELECT budget, held, avg(mae_absolute_soh) AS a, avg(mae_delta) AS dl, count(*) AS n, count_if(lam = 0) AS z FROM cells GROUP BY 1, 2),
  o AS (SELECT budget, sum(n)::bigint AS n_cells, avg(a) AS family_macro_mae_absolute_soh, max(a) AS worst_family_mae_absolute_soh, stddev_pop(a) AS across_family_std, avg(dl) AS family_macro_mae_delta,
    sum(z)::bigint AS n_cells_lambda_zero, sum(z)::double / sum(n)::double AS share_lambda_zero FROM per GROUP BY 1)""",
           "o", "budget n_cells n_cells_lambda_zero", "family_macro_mae_absolute_soh worst_family_mae_absolute_soh across_family_std family_macro_mae_delta share_lambda_zero"))
def adaptation_curve(spark, d):
    """Error against the trajectory budget."""
    return _adaptation(spark, d)[1]


@query(sql(ADAPT + ", o AS (SELECT lam, count(*) AS n_cells, count(*)::double / sum(count(*)) OVER () AS share FROM cells GROUP BY 1)", "o", "n_cells", "lam share"))
def lambda_selection_counts(spark, d):
    """How often each transfer strength won."""
    return A.selection_counts(_adaptation(spark, d)[0], "lam")


# ---------------------------------------------------------------- service

_FC = ", ".join(
    f"max(CASE WHEN horizon = {h} THEN c_b + c0 * z1 + c1 * z2 END) AS d{h}" for h in (2, 4, 8))


@query(sql(DEPLOY + f""", lp AS (SELECT trajectory_id, max(reference_index) AS last_i, count(*) AS n_points, count_if(soh_observed <= 0.6) AS low FROM traj GROUP BY 1),
  an AS (SELECT f.*, (last - 0.85::double) / 0.07::double AS z1, (slope_full + 0.005::double) / 0.0013::double AS z2 FROM feat f JOIN lp USING (trajectory_id) WHERE reference_index = last_i AND n_points >= 20),
  fc AS (SELECT trajectory_id, reference_index, last, slope_full, {_FC} FROM an, dp GROUP BY ALL),
  pth AS (SELECT *, last AS s0, last + d2 AS s1, last + d4 AS s2, last + d8 AS s3 FROM fc),
  rr AS (SELECT *, CASE WHEN s0 <= 0.7::double THEN 0 WHEN s1 <= 0.7::double THEN (s0 - 0.7::double) / (s0 - s1) * 28 WHEN s2 <= 0.7::double THEN 28 + (s1 - 0.7::double) / (s1 - s2) * 28 WHEN s3 <= 0.7::double THEN 56 + (s2 - 0.7::double) / (s2 - s3) * 56 END AS rul_days FROM pth),
  o AS (SELECT trajectory_id::varchar AS battery_id, reference_index AS anchor_reference_index, last AS anchor_soh_observed, s1 AS predicted_soh_day28, s2 AS predicted_soh_day56, s3 AS predicted_soh_day112,
    last + 8 * slope_full AS baseline_predicted_soh_day112, s3 - 0.04::double AS interval_lo_day112, s3 + 0.04::double AS interval_hi_day112, 20 AS context_length, 0.04::double AS interval_half_width_day112, 0.9::double AS interval_coverage_nominal, 1.0::double AS alpha_day56, rul_days, CASE WHEN rul_days IS NULL THEN 'NO_CROSSING_WITHIN_112D' ELSE 'OK' END AS status FROM rr)""",
           "o", "battery_id anchor_reference_index status context_length", "anchor_soh_observed predicted_soh_day28 predicted_soh_day56 predicted_soh_day112 baseline_predicted_soh_day112 interval_lo_day112 interval_hi_day112 rul_days interval_half_width_day112 interval_coverage_nominal alpha_day56", digits=8), digits=8)
def fleet_prediction(spark, d):
    """Validated fleet forecast, one row per battery."""
    p = stored_points(spark, d)
    heads = L.deploy_heads(z_windows(spark, d), Z2, ALPHA_FIX)
    out, _ = G.predict_fleet(B.requests(p), heads, B.SPACE2, B.half_widths(spark))
    return out.select("battery_id", "anchor_reference_index", "status", "anchor_soh_observed", "predicted_soh_day28",
                      "predicted_soh_day56", "predicted_soh_day112", "baseline_predicted_soh_day112", "interval_lo_day112",
                      "interval_hi_day112", "rul_days", "context_length", "interval_half_width_day112",
                      "interval_coverage_nominal", "alpha_day56")


@query(sql(ZWIN.split(",\nfeat_all")[0] + """, a AS (SELECT trajectory_id, reference_index AS arrival, CASE WHEN trajectory_id % 4 = 1 AND reference_index = 30 THEN 29 ELSE reference_index END AS i, CASE WHEN trajectory_id % 4 = 2 AND reference_index = 3 THEN 95 ELSE soh_observed END AS x FROM traj WHERE trajectory_id % 7 <> 0 OR reference_index < 12),
  l AS (SELECT *, i <= lag(i) OVER (PARTITION BY trajectory_id ORDER BY arrival) AS bad FROM a), g AS (SELECT trajectory_id, count(*) AS n_points, count_if(x > 1.5 OR x <= 0) AS n_bad_values, count_if(bad) AS n_order FROM l GROUP BY 1),
  o AS (SELECT trajectory_id::varchar AS battery_id, 'INPUT_REFUSED_BY_SCHEMA' AS status, CASE WHEN n_bad_values > 0 THEN 'VALUE_RULE' WHEN n_order > 0 THEN 'ORDER' ELSE 'SHORT_HISTORY' END AS reason, n_points, n_bad_values, n_order FROM g WHERE n_bad_values > 0 OR n_order > 0 OR n_points < 20)""",
           "o", "battery_id status reason n_points n_bad_values n_order"))
def fleet_refusals(spark, d):
    """Batteries whose requests are refused, with the reason."""
    p = stored_points(spark, d)
    heads = L.deploy_heads(z_windows(spark, d), Z2, ALPHA_FIX)
    # Whole histories; every seventh battery is a new one, with a history that is too short.
    req = B.requests(p.where((F.col(KEY) % 7 != 0) | (F.col(POS) < 12))).withColumn("_t", F.col("battery_id").cast("long") % 4)
    t, i = F.col("_t"), F.col(POS)
    req = req.withColumns({
        "soh_observed": F.when((t == 2) & (i == 3), F.lit(95.0)).otherwise(F.col("soh_observed")),
        POS: F.when((t == 1) & (i == 30), F.lit(29)).otherwise(i),
    }).drop("_t")
    return G.predict_fleet(req, heads, B.SPACE2, B.half_widths(spark))[1]


def _stored(z, alphas):
    """Windows with predictions as an earlier run stored them, keyed by (horizon, held family).

    That run shares no code with the fit under test: weighted sums of joined rows, leave-one-out by a join of
    families, and the two-feature solve written out as columns.
    """
    z1, z2, y, w = (F.col(c) for c in (*Z2, "y_delta", "weight"))
    parts = {"sw": w, "g11": w * z1 * z1, "g12": w * z1 * z2, "g22": w * z2 * z2, "s1": w * z1, "s2": w * z2,
             "b1": w * z1 * y, "b2": w * z2 * y, "sy": w * y, "n": F.lit(1)}
    per = L.equal_weights(z).groupBy("horizon", "family").agg(*[F.sum(e).alias(c) for c, e in parts.items()])
    held = per.select("horizon", F.col("family").alias("held"))
    sums = held.join(per, "horizon").where("family <> held").groupBy("horizon", "held").agg(*[F.sum(c).alias(c) for c in parts])
    alpha = F.create_map(*[F.lit(v) for pair in alphas.items() for v in pair])[F.col("horizon")]
    a = sums.withColumn("k", F.col("n") / F.col("sw")).withColumns({
        "a11": F.expr("g11 * k") + alpha, "a12": F.expr("g12 * k"), "a22": F.expr("g22 * k") + alpha})
    c = a.withColumn("det", F.expr("a11 * a22 - a12 * a12")).withColumns({
        "c0": F.expr("(a22 * b1 - a12 * b2) * k / det"), "c1": F.expr("(a11 * b2 - a12 * b1) * k / det")})
    heads = c.select("horizon", F.col("held").alias("family"), "c0", "c1", F.expr("(sy - s1 * c0 - s2 * c1) / sw").alias("cb"))
    # One cell differs by rule, so that the comparison has something to find.
    off = F.when((F.col("horizon") == 4) & (F.col("family") == 2), F.lit(0.001)).otherwise(F.lit(0.0))
    pred = F.col("cb") + F.col("c0") * z1 + F.col("c1") * z2 + off
    return cut(z.join(settle(heads), ["horizon", "family"]).withColumn("frozen_predicted_delta", pred).drop("c0", "c1", "cb"))


REPLAY = GRAM + f""", fx(horizon, alpha) AS (VALUES {FIX_SQL}), tot AS (SELECT horizon, sum(n_rows)::bigint AS n, sum(n_traj)::bigint AS m FROM blk GROUP BY 1),
  o AS (SELECT horizon, family AS held, alpha, n_rows AS n_test_rows, n - n_rows AS n_train_rows, m - n_traj AS n_train_trajectories, CASE WHEN horizon = 4 AND family = 2 THEN 0.001 ELSE 0 END AS max_abs_diff, NOT (horizon = 4 AND family = 2) AS within_atol FROM blk JOIN tot USING (horizon) JOIN fx USING (horizon))"""


@query(sql(REPLAY, "o", "horizon held n_test_rows n_train_rows n_train_trajectories within_atol", "alpha max_abs_diff"))
def golden_replay(spark, d):
    """Refit at stored strengths against stored predictions."""
    keep = ["horizon", "family", KEY, POS, *Z2, "y_delta", "anchor_soh_observed"]
    stored = _stored(cut(z_windows(spark, d).select(*keep)), ALPHA_FIX)
    out = L.replay(stored, Z2, ALPHA_FIX, "frozen_predicted_delta", 1e-9)
    return out.withColumn("max_abs_diff", F.round("max_abs_diff", 9))


FOLD = SCORED + """, arms AS (SELECT 'FINAL_MODEL' AS arm, horizon, family, trajectory_id, pred_soh, target_soh_true FROM so UNION ALL
    SELECT 'STABILITY_BASELINE', horizon, family, trajectory_id, anchor_soh_observed + slope_full * horizon, target_soh_true FROM so),
  fr AS (SELECT arm, horizon, family AS held, sum(n)::bigint AS n_rows, count(*) AS n_trajectories, sum(s) / sum(n) AS mae, avg(m) AS trajectory_macro, sum(s) / sum(n) AS family_macro FROM (
    SELECT arm, horizon, family, trajectory_id, count(*) AS n, sum(abs(pred_soh - target_soh_true)) AS s, avg(abs(pred_soh - target_soh_true)) AS m FROM arms GROUP BY ALL) GROUP BY 1, 2, 3)"""


def _protocol(spark, d):
    z, heads = _lofo(spark, d)
    return G.protocol_scores(z, heads, Z2)


@query(sql(FOLD, "fr", "arm horizon held n_rows n_trajectories", "mae trajectory_macro family_macro"))
def fold_results(spark, d):
    """Fold results of model and baseline."""
    return G.fold_results(_protocol(spark, d))


@query(sql(FOLD + ", o AS (SELECT arm, avg(family_macro) AS family_macro_mae, avg(trajectory_macro) AS trajectory_macro_mae, max(family_macro) AS worst_family_mae, count(*) AS n_cells, sum(n_rows)::bigint AS n_windows FROM fr GROUP BY 1)",
           "o", "arm n_cells n_windows", "family_macro_mae trajectory_macro_mae worst_family_mae"))
def matched_horizon_summary(spark, d):
    """Matched-horizon aggregate per arm."""
    return G.matched_summary(G.fold_results(_protocol(spark, d)))


@query(sql(FOLD + """, hw(coverage, horizon, half_width) AS (VALUES (0.9::double, 2, 0.01::double), (0.9, 4, 0.02), (0.9, 8, 0.04), (0.95, 2, 0.015), (0.95, 4, 0.03), (0.95, 8, 0.06)),
  ci AS (SELECT coverage, a.horizon, family, trajectory_id, half_width, CASE WHEN target_soh_true BETWEEN pred_soh - half_width AND pred_soh + half_width THEN 1.0 ELSE 0.0 END::double AS i FROM arms a JOIN hw ON a.horizon = hw.horizon WHERE arm = 'FINAL_MODEL'),
  ct AS (SELECT coverage, horizon, family AS held, avg(s) AS trajectory_macro_coverage, min(s) AS worst_trajectory_coverage, count(*) AS n_trajectories FROM (SELECT coverage, horizon, family, trajectory_id, avg(i) AS s FROM ci GROUP BY ALL) GROUP BY 1, 2, 3),
  ca AS (SELECT coverage, horizon, family AS held, count(*) AS n_windows, avg(i) AS window_micro_coverage, avg(i) AS family_macro_coverage, avg(i) AS worst_family_coverage, 2 * avg(half_width) AS mean_interval_width, family AS worst_family, 1::bigint AS n_families FROM ci GROUP BY ALL),
  o AS (SELECT * FROM ca JOIN ct USING (coverage, horizon, held))""",
           "o", "horizon held n_windows n_trajectories worst_family n_families", "coverage window_micro_coverage mean_interval_width trajectory_macro_coverage worst_trajectory_coverage family_macro_coverage worst_family_coverage"))
def interval_cells(spark, d):
    """Coverage of stored half-widths per level, horizon and held-out family."""
    return G.interval_cells(_protocol(spark, d), B.half_widths(spark))


DIAG = L2SP + f""", dg AS (SELECT h.horizon, h.held, h.alpha, h.lam, c0, c1, o.n / o.sw AS k, g11, g12, g22, b1, b2, syy, c0 - {P0}::double AS e0, c1 - {P1}::double AS e1 FROM lh h JOIN lh_out o ON h.horizon = o.horizon AND h.held = o.held),
  dh AS (SELECT *, k * (syy - 2 * (c0 * b1 + c1 * b2) + c0 * c0 * g11 + 2 * c0 * c1 * g12 + c1 * c1 * g22) + alpha * (c0 * c0 + c1 * c1) + lam * (e0 * e0 + e1 * e1) AS objective,
    g11 * k + alpha + lam AS a11, g12 * k AS a12, g22 * k + alpha + lam AS a22, sqrt({P0}::double * {P0}::double + {P1}::double * {P1}::double) AS prior_norm FROM dg),
  o AS (SELECT horizon, held, objective, (a11 + a22 + sqrt((a11 - a22) ** 2 + 4 * a12 * a12)) / (a11 + a22 - sqrt((a11 - a22) ** 2 + 4 * a12 * a12)) AS condition_number,
    greatest(0, 1 - sqrt(e0 * e0 + e1 * e1) / prior_norm) AS prior_retention, sqrt(c0 * c0 + c1 * c1) AS coef_norm, prior_norm, 4 * sqrt(1e-6 * abs(objective) / (alpha + lam)) AS coef_bound FROM dh)"""


@query(sql(DIAG, "o", "horizon held", "objective condition_number prior_retention coef_norm prior_norm coef_bound", digits=6), digits=6)
def fit_diagnostics(spark, d):
    """Objective, conditioning and prior retention of the selected heads."""
    z, heads = _lofo(spark, d, alphas=L2SP_A, lambdas=L2SP_L, prior=PRIOR)
    return L.fit_diagnostics(z, Z2, heads, PRIOR)


# ---------------------------------------------------------------- censoring-aware remaining life

PASSES = 8


def censored_sql(p: str = "ch") -> str:
    """Active-set passes written out: a fit whose active set repeats no longer changes."""
    unc = blocks_sql("anchors", f"{p}_u", "rul_days", keys=("censored",), where="censored = 0")
    cols = "sw g11 g12 g22 s1 s2 b1 b2 sy".split()
    sums = ", ".join(f"sum({c}) AS {c}" for c in cols)
    text = f"""{unc},
{p}_grid(cand, alpha) AS (VALUES {', '.join(f'({i}, {a}::double)' for i, a in enumerate(L.ALPHAS))}),
{p}_fam AS (SELECT DISTINCT family FROM anchors),
{p}_sets AS (SELECT a.family AS held, a.family AS inner_family FROM {p}_fam a UNION ALL SELECT a.family, b.family FROM {p}_fam a JOIN {p}_fam b ON a.family <> b.family),
{p}_fits AS (SELECT *, held * 1000 + inner_family * 10 + cand AS fit FROM {p}_sets, {p}_grid),
{p}_base AS (SELECT fit, alpha, {sums} FROM {p}_fits f JOIN {p}_u u ON u.family <> held AND u.family <> inner_family GROUP BY fit, alpha),
{p}_c AS MATERIALIZED (SELECT a.family, z1, z2, rul_lower_bound_days AS c, 1.0::double / count(*) OVER (PARTITION BY trajectory_id) / m AS w FROM anchors a JOIN (SELECT family, count(DISTINCT trajectory_id) AS m FROM anchors WHERE censored = 1 GROUP BY 1) USING (family) WHERE censored = 1)"""
    solve = """(SELECT fit, (a22 * r1 - a12 * r2) / (a11 * a22 - a12 * a12) AS c0, (a11 * r2 - a12 * r1) / (a11 * a22 - a12 * a12) AS c1, s1, s2, sy, sw FROM (
    SELECT *, g11 - s1 * s1 / sw + alpha AS a11, g12 - s1 * s2 / sw AS a12, g22 - s2 * s2 / sw + alpha AS a22, b1 - s1 * sy / sw AS r1, b2 - s2 * sy / sw AS r2 FROM {src}))"""
    src = f"{p}_base"
    for i in range(PASSES):
        text += f",\n{p}_h{i} AS MATERIALIZED (SELECT fit, c0, c1, sy / sw - (s1 * c0 + s2 * c1) / sw AS c_b FROM {solve.format(src=src)})"
        if i == PASSES - 1:
            break
        act = ", ".join([
            "sum(w) AS sw", "sum(w * z1 * z1) AS g11", "sum(w * z1 * z2) AS g12", "sum(w * z2 * z2) AS g22", "sum(w * z1) AS s1", "sum(w * z2) AS s2",
            "sum(w * z1 * c) AS b1", "sum(w * z2 * c) AS b2", "sum(w * c) AS sy"])
        text += f""",
{p}_a{i} AS (SELECT f.fit, {act} FROM {p}_fits f JOIN {p}_h{i} h ON f.fit = h.fit JOIN {p}_c r ON r.family <> f.held AND r.family <> f.inner_family AND c0 * z1 + c1 * z2 + c_b < c GROUP BY f.fit),
{p}_b{i} AS (SELECT b.fit, b.alpha, {', '.join(f'b.{c} + coalesce(a.{c}, 0) AS {c}' for c in cols)} FROM {p}_base b LEFT JOIN {p}_a{i} a ON a.fit = b.fit)"""
        src = f"{p}_b{i}"
    last = f"{p}_h{PASSES - 1}"
    return text + f""",
{p}_all AS (SELECT f.*, c0, c1, c_b FROM {p}_fits f JOIN {last} h ON f.fit = h.fit),
{p}_sc AS (SELECT held, inner_family, cand, avg(abs(c0 * z1 + c1 * z2 + c_b - rul_days)) AS score FROM anchors a JOIN {p}_all f ON a.family = f.inner_family AND f.held <> f.inner_family WHERE censored = 0 GROUP BY ALL),
{p}_sel AS (SELECT held, arg_min(cand, (round(s, 15), cand)) AS cand FROM (SELECT held, cand, avg(score) AS s FROM {p}_sc GROUP BY ALL) GROUP BY 1),
{p} AS (SELECT a.* FROM {p}_all a JOIN {p}_sel s ON a.held = s.held AND a.cand = s.cand WHERE a.held = a.inner_family)"""


CENS = ANCHORS + "," + censored_sql()


def _anchors(spark, d):
    keep = ["family", KEY, POS, "reference_day", "last", "slope_full", *Z2, "rul_days", "rul_lower_bound_days", "censored", "n_censored_rows"]
    return cut(z_anchors(spark, d).select(*keep))


@query(sql(CENS, "ch", "held cand", "alpha c0 c1 c_b", digits=6), digits=6)
def censored_heads(spark, d):
    """M5, M7: censoring-aware heads, strength chosen on inner folds."""
    return L.censored_heads(_anchors(spark, d), Z2).select("held", "cand", "alpha", "c0", "c1", "c_b")


RUL = CENS + """, rp AS (SELECT a.*, alpha, c_b + c0 * z1 + c1 * z2 AS pred_rul FROM anchors a JOIN ch ON a.family = ch.held)"""
TM = """, tmean AS (SELECT f.family, avg(a.rul_days) AS train_mean FROM ch_fam f JOIN anchors a ON a.family <> f.family AND censored = 0 GROUP BY 1)"""


@query(sql(RUL, "rp", "trajectory_id reference_index censored", "pred_rul", digits=6), digits=6)
def rul_predictions(spark, d):
    """M9: out-of-family remaining life of every anchor."""
    a = _anchors(spark, d)
    return L.rul_predict(a, Z2, L.censored_heads(a, Z2)).select(KEY, POS, "censored", "pred_rul")


@query(sql(RUL + TM + f""", o AS (SELECT family, any_value(alpha) AS alpha, count_if(censored = 0) AS n_anchors_uncensored, count_if(censored = 1) AS n_anchors_censored,
  avg(CASE WHEN censored = 0 THEN abs(pred_rul - rul_days) END) AS mae_days, sqrt(avg(CASE WHEN censored = 0 THEN (pred_rul - rul_days) ** 2 END)) AS rmse_days,
  avg(CASE WHEN censored = 0 THEN abs({SLOPE_RUL} - rul_days) END) AS mae_days_slope_extrapolation, avg(CASE WHEN censored = 0 THEN abs(train_mean - rul_days) END) AS mae_days_constant_mean,
  avg(CASE WHEN censored = 1 THEN CASE WHEN pred_rul >= rul_lower_bound_days THEN 1.0 ELSE 0.0 END END) AS censored_consistent_fraction, count_if(censored = 1 AND pred_rul < rul_lower_bound_days) AS n_censored_violations
  FROM rp JOIN tmean USING (family) GROUP BY 1)""", "o", "family n_anchors_uncensored n_anchors_censored n_censored_violations",
           "alpha mae_days rmse_days mae_days_slope_extrapolation mae_days_constant_mean censored_consistent_fraction", digits=6), digits=6)
def mission_span_rul(spark, d):
    """M8, M9: mission-span remaining life per held-out family, with its baselines."""
    a = _anchors(spark, d)
    return G.rul_outer(a, L.censored_heads(a, Z2), Z2)


@query(sql(RUL + """, rs AS (SELECT family, abs(pred_rul - rul_days) AS err FROM rp WHERE censored = 0), rk AS (SELECT family, err, row_number() OVER (PARTITION BY family ORDER BY err) AS rn, count(*) OVER (PARTITION BY family) AS n FROM rs),
  q AS (SELECT family, err AS half_width FROM rk WHERE rn = least(ceil((n + 1) * 0.9::double)::bigint, n)), hw AS (SELECT family, (sum(half_width) OVER () - half_width) / (count(*) OVER () - 1) AS crossfit_half_width FROM q),
  o AS (SELECT family, any_value(crossfit_half_width) AS crossfit_half_width, avg(CASE WHEN err <= crossfit_half_width THEN 1.0 ELSE 0.0 END) AS coverage, count(*) AS n FROM rs JOIN hw USING (family) GROUP BY 1)""",
           "o", "family n", "crossfit_half_width coverage", digits=6), digits=6)
def rul_crossfit(spark, d):
    """C3 on remaining life: cross-fit half-widths of the censoring-aware model."""
    a = _anchors(spark, d)
    p = L.rul_predict(a, Z2, L.censored_heads(a, Z2)).where("censored = 0")
    return C.crossfit(p.withColumn("resid", F.col("pred_rul") - F.col("rul_days")), "resid", 0.9)


FACTS = CENS + """, uw AS (SELECT a.family, z1, z2, rul_days AS y, 1.0::double / count(*) OVER (PARTITION BY trajectory_id) / m AS w FROM anchors a JOIN (SELECT family, count(DISTINCT trajectory_id) AS m FROM anchors WHERE censored = 0 GROUP BY 1) USING (family) WHERE censored = 0),
  fu AS (SELECT h.held, h.alpha, count(*) AS n_uncensored, sum(w * (y - c0 * z1 - c1 * z2 - c_b) ** 2) + any_value(h.alpha * (c0 * c0 + c1 * c1)) AS ou FROM ch h JOIN uw ON uw.family <> h.held GROUP BY 1, 2),
  fc AS (SELECT h.held, count(*) AS n_censored, count_if(c0 * z1 + c1 * z2 + c_b < c) AS n_active, sum(w * greatest(0, c - c0 * z1 - c1 * z2 - c_b) ** 2) AS oc FROM ch h JOIN ch_c r ON r.family <> h.held GROUP BY 1),
  o AS (SELECT held, alpha, true AS converged, n_active, n_uncensored, n_censored, ou + oc AS objective FROM fu JOIN fc USING (held))"""


@query(sql(FACTS, "o", "held converged n_active n_uncensored n_censored", "alpha objective", digits=4), digits=4)
def censored_fit_facts(spark, d):
    """M5: the selected fits have converged; their active rows and objective."""
    heads = L.censored_heads(_anchors(spark, d), Z2)
    return heads.select("held", "alpha", "converged", "n_active", "n_uncensored", "n_censored", "objective")


# ---------------------------------------------------------------- arms

ARMS_SOH = SCORED + "," + ridge_sql("zwin", "blk", "lh", L2SP_A, L2SP_L, prior=(P0, P1)) + """,
  sa AS (SELECT s.horizon, s.family, y_delta, slope_full * s.horizon AS lt, pred_delta, c_b + c0 * z1 + c1 * z2 AS p2 FROM so s JOIN lh ON s.horizon = lh.horizon AND s.family = lh.held),
  sl AS (SELECT 'persistence' AS arm, horizon, family, avg(abs(y_delta)) AS mae FROM sa GROUP BY ALL UNION ALL SELECT 'observable_local_trend', horizon, family, avg(abs(lt - y_delta)) FROM sa GROUP BY ALL UNION ALL
    SELECT 'target_only_ridge', horizon, family, avg(abs(pred_delta - y_delta)) FROM sa GROUP BY ALL UNION ALL SELECT 'l2sp_transfer', horizon, family, avg(abs(p2 - y_delta)) FROM sa GROUP BY ALL),
  soh_arms AS (SELECT 'SOH_DELTA' AS task, arm, horizon, avg(mae) AS family_macro, max(mae) AS worst_family, stddev_pop(mae) AS across_family_std FROM sl GROUP BY ALL)"""


def _soh_arms(spark, d):
    z, ridge = _lofo(spark, d)
    return G.soh_arms(z, ridge, L.lofo_fit(z, Z2, L2SP_A, L2SP_L, PRIOR), Z2)


@query(sql(ARMS_SOH, "soh_arms", "task arm horizon", "family_macro worst_family across_family_std"))
def soh_arms(spark, d):
    """The state-of-health arms under one protocol."""
    return _soh_arms(spark, d).drop("per_family")


@query(sql(ARMS_SOH + """, p AS (SELECT task, arm, avg(family_macro) AS family_macro, avg(across_family_std) AS s FROM soh_arms GROUP BY ALL),
  q AS (SELECT *, row_number() OVER w AS arm_rank, lead(family_macro) OVER w - family_macro AS gap_to_next, avg(s) OVER (PARTITION BY task) AS mean_across_family_std FROM p WINDOW w AS (PARTITION BY task ORDER BY family_macro, arm)),
  o AS (SELECT *, first_value(gap_to_next) OVER (PARTITION BY task ORDER BY arm_rank) > mean_across_family_std AS separable FROM q)""",
           "o", "task arm arm_rank separable", "family_macro gap_to_next mean_across_family_std"))
def arm_ranking(spark, d):
    """A10, O3: arms best first, and whether the top margin exceeds the family spread."""
    return A.rank_arms(_soh_arms(spark, d))


ARMS_RUL = RUL + TM + "," + WIENER[WIENER.index("inc AS"):] + f""",
  ra AS (SELECT r.family, rul_days, pred_rul, train_mean, {SLOPE_RUL} AS ps, {WRUL.format(s='last')} AS pw FROM rp r JOIN tmean USING (family) JOIN wiener w USING (trajectory_id, reference_index) WHERE censored = 0),
  rl AS (SELECT 'constant_mean' AS arm, family, avg(abs(train_mean - rul_days)) AS mae FROM ra GROUP BY ALL UNION ALL SELECT 'slope_extrapolation', family, avg(abs(ps - rul_days)) FROM ra GROUP BY ALL UNION ALL
    SELECT 'wiener_process', family, avg(abs(pw - rul_days)) FROM ra GROUP BY ALL UNION ALL SELECT 'censoring_aware_ridge', family, avg(abs(pred_rul - rul_days)) FROM ra GROUP BY ALL),
  rarms AS (SELECT 'MISSION_SPAN_RUL' AS task, arm, -1 AS horizon, avg(mae) AS family_macro, max(mae) AS worst_family, stddev_pop(mae) AS across_family_std FROM rl GROUP BY ALL)"""


@query(sql(ARMS_RUL, "rarms", "task arm horizon", "family_macro worst_family across_family_std", digits=6), digits=6)
def rul_arms(spark, d):
    """The remaining-life arms under one protocol."""
    a = _anchors(spark, d)
    fits = W.wiener_fit(points(spark, d))
    return G.rul_arms(a, fits, L.censored_heads(a, Z2), Z2).drop("per_family")


# ---------------------------------------------------------------- pretraining and own space

_PS = Space(FIRST2, (0.0, -1.0), (2.0, 1.0), (0.85, -0.005), (0.07, 0.0013))
PRE = SRC + f""", zz AS (SELECT *, (last - 0.85::double) / 0.07::double AS z1, (slope_full + 0.005::double) / 0.0013::double AS z2 FROM srcw),
  m AS (SELECT count(*) AS n, sum(z1 * z1) + 10 AS a11, sum(z1 * z2) AS a12, sum(z2 * z2) + 10 AS a22, sum(z1 * y_delta) AS r1, sum(z2 * y_delta) AS r2 FROM zz),
  cc AS (SELECT (a22 * r1 - a12 * r2) / (a11 * a22 - a12 * a12) AS c0, (a11 * r2 - a12 * r1) / (a11 * a22 - a12 * a12) AS c1 FROM m),
  o AS (SELECT count(*) AS n_windows, count(DISTINCT cell_id) AS n_cells, avg(abs(z1 * c0 + z2 * c1 - y_delta)) AS mae_in_sample, 10.0::double AS alpha, any_value(c0) AS c0, any_value(c1) AS c1,
    any_value((c0 * {P0}::double + c1 * {P1}::double) / (sqrt(c0 * c0 + c1 * c1) * sqrt({P0}::double * {P0}::double + {P1}::double * {P1}::double))) AS cosine_to_prior FROM zz, cc)"""


@query(sql(PRE, "o", "n_windows n_cells", "mae_in_sample alpha c0 c1 cosine_to_prior"))
def source_pretraining(spark, d):
    """Unweighted ridge on public cells."""
    w = apply_space(W.source_windows(B.cell_cycles(stored_points(spark, d))), _PS)
    w = cut(w.select("cell_id", *Z2, "y_delta"))
    return L.pretrain(w, Z2, 10.0, PRIOR)


OWN = ZWIN + """, w8 AS (SELECT * REPLACE (CASE WHEN (trajectory_id * 7 + reference_index) % 97 <> 0 THEN last END AS last) FROM win WHERE horizon = 8), ff AS (SELECT DISTINCT family AS held FROM w8), fo AS (SELECT w.*, held FROM w8 w, ff),
  lg AS (SELECT held, 'last' AS f, last AS x FROM fo WHERE family <> held UNION ALL SELECT held, 'slope_full', slope_full FROM fo WHERE family <> held),
  bd AS (SELECT held, f, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM lg GROUP BY 1, 2),
  sp AS (SELECT held, f, any_value(lo) AS lo, any_value(hi) AS hi, avg(least(greatest(x, lo), hi)) AS m, stddev_pop(least(greatest(x, lo), hi)) AS s FROM lg JOIN bd USING (held, f) WHERE x IS NOT NULL GROUP BY 1, 2),
  oz AS (SELECT fo.*, (least(greatest(last, a.lo), a.hi) - a.m) / a.s AS z1, (least(greatest(slope_full, b.lo), b.hi) - b.m) / b.s AS z2 FROM fo JOIN sp a ON a.held = fo.held AND a.f = 'last' JOIN sp b ON b.held = fo.held AND b.f = 'slope_full' WHERE last IS NOT NULL AND slope_full IS NOT NULL),""" + blocks_sql(
    "oz", "ob", keys=("held",), where="family <> held") + f""", os AS (SELECT held, {SUMS} FROM ob GROUP BY 1),
  oa AS (SELECT *, g11 * n / sw + 1 AS a11, g12 * n / sw AS a12, g22 * n / sw + 1 AS a22, b1 * n / sw AS r1, b2 * n / sw AS r2 FROM os), oc AS (SELECT *, (a22 * r1 - a12 * r2) / (a11 * a22 - a12 * a12) AS c0, (a11 * r2 - a12 * r1) / (a11 * a22 - a12 * a12) AS c1 FROM oa),
  o AS (SELECT z.held, count(*) AS n_test_rows, avg(abs(sy / sw - (s1 * c0 + s2 * c1) / sw + c0 * z1 + c1 * z2 - y_delta)) AS mae_delta FROM oz z JOIN oc c ON z.held = c.held WHERE z.family = z.held GROUP BY 1)"""


@query(sql(OWN, "o", "held n_test_rows", "mae_delta"))
def own_space_arm(spark, d):
    """Target-only heads on a space fitted on each fold's training families; some features are missing."""
    w = windows(spark, d, (8,))
    w = w.withColumn("last", F.when((F.col(KEY) * 7 + F.col(POS)) % 97 != 0, F.col("last")))
    return G.own_space_arm(w.select("horizon", "family", KEY, *FIRST2, "y_delta"), FIRST2, 1.0)


@query()
def eleven_feature_protocol(spark, d):
    """M7-M9 on all 11 features, the protocol's own size."""
    keep = ["horizon", "family", KEY, *B.SPACE11.columns(), "y_delta", "anchor_soh_observed", "target_soh_true"]
    z = cut(apply_space(windows(spark, d), B.SPACE11).select(*keep))
    cols = B.SPACE11.columns()
    return L.lofo_evaluate(z, cols, L.lofo_fit(z, cols)).drop("selector_saw_outer_test")


