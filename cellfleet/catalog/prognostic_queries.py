"""Earliness of the learned models: records from heads that never saw a battery's family."""

from __future__ import annotations

from cellfleet.catalog.learning_queries import RUL, _anchors, blocks_sql, ridge_sql
from cellfleet.catalog.registry import Z2, Z_SQL, query, sql, stored_points, target_sql, z_windows
from cellfleet.catalog.report_queries import CW, LEAD, SUMMARY, SUMMARY_COUNTS, SUMMARY_DOUBLES, TREND8, _ph_sql
from cellfleet.functions.space import WARN_SOH
from cellfleet.operators import earliness as P
from cellfleet.operators import learning as L
from cellfleet.plans.scan import KEY, POS
from cellfleet.plans.small import cut

WARN = f"{WARN_SOH}::double"
RECORDS = RUL + "," + target_sql("feat", "win", (8,)) + f", zwin AS (SELECT *, {Z_SQL} FROM win)," + blocks_sql("zwin", "blk") + "," + ridge_sql(
    "zwin", "blk", "rh") + """, t8 AS (SELECT trajectory_id, reference_day, anchor_soh_observed + c_b + c0 * z1 + c1 * z2 AS pred_soh FROM zwin w JOIN rh ON w.horizon = rh.horizon AND w.family = rh.held)""" + LEAD.removeprefix(
    TREND8).replace("0.7::double", WARN) + ", sa AS (SELECT trajectory_id, reference_day, eol_day, rul_days, censored, pred_rul FROM rp)," + _ph_sql(
    "ph", 0) + "," + _ph_sql("pg", 14).replace("abs(pred_rul", "abs(greatest(pred_rul, 0)") + "," + CW + """,
  rec AS (SELECT l.*, ends.eol_day AS t_eol_day, ph.ph_entry_day, ph.ph_days, ph.n_anchors_inside_band, ph.n_anchors, pg.ph_days AS ph_days_gridfloor, pg.ph_entry_day AS ph_entry_day_gridfloor,
    pg.n_anchors_inside_band AS n_anchors_inside_band_gridfloor, credible_window_days, credible_window_start_day, credible_window_end_day, credible_window_lead_before_eol_days, ph.ph_days IS NOT NULL AS ph_defined
    FROM lead_ l JOIN ends USING (trajectory_id) LEFT JOIN ph USING (trajectory_id) LEFT JOIN pg USING (trajectory_id) LEFT JOIN cw USING (trajectory_id))"""


def learned_records(spark, d):
    """Nested leave-one-family-out heads for both quantities, then one record per trajectory."""
    p = stored_points(spark, d)
    keep = ["horizon", "family", KEY, POS, "reference_day", *Z2, "y_delta", "anchor_soh_observed"]
    z = cut(z_windows(spark, d, (8,)).select(*keep))
    soh = L.attach_heads(z, L.lofo_fit(z, Z2), Z2)
    a = _anchors(spark, d)
    return P.prognostic_records(p, soh, L.rul_predict(a, Z2, L.censored_heads(a, Z2)))


@query(sql(RECORDS, "rec", "family trajectory_id crossed alarmed outcome n_anchors_inside_band n_anchors n_anchors_inside_band_gridfloor ph_defined",
           "t_true_cross_day t_alarm_day dt_warn_days t_eol_day ph_entry_day ph_days ph_days_gridfloor ph_entry_day_gridfloor credible_window_days credible_window_start_day credible_window_end_day credible_window_lead_before_eol_days"))
def learned_prognostic_records(spark, d):
    """P8 on learned heads: warning 0.80 by forecasts, horizons and credible windows by remaining-life heads."""
    return learned_records(spark, d)


@query(sql(RECORDS + SUMMARY, "summ", SUMMARY_COUNTS, SUMMARY_DOUBLES))
def learned_earliness_summary(spark, d):
    """P6 on learned heads: outcome counts, rates, lead times and horizons of the fleet."""
    return P.earliness_summary(learned_records(spark, d))


@query(sql(RECORDS + """, pf AS (SELECT family, avg(CASE WHEN outcome = 'TRUE_POSITIVE' THEN dt_warn_days END) AS dt_warn_mean_days, count_if(outcome = 'TRUE_POSITIVE') AS n FROM lead_ GROUP BY 1),
  o AS (SELECT family, dt_warn_mean_days, n FROM pf UNION ALL SELECT NULL, avg(dt_warn_mean_days), sum(n)::bigint FROM pf)""", "o", "family n", "dt_warn_mean_days"))
def learned_lead_by_family(spark, d):
    """P7 on learned heads: lead of true positives by family, and of the families' mean."""
    return P.lead_by_family(learned_records(spark, d))
