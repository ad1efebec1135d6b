"""Plans that must hold at scale: pruned scans, small shuffles, no joins between rows."""

from conftest import SMALL
from pyspark.sql import functions as F

from cellfleet.catalog.registry import Z2, z_windows
from cellfleet.functions.forecast import scale_drivers
from cellfleet.operators import aggregates as A
from cellfleet.operators import learning as L
from cellfleet.operators import replay as D
from cellfleet.operators import windows as W
from cellfleet.plans.small import cut
from cellfleet.sources import testbed as B


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_used_columns_and_pushes_filters(spark):
    t = B.telemetry(spark, SMALL).where(F.col("ts") >= F.lit("1999-01-01").cast("timestamp_ntz"))
    p = plan(t.groupBy("scenario_id").agg(F.max("voltage_v")))
    schema = p.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_suppkey", "l_tax", "l_shipdate"}
    assert "GreaterThanOrEqual(l_shipdate" in p


def test_envelope_aggregates_before_the_shuffle(spark):
    p = plan(A.telemetry_envelope(B.telemetry(spark, SMALL)))
    assert p.count("Exchange") == 1 and "partial_max" in p


def test_all_horizons_share_one_window_pass(points):
    p = plan(W.with_target(points, (2, 4, 8)))
    assert p.count("Exchange") == 1 and p.count("Window [") == 1 and p.count("Sort [") == 1


def test_budget_keeps_few_ids_per_task(points):
    assert "WindowGroupLimit" in plan(W.budget_members(points, 5))


def test_cases_multiply_rows_without_a_join(spark):
    p = plan(scale_drivers(cut(B.drivers(spark, SMALL)), D.CASES))
    assert "Join" not in p and "Exchange" not in p


def test_scoring_broadcasts_heads_and_shuffles_sums(spark):
    z = cut(z_windows(spark, SMALL).select("horizon", "family", "trajectory_id", *Z2, "y_delta"))
    heads = L.candidate_heads(L.moments(L.gram(z, Z2), 2), L.ALPHAS)
    p = plan(L.score_candidates(z, Z2, heads))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
    # One exchange, of sums: rows are numbered by a broadcast join below it and meet no heads there.
    assert p.count("Exchange hashpartitioning") == 1 and p.index("Exchange hashpartitioning") < p.index("MapInArrow")
    assert p.count("BroadcastHashJoin") == 2 and p.index("MapInArrow") < p.rindex("BroadcastHashJoin")


def test_statistics_shuffle_trajectory_sums_only(spark):
    z = cut(z_windows(spark, SMALL).select("horizon", "family", "trajectory_id", *Z2, "y_delta"))
    p = plan(L.gram(z, Z2))
    assert "Join" not in p and p.count("partial_sum") > 0 and p.count("Exchange") == 2
