"""A trajectory with a third of all rows is cut into chunks without changing any result."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cellfleet.functions.forecast import slope_rul
from cellfleet.operators import aggregates as A
from cellfleet.operators import contracts as V
from cellfleet.operators import earliness as P
from cellfleet.operators import replay as D
from cellfleet.operators import windows as W
from cellfleet.plans import scan
from cellfleet.plans.small import cut
from cellfleet.sources import testbed as B

SMALL = "/root/testdata/sf0.001"


def _anchors(p):
    a = W.rul_anchors(p)
    return a.withColumn("pred_rul", F.least(slope_rul(F.col("last"), F.col("slope_full")), F.lit(600.0)))


OPERATORS = {
    "context": lambda p: W.context_windows(p),
    "features": lambda p: W.features11(p),
    "targets": lambda p: W.with_target(p, (2, 4, 8)),
    "anchors": lambda p: W.rul_anchors(p),
    "lags": lambda p: W.with_lag(p, ["soh_true"]),
    "running": lambda p: W.running_sum(p, "soh_observed"),
    "halves": lambda p: W.half_rates(p),
    "monotone": lambda p: W.monotonicity(p, "soh_observed"),
    "prefix": lambda p: W.prefix_stats(p),
    "wiener": lambda p: W.wiener_fit(p),
    "stride": lambda p: W.stride(p, 7),
    "ordinal": lambda p: scan.with_ordinal(p.where("reference_index % 3 <> 1")),
    "source": lambda p: W.source_windows(B.cell_cycles(p)),
    "horizon": lambda p: P.prognostic_horizon(_anchors(p)),
    "credible": lambda p: P.credible_window(_anchors(p)),
    "direction": lambda p: A.direction_accuracy(p, "soh_true", "soh_observed"),
    "directionality": lambda p: A.directionality(p),
    "slope": lambda p: A.ordinal_slope(p, ["soh_observed"]),
    "faulted": lambda p: D.faulted(p, D.assign_faults(p)),
    "order": lambda p: V.order_violations(B.requests(p).withColumn("reference_index", F.col("reference_index") - F.when(F.col("reference_index") % 31 == 30, 2).otherwise(0))),
    "short": lambda p: V.split_short_groups(p, 60, "trajectory_id", "reference_index")[0],
}


@pytest.mark.parametrize("name", OPERATORS)
def test_chunks_change_nothing(hot_points, monkeypatch, name):
    digits = 10 if name == "faulted" else 8
    want = rows(OPERATORS[name](hot_points), digits)
    monkeypatch.setattr(scan, "CHUNK", 40)
    assert rows(OPERATORS[name](hot_points), digits) == want


def test_replay_in_chunks(spark, monkeypatch):
    drv, par = B.drivers(spark, SMALL), B.parameters(spark, SMALL)
    want = rows(D.replay_damage(drv, par), 8)
    monkeypatch.setattr(scan, "CHUNK", 40)
    assert rows(D.replay_damage(drv, par), 8) == want


def test_hot_user_is_cut_by_time(spark):
    assert rows(B.trajectories(spark, SMALL, hot_rows=20)) == rows(B.trajectories(spark, SMALL))


def test_windows_partition_by_chunk(hot_points):
    plan = W.features11(hot_points)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "hashpartitioning(trajectory_id" in plan and "chunk" in plan.split("hashpartitioning(")[1].split(")")[0]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_after_a_shuffle_join_is_spread_by_chunk(spark, hot_points):
    """A join by trajectory must not leave a hot trajectory in one task of the next window."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        dim = hot_points.groupBy("trajectory_id").agg(F.count("*").alias("n"))
        plan = _plan(W.features11(hot_points.join(dim, "trajectory_id")))
        assert "SortMergeJoin" in plan and "REPARTITION_BY_COL" in plan
        spread = next(x for x in plan.splitlines() if "REPARTITION_BY_COL" in x)
        assert "chunk" in spread
        assert plan.index("REPARTITION_BY_COL") < plan.index("SortMergeJoin")
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("ts", ["{i}", "{i} * 1000003 + {i} % 7", "1000000 + {i} % 3 * 1e-6 * {i}", "CASE WHEN {i} < 3900 THEN 5.0 + {i} * 1e-9 ELSE {i} * 1e6 END"])
def test_hot_keys_split_evenly_whatever_their_numbers(spark, monkeypatch, ts):
    """Dense, far apart, and in bursts: one key with most rows meets in no task, and positions are the same."""
    df = spark.range(4400).selectExpr("id", "CASE WHEN id < 4000 THEN 1 ELSE id % 5 + 2 END AS k", f"CAST({ts.format(i='id')} AS double) AS ts")
    df = cut(df.orderBy(F.xxhash64("id")))
    want = rows(scan.ordered_scan(df, "k", ["ts", "id"], {"s": F.col("id")}, pos="p"))
    seen, real = [], scan._positions
    monkeypatch.setattr(scan, "_positions", lambda d, *a, **b: seen.append(d) or real(d, *a, **b))
    got = rows(scan.ordered_scan(df, "k", ["ts", "id"], {"s": F.col("id")}, hot_rows=1000, pos="p"))
    assert got == want
    largest = max(d.groupBy("k", "_seg").count().agg(F.max("count")).first()[0] for d in seen)
    assert largest <= 1000, "eight partitions share the hot key's 4000 rows"
