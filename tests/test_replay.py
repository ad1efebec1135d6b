"""Replay, scenarios and calibration on the smallest fleet."""

import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

from cellfleet.operators import replay as D
from cellfleet.operators import windows as W
from cellfleet.plans import scan
from cellfleet.plans.small import cut
from cellfleet.sources import testbed as B


@pytest.fixture(scope="module")
def tables(spark):
    return cut(B.drivers(spark, SMALL)), B.parameters(spark, SMALL)


def _reference(drv, par, cfg):
    g = D.replay_damage(drv, par, cfg)
    return cut(g.select("trajectory_id", "family", "split", "reference_index", F.col("soh_true").alias("soh_true_reference")))


def test_replay_is_deterministic_and_monotone(tables):
    a, b = D.replay_damage(*tables), D.replay_damage(*tables)
    assert rows(a) == rows(b)
    assert W.monotonicity(a).first().rises == 0


def test_stress_only_shortens_life(tables):
    _, summary = D.compare_scenarios(*tables)
    for r in summary.collect():
        assert r.n_direction_violations == 0 and r.mean_final_soh_change < 0


def test_same_coefficients_replay_exactly(tables):
    drv, par = tables
    m = D.replay_metrics(D.replay_damage(drv, par), _reference(drv, par, D.ReplayConfig()))
    assert all(r.mae < 1e-12 and r.r2 == pytest.approx(1.0) for r in m.collect())


def test_refinement_recovers_the_coefficients(tables):
    drv, par = tables
    ref = _reference(drv, par, D.ReplayConfig(0.9, 1.1, 1.0, 0.0))
    got = D.refine(drv, par, ref, (1.0, 1.0, 1.0, 0.0), (0.1, 0.1, 0.1, 0.01),
                   ((0.5, 1.5), (0.5, 1.5), (0.3, 2.0), (-0.05, 0.05)), rounds=3)
    assert got == pytest.approx((0.9, 1.1, 1.0, 0.0))


def test_long_series_stay_spread_after_the_parameter_join(tables, monkeypatch):
    monkeypatch.setattr(scan, "CHUNK", 40)
    plan = D.damage_increments(*tables)._jdf.queryExecution().executedPlan().toString()
    spread = [x for x in plan.splitlines() if "hashpartitioning" in x]
    assert spread and all("chunk" in x for x in spread)


@pytest.mark.parametrize("n, size", [(120, 15), (1600, 200), (3, 1)])
def test_faults_take_a_share_of_the_fleet(spark, n, size):
    """15 of 120 trajectories per class, and as large a share of any other fleet."""
    fleet = spark.range(n * 2).select((F.col("id") % n).alias("trajectory_id"), (F.col("id") % n % 6).alias("family"))
    got = sorted((r[1], r[0]) for r in D.assign_faults(fleet).select("trajectory_id", "fault_type").collect())
    names = [f[0] for f in W.FAULTS]
    want = sorted((names[i // size], i) for i in range(min(n, size * len(names))))
    assert got == want
