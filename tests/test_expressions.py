"""Expressions, contracts, sources and sinks."""

import hashlib
import json
import math
import os

import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

from cellfleet.functions import forecast as X
from cellfleet.operators import aggregates as A
from cellfleet.operators import contracts as V
from cellfleet.operators import earliness as P
from cellfleet.operators import fleet as G
from cellfleet.operators import joins as J
from cellfleet.functions.space import Space, clip
from cellfleet.operators import windows as W
from cellfleet.operators.replay import declared_contract
from cellfleet.plans.small import collect_bounded, local_table, settle
from cellfleet.sources import sinks, tables
from cellfleet.sources import testbed as B


def one(spark, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])


PATHS = [
    ((0.69, 0.68, 0.67, 0.66), 0.0, X.AT_ANCHOR, "anchor"),
    ((0.75, 0.65, 0.60, 0.55), 14.0, X.INTERPOLATED, "0->28d"),
    ((0.80, 0.78, 0.66, 0.60), 28 + 28 * 0.08 / 0.12, X.INTERPOLATED, "28->56d"),
    ((0.90, 0.85, 0.80, 0.70), 112.0, X.INTERPOLATED, "56->112d"),
    ((0.90, 0.85, 0.80, 0.75), None, X.NO_CROSSING, None),
    ((0.90, 0.65, 0.80, 0.60), 28 * 0.2 / 0.25, X.INTERPOLATED, "0->28d"),
]


@pytest.mark.parametrize("path, day, status, segment", PATHS)
def test_path_crossing(spark, path, day, status, segment):
    c = X.path_crossing([F.lit(v) for v in path], 0.70)
    r = spark.range(1).select(c["days"].alias("d"), c["status"].alias("s"), c["segment"].alias("g")).first()
    assert (r.s, r.g) == (status, segment)
    assert r.d is None if day is None else r.d == pytest.approx(day)


def test_path_is_never_extrapolated():
    with pytest.raises(ValueError):
        X.path_crossing([F.lit(1.0)] * 2, 0.7, (0, 140))


def test_warning_at_anchor_is_no_forecast(spark):
    df = one(spark, anchor_soh_observed=0.79, soh_h2=0.7, soh_h4=0.69, soh_h8=0.6)
    r = X.rul_readout(df).first()
    assert r.warning_days == 0.0 and r.warning_is_forecast is False and r.rul_days == 28.0


@pytest.mark.parametrize("t, a, want", [(10.0, 4.0, "TRUE_POSITIVE"), (4.0, 10.0, "LATE"), (4.0, None, "MISSED"),
                                        (None, 4.0, "FALSE_POSITIVE"), (None, None, "TRUE_NEGATIVE"), (4.0, 4.0, "TRUE_POSITIVE")])
def test_alarm_outcomes(spark, t, a, want):
    df = local_table(spark, [(t, a)], "t double, a double")
    assert df.select(X.alarm_outcome(F.col("t"), F.col("a"))).first()[0] == want


@pytest.mark.parametrize("mu, level, want", [(0.001, 0.65, 0.0), (0.0, 0.8, 3000.0), (-0.1, 0.8, 3000.0), (0.001, 0.8, 100.0), (1e-9, 0.8, 3000.0)])
def test_wiener_passage(spark, mu, level, want):
    df = local_table(spark, [(mu, level)], "m double, s double")
    assert df.select(X.wiener_rul(F.col("m"), F.col("s"))).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("last, slope, want", [(0.8, 0.0, 2000.0), (0.8, 0.1, 2000.0), (0.8, -0.01, 140.0), (0.6, -0.01, 0.0), (0.9, -1e-9, 3000.0)])
def test_slope_extrapolation(spark, last, slope, want):
    df = local_table(spark, [(last, slope)], "l double, s double")
    assert df.select(X.slope_rul(F.col("l"), F.col("s"))).first()[0] == pytest.approx(want)


def test_multipliers_must_be_positive(spark):
    with pytest.raises(ValueError):
        X.scale_drivers(one(spark, dod=0.3), [("bad", 0.0, -1.0, 1.0)])


def test_features_of_a_straight_line(spark):
    h = [0.95 - 0.15 * i / 19 for i in range(20)]
    df = local_table(spark, [(h,)], "ctx array<double>")
    r = W.features_of_ctx(df).first()
    step = -0.15 / 19
    assert r["last"] == h[-1] and r.slope_full == pytest.approx(step) and r.slope5 == pytest.approx(step)
    assert r.diff2 == pytest.approx(2 * step) and r.curvature == pytest.approx(0, abs=1e-15)
    mean = sum(h) / 20
    assert r.ctx_std == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in h) / 20))


def test_fault_signature_on_a_straight_decline(spark):
    pts = [("a", i, 14.0 * i, 1 - 0.01 * i, 1 - 0.01 * i) for i in range(21)]
    df = local_table(spark, pts, "trajectory_id string, reference_index long, reference_day double, soh_true double, soh_observed double")
    fault = dict(fault_type="x", onset_fraction=0.5, rint_mult=2.0, q_factor=1.0, temp_bias=0.0, dod_depth=0.0)
    out = W.perturb(df.withColumns({k: F.lit(v) for k, v in fault.items()})).orderBy("reference_index").collect()
    assert all(r.soh_true_faulted == pytest.approx(r.soh_true) for r in out[:11])
    assert out[20].soh_true_faulted == pytest.approx(0.9 - 10 * 0.01 * 1.9)
    step = W.perturb(df.withColumns({k: F.lit(v) for k, v in {**fault, "rint_mult": 1.0, "q_factor": 0.9}.items()})).orderBy("reference_index").collect()
    assert step[9].soh_true_faulted == pytest.approx(0.91) and step[10].soh_true_faulted == pytest.approx(0.81)


def test_trend_metrics(spark):
    rows_ = [("a", 0, 1.0, 1.0), ("a", 1, 0.9, 0.8), ("a", 2, 0.9, 0.9), ("a", 3, 0.8, 0.7), ("b", 0, 1.0, 1.0), ("b", 1, 1.0, 0.5)]
    df = local_table(spark, rows_, "trajectory_id string, reference_index long, t double, p double")
    got = {r.trajectory_id: r.direction_accuracy for r in A.direction_accuracy(df, "t", "p").collect()}
    assert got == {"a": 1.0, "b": 1.0}
    err = {r.trajectory_id: r.slope_error for r in A.slope_error(df, "t", "p").collect()}
    assert err["b"] == pytest.approx(0.5) and err["a"] == pytest.approx(abs(-0.08 + 0.06) / 0.06)


def test_late_alarms_are_counted(spark):
    pts = [("f", "a", 14.0 * i, 0.9 - 0.01 * i) for i in range(20)]
    p = local_table(spark, pts, "family string, trajectory_id string, reference_day double, soh_true double")
    pred = local_table(spark, [("a", 200.0, 0.75)], "trajectory_id string, reference_day double, pred_soh double")
    rec = P.lead_time(p, pred, 0.80)
    assert rec.first().outcome == "LATE"
    s = P.earliness_summary(rec).first()
    assert s.n_late == 1 and s.late_rate_of_crossers == 1.0 and s.false_alarm_rate_of_non_crossers is None
    assert s.dt_warn_median_days is None


def test_credible_window_of_single_points(spark):
    rows_ = [("a", i, 14.0 * i, 140.0 - 14 * i, p) for i, p in enumerate([140.0, 0.0, 112.0, 0.0])]
    df = local_table(spark, rows_, "trajectory_id string, reference_index long, reference_day double, rul_days double, pred_rul double")
    r = P.credible_window(df).first()
    assert r.credible_window_days == 0.0 and r.credible_window_start_day is None
    h = P.prognostic_horizon(df).first()
    assert h.ph_days == 0.0 and h.ph_entry_day is None and h.n_anchors_inside_band == 2


# ---------------------------------------------------------------- contracts


@pytest.mark.parametrize("col, rule", [("soh_true", "declared"), ("Target_x", "prefix"), ("my_TRUE", "suffix"), ("audit_a", "prefix"), ("raan_deg", "declared")])
def test_forbidden_columns(spark, col, rule):
    with pytest.raises(V.ContractError, match=rule):
        V.refuse_columns(one(spark, battery_id="a", **{col: 1.0}))
    assert V.refused_columns(["battery_id", "soh_observed"]) == {}


def test_column_contract(spark):
    good = one(spark, battery_id="a", reference_index=1, soh_observed=0.9)
    assert V.check_columns(good) is good
    for bad in (good.drop("soh_observed"), good.withColumn("extra", F.lit(1)), good.where("false"),
                good.select("*", F.col("soh_observed").alias("SOH_Observed"))):
        with pytest.raises(V.ContractError):
            V.check_columns(bad)


def test_join_cardinality_is_asserted(spark):
    left = local_table(spark, [(1,), (2,)], "k int")
    twice = local_table(spark, [(1, 5), (1, 6)], "k int, v int")
    with pytest.raises(V.ContractError):
        V.checked_join(left, twice, "k")
    with pytest.raises(V.ContractError):
        V.checked_join(left, twice.limit(1), "k", cover=True)
    assert V.checked_join(left, twice.limit(1), "k").count() == 2
    with pytest.raises(V.ContractError):
        V.checked_join(twice, left, "k", validate="1:1")


def test_overlay_refuses_key_drift(spark):
    a = local_table(spark, [("x", 1.0), ("y", 2.0)], "uid string, v double")
    b = local_table(spark, [("x", 9.0), ("z", 8.0)], "uid string, v double")
    with pytest.raises(Exception, match="disagree"):
        J.overlay(a, b, "uid", ["v"]).collect()


def test_driver_columns_are_refused(spark):
    d = one(spark, trajectory_id=1, reference_index=0, age_days=0.0, soh_true=1.0)
    with pytest.raises(V.ContractError):
        V.driver_violations(d, d, forbidden=["soh_true"])


def test_uncalibrated_level_is_refused(spark, points):
    heads = local_table(spark, [(h, 0.0, 0.0, -0.01) for h in (2, 4, 8)], "horizon int, c0 double, c1 double, c_b double")
    req = B.requests(points)
    with pytest.raises(V.ContractError):
        G.predict_fleet(req, heads, B.SPACE2, B.half_widths(spark), level=0.99)
    with pytest.raises(V.ContractError):
        G.predict_fleet(req.withColumn("split", F.lit("x")), heads, B.SPACE2)


def test_small_tables_are_checked(spark):
    df = spark.range(50)
    assert rows(settle(df)) == rows(df) and settle(df, 10) is df
    with pytest.raises(ValueError):
        collect_bounded(df, 10, "ids")


# ---------------------------------------------------------------- sources and sinks


def test_csv_with_byte_order_mark_and_other_column_order(spark, tmp_path):
    f = tmp_path / "l2.csv"
    f.write_bytes("﻿reference_index,trajectory_id,soh_true,reference_day,soh_observed\n3,a,0.9,42,0.91\n7,a,0.8,98,NaN\n".encode("utf-8"))
    m = tmp_path / "m.csv"
    m.write_text("trajectory_id,environment_family_id,right_censored_on_soh_true\na,f1,1\n")
    got = tables.read_trajectories(spark, str(f), str(m)).orderBy("reference_index").collect()
    r = got[0]
    assert (r.trajectory_id, r.reference_index, r.raw_index, r.soh_true, r.family) == ("a", 0, 3, 0.9, "f1")
    assert (got[1].reference_index, got[1].raw_index, got[1].soh_observed) == (1, 7, None)
    m.write_text("trajectory_id,environment_family_id,right_censored_on_soh_true\nb,f1,1\n")
    with pytest.raises(ValueError, match="cover"):
        tables.read_trajectories(spark, str(f), str(m))
    m.write_text("trajectory_id,right_censored_on_soh_true\na,1\n")
    with pytest.raises(ValueError, match="environment_family_id"):
        tables.read_trajectories(spark, str(f), str(m))


def test_clip_keeps_missing_values_missing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (-3.0,), (9.0,), (0.5,)], "x double")
    assert [r.c for r in df.select(clip(F.col("x"), 0.1, 0.9).alias("c")).collect()] == [None, None, 0.1, 0.9, 0.5]


def test_alphas_and_files_below_a_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"h2": 0.1, "4": 1}')
    assert tables.read_alphas(spark, str(tmp_path / "a.json")) == {2: 0.1, 4: 1.0}
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "x.bin").write_bytes(b"1")
    (tmp_path / "in" / "x.bin").write_bytes(b"2")
    assert {r.file for r in tables.file_inventory(spark, str(tmp_path / "in")).collect()} == {"x.bin", "deep/x.bin"}


def test_driver_contract_as_declared(spark):
    rule = declared_contract()
    drv = spark.createDataFrame([], ", ".join(f"{c} double" for c in rule["required"]))
    par = spark.createDataFrame([], ", ".join(f"{c} double" for c in rule["param_required"]))
    assert all(r.n == 0 for r in V.driver_violations(drv, par, **rule).collect())
    with pytest.raises(V.ContractError, match="leaked"):
        V.driver_violations(drv.withColumn("soh_true", F.lit(1.0)), par, **rule)
    with pytest.raises(V.ContractError, match="sensor_soh_sigma"):
        V.driver_violations(drv, par.drop("sensor_soh_sigma"), **rule)


@pytest.mark.parametrize("arrivals", [(100, 101), (100, 200_000)])
def test_order_is_judged_at_any_arrival_values(spark, arrivals):
    df = spark.createDataFrame([("b", arrivals[0], 5), ("b", arrivals[1], 4)], "battery_id string, arrival long, reference_index long")
    assert [r.n_bad for r in V.order_violations(df).collect()] == [1]


def test_absent_optional_input_is_empty(spark, tmp_path):
    t = tables.read_telemetry(spark, str(tmp_path / "none.parquet"), ["scenario_id", "efc"], required=False)
    assert t.count() == 0 and t.columns == ["scenario_id", "efc"]


def test_results_are_never_overwritten(spark, points, tmp_path):
    out = str(tmp_path)
    sinks.write_result(points, out, "pts", partition_by=["family"])
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_result(points, out, "pts")
    assert rows(spark.read.parquet(f"{out}/pts").select(*points.columns).withColumn("family", F.col("family").cast("long"))) == rows(points)
    sinks.write_summary(points.agg(F.count("*").alias("n")), out, "summary")
    assert spark.read.json(f"{out}/summary").first().n == points.count()


def test_cycles_space_and_half_widths(spark, tmp_path):
    (tmp_path / "c.csv").write_text("cell_id,cycle_idx,capacity\nx,2,1.8\nx,1,2.0\nx,3,NaN\nx,5,0\nx,9,1.5\n")
    got = [(r.cycle_idx, r.capacity) for r in tables.read_cycles(spark, str(tmp_path / "c.csv")).orderBy("cycle_idx").collect()]
    assert got == [(0, 2.0), (1, 1.8), (2, 1.5)]
    (tmp_path / "s.json").write_text('{"feature_names": ["last"], "clip_lo": [0], "clip_hi": [1], "scaler_mean": [0.5], "scaler_std": [0.1]}')
    assert tables.read_space(spark, str(tmp_path / "s.json")).mean == (0.5,)
    (tmp_path / "h.json").write_text('{"half_widths": {"P|A|0.9|h2": 0.01}}')
    r = tables.read_half_widths(spark, str(tmp_path / "h.json")).first()
    assert (r.protocol, r.coverage, r.horizon, r.half_width) == ("P", 0.9, 2, 0.01)


def test_replay_configuration_and_prior(spark, tmp_path):
    five = {"calendar_scale": 1.1, "cycle_scale": 0.9, "knee_gain_scale": 1, "knee_start_offset": -0.01, "rint_growth_scale": 2}
    for i, text in enumerate((five, {"global_coefficients": five, "thresholds": {"eol": 0.7}})):
        (tmp_path / f"r{i}.json").write_text(json.dumps(text))
        c = tables.read_replay_config(spark, str(tmp_path / f"r{i}.json"))
        assert (c.calendar_scale, c.knee_start_offset, c.rint_growth_scale, c.temperature_reference_c) == (1.1, -0.01, 2.0, 25.0)
    (tmp_path / "bad.json").write_text(json.dumps({"calendar_scale": 1}))
    with pytest.raises(ValueError, match="cycle_scale"):
        tables.read_replay_config(spark, str(tmp_path / "bad.json"))
    space = Space(("a", "b"), (0, 0), (1, 1), (0, 0), (1, 1))
    text = json.dumps({"feature_names": ["a", "b"], "coef": [[1, 2], [3, 4]], "intercept": [0.5, 0.25]})
    (tmp_path / "p.json").write_text(text)
    path = str(tmp_path / "p.json")
    p = tables.read_prior(spark, path, space, hashlib.sha256(text.encode()).hexdigest())
    assert p.at(2).tolist() == [3.0, 4.0] and p.intercept == {1: 0.5, 2: 0.25}
    with pytest.raises(ValueError, match="outside"):
        p.at(3)
    with pytest.raises(ValueError, match="digest"):
        tables.read_prior(spark, path, space, "0" * 64)
    with pytest.raises(ValueError, match="order"):
        tables.read_prior(spark, path, Space(("b", "a"), (0, 0), (1, 1), (0, 0), (1, 1)))


def test_files_are_hashed_in_pieces(spark, tmp_path):
    """Short and long ones, names with spaces, folders below, and one of over 2 GB (sparse)."""
    (tmp_path / "deep" / "er").mkdir(parents=True)
    files = {"a.bin": b"x" * 10, "deep/b c.bin": bytes(range(256)) * 5000, "deep/er/d%20.bin": b"y" * 70_000}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    want = {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in files.items()}
    for whole in (None, 50_000, 0):
        got = {r["file"]: (r["n_bytes"], r["sha256"]) for r in tables.file_inventory(spark, str(tmp_path), whole).collect()}
        assert got == want
    big = tmp_path / "deep" / "big"
    with open(big, "wb") as f:
        f.truncate((2 << 30) + 12_345)
    digest, piece = hashlib.sha256(), bytes(1 << 20)
    for _ in range(2 << 10):
        digest.update(piece)
    digest.update(bytes(12_345))
    got = {r["file"]: (r["n_bytes"], r["sha256"]) for r in tables.file_inventory(spark, str(tmp_path)).collect()}
    assert got == want | {"deep/big": ((2 << 30) + 12_345, digest.hexdigest())}
    os.truncate(big, 5)
    stale = local_table(spark, [("a.bin", "0"), ("deep/big", hashlib.sha256(bytes(5)).hexdigest()), ("gone", "0")], "file string, sha256 string")
    status = dict(tables.reconcile_files(spark, str(tmp_path), stale).select("file", "status").collect())
    assert (status["a.bin"], status["deep/big"], status["gone"], status["deep/er/d%20.bin"]) == ("MISMATCH", "OK", "MISSING", "UNLISTED")


def test_approximate_space_is_close(spark, points):
    w = W.with_target(points, (8,))
    a, b = A.fit_space(w), A.fit_space(w, approximate=True)
    assert a.clip_lo == pytest.approx(b.clip_lo, abs=0.01) and SMALL
