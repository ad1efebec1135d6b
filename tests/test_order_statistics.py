"""Exact ranks and percentiles under skew, ties and outliers, with histogram rounds forced."""

import numpy as np
import pytest

from cellfleet.operators import conformal as C
from cellfleet.plans import ranks


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(5)
    groups = {
        "hot": np.concatenate([rng.normal(0, 1, 4000), [1e9, -1e9], np.full(1500, 0.25)]),
        "ties": np.full(700, 3.5),
        "few": np.array([2.0]),
        "wide": rng.lognormal(0, 3, 900),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("hot", None)]
    return spark.createDataFrame(rows, "g string, x double").repartition(6), groups


@pytest.mark.parametrize("sort_rows", [10, 200, 1_000_000])
def test_percentiles_match_linear_rule(values, monkeypatch, sort_rows):
    df, groups = values
    monkeypatch.setattr(ranks, "SORT_ROWS", sort_rows)
    got = {(r.g, r.fraction): r.value for r in ranks.percentiles(df, ["g"], "x", [0.0, 0.01, 0.5, 0.99, 1.0]).collect()}
    for g, vs in groups.items():
        for q in (0.0, 0.01, 0.5, 0.99, 1.0):
            assert got[(g, q)] == pytest.approx(np.quantile(vs, q), rel=1e-12, abs=1e-12)


def test_percentiles_without_keys(values):
    df, groups = values
    row = ranks.percentile_columns(df, [], "x", {"m": 0.5, "p": 0.9}).first()
    everything = np.concatenate(list(groups.values()))
    assert row.m == pytest.approx(np.quantile(everything, 0.5))
    assert row.p == pytest.approx(np.quantile(everything, 0.9))


def test_half_width_is_an_order_statistic(values, monkeypatch):
    df, groups = values
    monkeypatch.setattr(ranks, "SORT_ROWS", 50)
    got = {r.family: r.half_width for r in C.family_half_widths(df.withColumnRenamed("g", "family"), "x", 0.9).collect()}
    for g, vs in groups.items():
        k = min(int(np.ceil((len(vs) + 1) * 0.9)), len(vs))
        assert got[g] == np.sort(np.abs(vs))[k - 1]


def test_crossfit_uses_the_other_families(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 4.0), ("c", 8.0)], "family string, r double")
    got = {r.family: (r.crossfit_half_width, r.coverage) for r in C.crossfit(df, "r", 0.9).collect()}
    assert got == {"a": (6.0, 1.0), "b": (5.0, 1.0), "c": (3.0, 0.0)}
    assert C.crossfit_summary(C.crossfit(df, "r", 0.9)).first().worst_family == "c"


def test_empty_input(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert ranks.percentiles(df, ["g"], "x", [0.5]).count() == 0
    assert ranks.percentile_columns(df, [], "x", {"m": 0.5}).first().m is None


@pytest.mark.parametrize("odd", [float("nan"), float("inf"), None])
def test_values_that_are_not_finite_have_no_rank(spark, monkeypatch, odd):
    monkeypatch.setattr(ranks, "SORT_ROWS", 50)
    df = spark.createDataFrame([("a", float(i)) for i in range(500)] + [("a", odd), ("a", -1e308), ("a", 1.7e308)], "g string, x double")
    r = ranks.percentiles(df, ["g"], "x", [0.5]).first()
    assert (r.n, r.value) == (502, 249.5)
