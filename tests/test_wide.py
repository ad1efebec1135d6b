"""Order statistics of many columns at once, spaces of folds, and the arm on its own space."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellfleet.functions.space import FEATURES
from cellfleet.operators import aggregates as A
from cellfleet.operators import fleet as G
from cellfleet.plans import wide
from cellfleet.plans.small import local_table


def table(seed=1, n=4000):
    """A heavy-tailed column, one of few values, one constant, one with a family apart; missing values of three kinds."""
    r = np.random.default_rng(seed)
    x = np.column_stack([r.standard_cauchy(n), r.integers(0, 3, n), np.full(n, 2.5), r.normal(size=n) * 1e-12, np.full(n, np.nan)])
    g = np.where(r.random(n) < 0.5, 2, r.integers(0, 5, n))  # one group has more than half of the rows
    x[g == 3, 3] += 1.0
    x[r.random(n) < 0.1, 0] = np.nan
    rows = [(int(f), *(None if np.isnan(v) and r.random() < 0.5 else float(v) for v in row)) for f, row in zip(g, x)]
    rows += [(1, float("inf"), 1.0, 2.5, 0.0, None), (None, 1e9, 9.0, 9.0, 9.0, 9.0)]
    return rows, "g long, a double, b double, c double, d double, e double"


def values(rows, column, fold):
    v = np.array([np.nan if r[column] is None else r[column] for r in rows if r[0] is not None and r[0] != fold], float)
    return v[np.isfinite(v)]


@pytest.mark.parametrize("few, bins", [(50_000, 200_000), (40, 200_000), (40, 400)])
def test_percentiles_and_moments_of_all_folds(spark, monkeypatch, few, bins):
    """Small limits force many passes; the result stays exact."""
    monkeypatch.setattr(wide, "FEW", few)
    rows, schema = table()
    df = local_table(spark, rows, schema).repartition(5)
    folds = wide.Folds(df, ["a", "b", "c", "d", "e"], "g")
    if bins < 1000:
        monkeypatch.setattr(folds, "_histogram", lambda spans, n, f=folds._histogram: f(spans, 16))
    got = folds.percentiles((0.01, 0.5, 0.99))
    bounds = {f: p[:, [0, 2]] for f, p in got.items()}
    moments = folds.clipped_moments(bounds)
    assert sorted(map(str, (folds.name(f) for f in got))) == ["0", "1", "2", "3", "4", "None"]
    for f, p in got.items():
        for c in range(4):
            v = values(rows, c + 1, folds.name(f))
            np.testing.assert_allclose(p[c], np.quantile(v, (0.01, 0.5, 0.99)), rtol=1e-12, atol=1e-24)
            v = np.clip(v, *bounds[f][c])
            np.testing.assert_allclose([moments[f][0][c], moments[f][1][c]], [v.mean(), v.std()], rtol=1e-9, atol=1e-12)
        assert np.isnan(p[4]).all() and np.isnan(moments[f][0][4])


def test_rows_are_read_as_often_with_more_groups(spark, monkeypatch):
    """The number of passes does not depend on the number of groups."""
    passes = []
    for n in (2, 40):
        df = spark.range(20_000).select((F.col("id") % n).alias("g"), F.rand(1).alias("a"), F.randn(2).alias("b"))
        monkeypatch.setattr(wide, "FEW", 2000)
        folds, count = wide.Folds(df, ["a", "b"], "g"), []
        monkeypatch.setattr(folds, "_pass", lambda *a, f=folds._pass: count.append(1) or f(*a))
        folds.clipped_moments(folds.percentiles((0.01, 0.99)))
        passes.append(len(count))
    assert passes[0] == passes[1] <= 4, passes


def test_plan_neither_unpivots_nor_copies_rows(spark):
    df = local_table(spark, *table())
    plan = wide.Folds(df, ["a", "b"], "g").df._jdf.queryExecution().toString()
    assert "Expand" not in plan and "Generate" not in plan and "Join" not in plan


def test_space_of_no_rows_and_constant_columns(spark):
    df = local_table(spark, *table())
    s = A.fit_space(df.where("g > 99"), ["a", "c"])
    assert s.clip_lo == s.mean == s.std == (None, None)
    s = A.fit_space(df, ["c", "e"])
    assert (s.clip_lo[0], s.mean[0], s.std[0]) == (2.5, 2.5, 1.0) and s.mean[1] is not None or s.std[1] is None


def plain_arm(rows, names, alpha):
    """Every fold by itself: clip, scale, weigh, solve, score."""
    x = np.array([[np.nan if r[n] is None else r[n] for n in (*names, "y_delta")] for r in rows], float)
    fam, traj = np.array([r["family"] for r in rows]), np.array([r["trajectory_id"] for r in rows])
    full = np.isfinite(x).all(axis=1)
    out = []
    for f in sorted(set(fam[full].tolist())):
        z, scale = np.empty((len(x), len(names))), []
        for j in range(len(names)):
            v = x[(fam != f) & np.isfinite(x[:, j]), j]
            lo, hi = np.quantile(v, (0.01, 0.99))
            v = np.clip(v, lo, hi)
            z[:, j] = (np.clip(x[:, j], lo, hi) - v.mean()) / (v.std() or 1.0)
        train, test = full & (fam != f), full & (fam == f)
        w = np.zeros(len(x))
        for g in set(fam[train].tolist()):
            ids = set(traj[train & (fam == g)].tolist())
            for t in ids:
                mine = train & (fam == g) & (traj == t)
                w[mine] = 1.0 / mine.sum() / len(ids)
        w = w[train] * train.sum() / w[train].sum()
        zt, y = z[train], x[train, -1]
        coef = np.linalg.solve((zt * w[:, None]).T @ zt + alpha * np.eye(len(names)), (zt * w[:, None]).T @ y)
        b = (w @ (y - zt @ coef)) / w.sum()
        out.append((f, int(test.sum()), float(np.abs(z[test] @ coef + b - x[test, -1]).mean())))
    return out


def test_own_space_arm_is_that_of_single_folds(spark):
    """Eleven features, missing and infinite ones, a family far from the others, one with a single trajectory."""
    r = np.random.default_rng(5)
    rows = []
    for t in range(40):
        family = min(t % 6, 5) if t != 39 else 6
        for i in range(int(r.integers(1, 30))):
            x = r.normal(size=11) * 10.0 ** np.arange(-5, 6) + (3 if family == 4 else 0)
            x = [None if r.random() < 0.01 else float("inf") if r.random() < 0.005 else float(v) for v in x]
            rows.append((8 if i % 9 else 4, family, t, *x, float(r.normal())))
    schema = "horizon int, family int, trajectory_id long, " + ", ".join(f"{n} double" for n in FEATURES) + ", y_delta double"
    df = local_table(spark, rows, schema)
    got = sorted(map(tuple, G.own_space_arm(df, FEATURES, 1.0).collect()))
    want = plain_arm([x.asDict() for x in df.where("horizon = 8").collect()], FEATURES, 1.0)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    np.testing.assert_allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-7)


def test_own_space_arm_needs_two_families(spark):
    df = local_table(spark, [(8, 1, 1, 0.5, 0.1)], "horizon int, family int, trajectory_id long, last double, y_delta double")
    assert G.own_space_arm(df, ["last"], 1.0).collect() == []
