"""Registered queries against their SQL in DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest
from conftest import SMALL

from __spark_entry__ import entry, oracle_sql, queries

# One query per module area; ``tools/check.py`` runs all of them.
CHOSEN = (
    "features", "labelled_windows", "source_windows", "rul_readouts", "wiener_passage", "every_tenth_anchor",
    "driver_violations", "order_violations", "inventory_reconcile", "overlay_columns", "fitted_space", "macro_metrics",
    "coverage_report", "crossfit_coverage", "prognostic_records", "selected_heads", "adaptation_curve",
    "censored_heads", "fleet_prediction", "fleet_refusals", "arm_ranking", "scenario_summary",
    "calibrated_coefficients", "fault_errors", "streamed_envelope",
)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def ordered(rows, cols):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, name):
    df = queries()[name](spark, SMALL)
    rel = con.execute(oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == sorted(df.columns)
    got, want = ordered(df.collect(), df.columns), ordered(rel.fetchall(), cols)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        for a, b in zip(g, w):
            assert a == (pytest.approx(b, abs=2e-6) if isinstance(b, float) else b)


def test_entry_runs(spark):
    assert entry(spark).count() > 0


def test_sql_only_for_registered_queries():
    assert set(oracle_sql()) <= set(queries())


def test_sql_types_are_plain(con):
    for name, text in oracle_sql().items():
        kinds = {str(c[1]) for c in con.execute(f"DESCRIBE {text}").fetchall()}
        assert not [k for k in kinds if "HUGEINT" in k or "DECIMAL" in k], name
