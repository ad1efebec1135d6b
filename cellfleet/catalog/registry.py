"""Registry of queries, shared input frames and shared SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellfleet.functions.space import apply_space
from cellfleet.operators import windows as W
from cellfleet.plans.small import cut
from cellfleet.sources import testbed as B

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 9


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round doubles, so that both engines agree despite their order of summation."""
    return df.select(
        *[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def query(sql: str | None = None, digits: int = DIGITS) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL if there is one."""

    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir), digits)

        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return wrap


def sql(ctes: str, source: str, keep: str, doubles: str = "", digits: int = DIGITS, tail: str = "") -> str:
    """Wrap CTEs into one statement whose double columns are rounded as in `tidy`."""
    ctes = _plain_counts(ctes)
    cols = keep.split() + [f"round({c}::double, {digits}) + 0::double AS {c}" for c in doubles.split()]
    return f"WITH {ctes} SELECT {', '.join(cols)} FROM {source} {tail}"


def _plain_counts(text: str) -> str:
    """Write ``count_if(x)`` as ``count(CASE WHEN x THEN 1 END)``, whose type is BIGINT."""
    while (at := text.find("count_if(")) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = f"{text[:at]}count(CASE WHEN {text[at + len('count_if('):end - 1]} THEN 1 END){text[end:]}"
    return text


# ---------------------------------------------------------------- shared frames

FIRST2 = ("last", "slope_full")
Z2 = B.SPACE2.columns()


def points(spark: SparkSession, d: str) -> DataFrame:
    """Reference points as a view of the events, for queries that read them once."""
    return B.trajectories(spark, d)


def stored_points(spark: SparkSession, d: str) -> DataFrame:
    """The same as a stored table, for queries that read them more than once."""
    return cut(points(spark, d))


def windows(spark: SparkSession, d: str, horizons=(2, 4, 8)) -> DataFrame:
    return W.with_target(points(spark, d), horizons)


def z_windows(spark: SparkSession, d: str, horizons=(2, 4, 8)) -> DataFrame:
    return apply_space(windows(spark, d, horizons), B.SPACE2)


def z_anchors(spark: SparkSession, d: str) -> DataFrame:
    return apply_space(W.rul_anchors(stored_points(spark, d)), B.SPACE2)


# ---------------------------------------------------------------- shared SQL

TRAJ = """
traj AS (
  SELECT trajectory_id, family, reference_index, 14.0::double * reference_index AS reference_day, soh_true,
         soh_true + (((event_id * 7919) % 1001) - 500) / 500.0::double * 0.002::double AS soh_observed
  FROM (
    SELECT event_id, user_id AS trajectory_id, user_id % 6 AS family,
           row_number() OVER w - 1 AS reference_index,
           1.0::double - (sum(CAST(round(value * 100) AS BIGINT)) OVER (w ROWS UNBOUNDED PRECEDING))::double / 1000000.0::double AS soh_true
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
  )
)"""

FEATURE_NAMES = "last diff1 diff2 diff_long slope5 slope_full curvature ctx_mean ctx_std ctx_min ctx_max"


def features_sql(source: str, out: str, x: str = "soh_observed", key: str = "trajectory_id", extra: str = "") -> str:
    """The 11 features over a table with ``reference_index``."""
    return f"""
{out}_all AS (
  SELECT *, {x} AS last, {x} - lag({x}, 1) OVER w AS diff1, {x} - lag({x}, 2) OVER w AS diff2,
         {x} - lag({x}, 19) OVER w AS diff_long,
         regr_slope({x}, reference_index::double) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS slope5,
         regr_slope({x}, reference_index::double) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS slope_full,
         {x} - 2 * lag({x}, 1) OVER w + lag({x}, 2) OVER w AS curvature,
         avg({x}) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ctx_mean,
         stddev_pop({x}) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ctx_std,
         min({x}) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ctx_min,
         max({x}) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ctx_max {extra}
  FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY reference_index)
), {out} AS (SELECT * FROM {out}_all WHERE reference_index >= 19)"""


FEAT = TRAJ + "," + features_sql("traj", "feat")


def target_sql(source: str, out: str, horizons=(2, 4, 8), key: str = "trajectory_id") -> str:
    """Feature rows of ``<source>_all`` with labels h steps ahead."""
    parts = [
        f"SELECT a.*, {h} AS horizon, b.reference_day AS target_day, b.soh_true AS target_soh_true "
        f"FROM {source} a JOIN {source}_all b ON "
        + " AND ".join(f"a.{k} = b.{k}" for k in key.split(", "))
        + f" AND b.reference_index = a.reference_index + {h}"
        for h in horizons
    ]
    return f"""
{out} AS (SELECT *, soh_observed AS anchor_soh_observed, target_soh_true - soh_observed AS y_delta FROM ({' UNION ALL '.join(parts)}))"""


WIN = FEAT + "," + target_sql("feat", "win")
# Two-feature z columns of the checks in plain SQL.
Z_SQL = "(last - 0.85::double) / 0.07::double AS z1, (slope_full + 0.005::double) / 0.0013::double AS z2"
ZWIN = WIN + f", zwin AS (SELECT *, {Z_SQL} FROM win)"
ANCHORS = FEAT + f""",
ends AS (
  SELECT trajectory_id, min(CASE WHEN soh_true <= 0.70::double THEN reference_day END) AS eol_day, max(reference_day) AS last_day
  FROM traj GROUP BY trajectory_id
), anchors AS (
  SELECT f.*, eol_day, last_day, eol_day - reference_day AS rul_days, last_day - reference_day AS rul_lower_bound_days,
         CASE WHEN eol_day IS NULL THEN 1 ELSE 0 END AS censored, {Z_SQL}
  FROM feat f JOIN ends USING (trajectory_id) WHERE eol_day IS NULL OR reference_day < eol_day
)"""
