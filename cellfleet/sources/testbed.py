"""The engine's input tables as views of a generic event and order schema.

One user's events are one battery's reference points; one supplier's line items are one scenario.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellfleet.functions.space import FEATURES, Space
from cellfleet.plans import scan
from cellfleet.plans.scan import KEY, POS
from cellfleet.plans.small import local_table

FAMILIES = 6


SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def trajectories(spark: SparkSession, sf_dir: str, hot_rows: int | None = None) -> DataFrame:
    """Reference points: cumulative loss in integer steps, so running sums are exact."""
    ev = _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    cents = F.round(F.col("value") * 100).cast("long")
    pts = scan.ordered_scan(ev, "user_id", ["ts", "event_id"], {"_loss": cents}, hot_rows)
    noise = ((F.col("event_id") * 7919) % 1001 - 500) / F.lit(500.0) * F.lit(0.002)
    return (
        pts.withColumn("soh_true", F.lit(1.0) - F.col("_loss") / F.lit(1e6))
        .select(
            F.col("user_id").alias(KEY), (F.col("user_id") % FAMILIES).alias("family"), POS,
            (14.0 * F.col(POS)).alias("reference_day"), "soh_true",
            (F.col("soh_true") + noise).alias("soh_observed"),
        )
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_columns(_table(spark, sf_dir, "lineitem"))


def telemetry_columns(li: DataFrame) -> DataFrame:
    """Telemetry samples from line items; works on a batch and on a stream."""
    c = F.col
    return li.select(
        c("l_suppkey").alias("scenario_id"), (c("l_suppkey") % FAMILIES).alias("family"),
        c("l_shipdate").alias("ts"), (28 + 50 * c("l_tax")).alias("voltage_v"),
        F.when(c("l_returnflag") == "R", -c("l_quantity") / 2).otherwise(c("l_quantity") / 2).alias("current_a"),
        (15 + 100 * c("l_discount")).alias("temperature_c"), (0.3 * c("l_quantity") / 50).alias("dod_orbit"),
        (c("l_quantity") / 50).alias("efc"), (c("l_quantity") * 0.8).alias("ah_throughput"),
        (c("l_quantity") * 24.0).alias("wh_throughput"), (1 - c("l_discount")).alias("soh_true"),
        (0.045 + c("l_tax") / 10).alias("rint_ohm_true"), c("l_linenumber").alias("orbit_no"),
    )


def drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure per 14-day step: line items binned by supplier and ship date."""
    li = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    bin_ = F.floor(F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")) / 14)
    c = F.col
    per = li.groupBy(c("l_suppkey").alias(KEY), bin_.alias("bin")).agg(
        (15 + 100 * F.avg("l_discount")).alias("mean_temp_c"), (15 + 100 * F.max("l_discount")).alias("max_temp_c"),
        (F.avg("l_quantity") / 100).alias("dod"), (0.2 + F.avg("l_tax")).alias("mean_c_rate"),
        F.sum(c("l_quantity").cast("long")).alias("_q"), (0.65 + F.avg("l_discount")).alias("mean_soc"),
        F.avg("l_quantity").alias("mean_abs_beta_deg"),
    )
    cum = scan.ordered_scan(per, KEY, ["bin"], {"_efc": c("_q")}, at_most=li.count())
    family = c(KEY) % FAMILIES
    return cum.select(
        KEY, family.alias("family"), POS, (14.0 * c(POS)).alias("age_days"), "mean_temp_c", "max_temp_c", "dod",
        "mean_c_rate", (c("_efc") / 50).alias("efc"), "mean_soc", "mean_abs_beta_deg",
        F.when(family <= 1, "train").when(family <= 3, "calibration").otherwise("test").alias("split"),
    )


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    d = lambda v: F.lit(float(v))
    return _table(spark, sf_dir, "supplier").select(
        c("s_suppkey").alias(KEY), (d(0.0003) + d(1e-5) * c("s_nationkey")).alias("k_cal"),
        (d(0.0022) + d(0.0003) * (c("s_suppkey") % 7)).alias("k_cyc"), d(0.8).alias("dod_exponent"),
        d(0.3).alias("crate_exponent"), d(0.02).alias("temperature_sensitivity"), d(0.10).alias("knee_start_loss"),
        d(0.5).alias("knee_gain"), d(0.2).alias("beta_cal"), d(0.1).alias("beta_cyc"),
        (d(40) + d(0.1) * c("s_nationkey")).alias("q0_ah"), d(0.045).alias("initial_rint_ohm"), d(1.2).alias("rint_exponent"),
    )


def cell_cycles(points: DataFrame) -> DataFrame:
    cap = F.lit(2.0) * F.col("soh_observed") * (1 + F.lit(0.1) * (F.col(KEY) % 3))
    return points.select(F.col(KEY).alias("cell_id"), F.col(POS).alias("cycle_idx"), cap.alias("capacity"))


def requests(points: DataFrame) -> DataFrame:
    return points.select(
        F.col(KEY).cast("string").alias("battery_id"), POS, "soh_observed", (F.col(POS) * 97_003 + 5).alias("arrival")
    )


# Two-feature space of the checks in plain SQL.
SPACE2 = Space(("last", "slope_full"), (0.0, -1.0), (2.0, 1.0), (0.85, -0.005), (0.07, 0.0013))
# The 11-feature space, rounded percentiles and moments of the reference points.
SPACE11 = Space(
    FEATURES,
    (0.45, -0.014, -0.024, -0.14, -0.009, -0.0075, -0.015, 0.5, 0.013, 0.45, 0.55),
    (0.92, 0.002, 0.0, -0.05, 0.0, -0.0026, 0.015, 0.96, 0.042, 0.92, 0.999),
    (0.76, -0.005, -0.01, -0.095, -0.005, -0.005, 0.0, 0.81, 0.03, 0.76, 0.855),
    (0.11, 0.0037, 0.0052, 0.022, 0.0018, 0.0011, 0.0063, 0.108, 0.0066, 0.11, 0.105),
)
# A source head per horizon in the two-feature space, and half-widths per horizon.
PRIOR2 = {h: (-0.0005, 0.03) for h in (2, 4, 8)}
HALF_WIDTHS = {2: 0.01, 4: 0.02, 8: 0.04}


def half_widths(spark: SparkSession) -> DataFrame:
    rows = [
        (p, a, c, h, w * (1.0 if c == 0.9 else 1.5))
        for p in ("PROTOCOL_FIXED_HOLDOUT", "PROTOCOL_NESTED_FAMILY_LOFO")
        for a in ("FINAL_MODEL", "STABILITY_BASELINE")
        for c in (0.9, 0.95)
        for h, w in HALF_WIDTHS.items()
    ]
    return local_table(spark, rows, "protocol string, arm string, coverage double, horizon int, half_width double")


