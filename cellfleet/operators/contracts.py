"""Data contracts: refusals and violation tables. Nothing here repairs data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellfleet.functions.space import CONTEXT
from cellfleet.plans import scan
from cellfleet.plans.scan import KEY, POS
from cellfleet.plans.small import settle


class ContractError(ValueError):
    """An input does not satisfy its declared contract."""


# Columns of a prediction request, and channels that may never reach a model.
REQUIRED = ("battery_id", "reference_index", "soh_observed")
OPTIONAL = ("timestamp_utc",)
FORBIDDEN = (
    "soh_true", "anchor_soh_true", "rint_true", "soh_noise_residual",
    "target_soh_true", "target_soh_observed", "target_delta_soh_true", "target_delta_soh_observed",
    "audit_upper_bound_delta_soh_true_to_true", "target_rul_days", "target_rul_reference_steps",
    "censored", "rul_lower_bound_days", "rul_lower_bound_reference_steps",
    "future_realized_delta_efc", "future_realized_delta_ah", "future_realized_delta_wh",
    "future_planned_delta_efc", "future_planned_delta_ah", "future_planned_delta_wh",
    "environment_family_id", "split", "trajectory_id", "altitude_km", "inclination_deg", "raan_deg",
)
FORBIDDEN_PREFIXES = (
    "target_", "future_realized_", "future_planned_", "audit_", "legacy_proxy_", "obs_hist_", "stress_",
)
FORBIDDEN_SUFFIXES = ("_true",)
SOH_MAX = 1.5


def refused_columns(columns: Sequence[str]) -> dict[str, str]:
    """Refused columns with the rule that hit: exact name before prefix before suffix."""
    hits = {}
    for c in columns:
        low = c.strip().lower()
        prefix = next((p for p in FORBIDDEN_PREFIXES if low.startswith(p)), None)
        suffix = next((s for s in FORBIDDEN_SUFFIXES if low.endswith(s)), None)
        if low in FORBIDDEN:
            hits[c] = "declared non-input channel"
        elif prefix:
            hits[c] = f"forbidden prefix {prefix}"
        elif suffix:
            hits[c] = f"forbidden suffix {suffix}: hidden truth"
    return hits


def refuse_columns(df: DataFrame) -> DataFrame:
    hits = refused_columns(df.columns)
    if hits:
        raise ContractError("columns that may never reach a model: " + "; ".join(f"{c} ({r})" for c, r in hits.items()))
    return df


def check_columns(df: DataFrame, required: Sequence[str] = REQUIRED, optional: Sequence[str] = OPTIONAL) -> DataFrame:
    """Required, unknown and case-insensitively duplicate columns, and empty input."""
    low = [c.lower() for c in df.columns]
    if len(set(low)) != len(low):
        raise ContractError(f"duplicate columns: {sorted(c for c in set(low) if low.count(c) > 1)}")
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    unknown = [c for c in df.columns if c not in (*required, *optional)]
    if unknown:
        raise ContractError(f"unknown columns: {unknown}")
    if df.isEmpty():
        raise ContractError("input is empty")
    return df


def count_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One pass over the data; one (rule, n) row per rule. A NULL condition is not a hit."""
    wide = df.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    return wide.unpivot([], list(rules), "rule", "n")


def value_violations(df: DataFrame) -> DataFrame:
    """Index integral, SOH finite, positive, at most 1.5; percent scale is named separately."""
    x, i = F.col("soh_observed").cast("double"), F.col("reference_index").cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return count_rules(
        df,
        {
            "index_not_integral": i.isNull() | (i != F.floor(i)),
            "soh_not_finite": ~finite,
            "soh_not_positive": finite & (x <= 0),
            "soh_above_max": finite & (x > SOH_MAX),
            "soh_percent_scale": finite & (x > SOH_MAX) & (x <= 100),
        },
    )


def order_violations(df: DataFrame, key: str = "battery_id", index: str = "reference_index",
                     arrival: str = "arrival") -> DataFrame:
    """Steps against arrival order whose index does not rise, per group that has any.

    ``arrival`` is any number that rises along the rows as given; gaps in it do not matter.
    """
    placed = scan.with_ordinal(df.select(key, index, arrival), key, arrival, "_at")
    cut = scan.halo(placed, back=1, key=key, pos="_at")
    prev = F.lag(index).over(scan.series(key, "_at"))
    return (
        cut.withColumn("_bad", F.col(index) <= prev)
        .where("home")
        .groupBy(key)
        .agg(F.count_if("_bad").alias("n_bad"))
        .where(F.col("n_bad") > 0)
    )


def short_groups(df: DataFrame, n: int = CONTEXT, key: str = "battery_id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n_points")).where(F.col("n_points") < n)


def driver_violations(drivers: DataFrame, params: DataFrame, required: Sequence[str] = (),
                      forbidden: Sequence[str] = (), positive: Sequence[str] = (),
                      param_required: Sequence[str] = ()) -> DataFrame:
    """The driver/parameter contract as (rule, n) rows; column rules raise before any job runs.

    ``declared_contract`` has the columns that the protocol declares.
    """
    missing = [c for c in required if c not in drivers.columns]
    missing += [c for c in param_required if c not in params.columns]
    leaked = [c for c in forbidden if c in drivers.columns]
    if missing or leaked:
        raise ContractError(f"driver or parameter columns missing {missing}, leaked {leaked}")
    pos_rules = {f"{c}_not_positive": F.col(c) <= 0 for c in positive}
    per_param = params.groupBy(KEY).agg(F.count("*").alias("_n"))
    per_point = drivers.groupBy(KEY, POS).agg(F.count("*").alias("_n"))
    starts = drivers.groupBy(KEY).agg(F.min(POS).alias("_i"), F.min_by("age_days", POS).alias("_a"))
    ids, pids = starts.select(KEY), per_param.select(KEY)
    parts = [
        count_rules(per_param, {"duplicate_parameter_rows": F.col("_n") > 1}),
        count_rules(per_point, {"duplicate_points": F.col("_n") > 1}),
        count_rules(
            starts,
            {"start_index_not_0": F.col("_i") != 0, "start_age_not_0": F.abs("_a") > 1e-8},
        ),
        count_rules(ids.join(pids, KEY, "left_anti"), {"missing_parameters": F.lit(True)}),
        count_rules(pids.join(ids, KEY, "left_anti"), {"unused_parameters": F.lit(True)}),
    ]
    if pos_rules:
        parts.append(count_rules(params, pos_rules))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cumulative_violations(df: DataFrame, tolerance: dict[str, float], increments: Sequence[str] = ()) -> DataFrame:
    """Cumulative channels that fall within a trajectory, and increments below -1e-15."""
    cut = scan.halo(df, back=1)
    w = scan.series()
    rules = {f"{c}_falls": F.col(c) - F.lag(c).over(w) < -t for c, t in tolerance.items()}
    flags = cut.withColumns({f"_{n}": r for n, r in rules.items()}).where("home")
    return count_rules(
        flags,
        {
            **{n: F.col(f"_{n}") for n in rules},
            **{f"{c}_negative": F.col(c) < -1e-15 for c in increments},
        },
    )


def flag_drift(derived: DataFrame, manifest: DataFrame, flag: str, declared: str, key: str = KEY) -> DataFrame:
    """Keys whose derived flag differs from the manifest's."""
    per = derived.groupBy(key).agg(F.max(flag).alias(flag))
    joined = per.join(manifest.select(key, declared), key)
    return joined.where(~F.col(flag).eqNullSafe(F.col(declared)))


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str] | str, how: str = "left",
                 validate: str = "m:1", cover: bool = False) -> DataFrame:
    """Join after asserting its cardinality; ``cover`` also demands a match for every left row.

    The right side is counted per key before the join. A small right side is broadcast by its
    measured size; a larger one is left to a shuffle join, where AQE splits skewed keys.
    """
    keys = [on] if isinstance(on, str) else list(on)
    sides = {"m:1": [("right", right)], "1:1": [("left", left), ("right", right)], "1:m": [("left", left)]}
    if validate not in sides:
        raise ValueError(f"unknown cardinality {validate}")
    for name, side in sides[validate]:
        dup = side.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
        if not dup.isEmpty():
            raise ContractError(f"{name} side of a {validate} join repeats a key of {keys}")
    if cover and not left.join(right.select(*keys), keys, "left_anti").isEmpty():
        raise ContractError(f"the right side does not cover every key of {keys}")
    return left.join(right, keys, how)


def split_short_groups(df: DataFrame, n: int, key: str = "cell_id", pos: str = "cycle_idx") -> tuple[DataFrame, DataFrame]:
    """Rows of long-enough groups, and the groups left out with their size."""
    cut = scan.halo(df, key=key, pos=pos).drop("home")
    ctx = scan.attach(cut, total={"n_rows": (F.count("*"), F.sum)}, key=key, pos=pos)
    used = ctx.where(F.col("n_rows") >= n).drop("n_rows", "chunk")
    skipped = df.groupBy(key).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") < n)
    return used, skipped


def stratum(df: DataFrame, horizon: int | None = None, held=None, members: DataFrame | None = None) -> DataFrame:
    """Rows of one horizon, outside the held-out family, inside the budget."""
    out = df
    if horizon is not None:
        out = out.where(F.col("horizon") == horizon)
    if held is not None:
        out = out.where(F.col("family") != F.lit(held))
    if members is not None:
        out = out.join(members, ["family", KEY], "left_semi")
    return out


def half_width_refusals(requests: DataFrame, quantiles: DataFrame) -> DataFrame:
    """Requests for a level that was never calibrated; nothing is interpolated."""
    keys = ["protocol", "arm", "coverage", "horizon"]
    return requests.join(settle(quantiles.select(*keys).distinct()), keys, "left_anti").withColumn(
        "reason", F.lit("NO_CALIBRATED_HALF_WIDTH")
    )
