"""Feature names, protocol constants, and clip/z-score in a fixed feature space."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names and order of the 11 context features.
FEATURES = (
    "last", "diff1", "diff2", "diff_long", "slope5", "slope_full",
    "curvature", "ctx_mean", "ctx_std", "ctx_min", "ctx_max",
)
# Protocol constants.
CONTEXT = 20
STEP_DAYS = 14
HORIZONS = (2, 4, 8)
EOL_SOH = 0.70
WARN_SOH = 0.80
MAX_RUL_DAYS = 3000.0
FLAT_RUL_DAYS = 2000.0


@dataclass(frozen=True)
class Space:
    """Clip bounds and z-score parameters, one entry per feature."""

    names: tuple[str, ...]
    clip_lo: tuple[float, ...]
    clip_hi: tuple[float, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]

    def columns(self, prefix: str = "z_") -> list[str]:
        return [f"{prefix}{n}" for n in self.names]


def clip(x: Column, lo: Column | float, hi: Column | float) -> Column:
    """``x`` within the bounds; NULL and NaN stay missing, which ``greatest`` and ``least`` would skip."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    return F.when(x.isNotNull() & ~F.isnan(x), F.least(F.greatest(x, lo), hi))


def apply_space(df: DataFrame, space: Space, prefix: str = "z_") -> DataFrame:
    """Clip every feature to the frozen bounds, then z-score it with the frozen statistics."""
    cols = {}
    for n, lo, hi, m, s in zip(space.names, space.clip_lo, space.clip_hi, space.mean, space.std):
        cols[f"{prefix}{n}"] = (clip(F.col(n), lo, hi) - F.lit(float(m))) / F.lit(float(s))
    return df.withColumns(cols)


def apply_space_array(z: Column, lo: Column, hi: Column, mean: Column, std: Column) -> Column:
    """The same on array columns, for spaces that are themselves table rows."""
    return F.transform(
        z,
        lambda x, i: (clip(x, lo[i], hi[i]) - mean[i]) / std[i],
    )


def dot(columns: Sequence[str], coefs: Sequence[str | float]) -> Column:
    """Sum of products as plain arithmetic, so that it stays inside generated code."""
    total = F.lit(0.0)
    for c, k in zip(columns, coefs):
        total = total + F.col(c) * (F.col(k) if isinstance(k, str) else F.lit(float(k)))
    return total
