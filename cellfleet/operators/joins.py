"""Joins and set operations on keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellfleet.operators.contracts import checked_join
from cellfleet.plans.scan import KEY
from cellfleet.plans.small import each_case as with_cases

__all__ = ["checked_join", "lookup", "table_deviation", "id_mismatch", "with_cases", "reconcile",
           "union_all", "missing_in", "common", "families", "overlay"]


def lookup(df: DataFrame, dim: DataFrame, on: str | Sequence[str], how: str = "left") -> DataFrame:
    """Dimension lookup. Catalyst and AQE broadcast the dimension when its size allows it."""
    return df.join(dim, on, how)


def table_deviation(a: DataFrame, b: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """Largest absolute difference of a measure over the common keys of two tables."""
    other = b.select(*keys, F.col(measure).alias("_other"))
    return a.select(*keys, measure).join(other, list(keys)).agg(
        F.count("*").alias("n_common"), F.max(F.abs(F.col(measure) - F.col("_other"))).alias("max_abs_diff")
    )


def id_mismatch(a: DataFrame, b: DataFrame, key: str = KEY) -> DataFrame:
    """Identities present on one side only."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return (
        left.join(right, key, "left_anti").withColumn("missing_in", F.lit("right"))
        .unionByName(right.join(left, key, "left_anti").withColumn("missing_in", F.lit("left")))
    )


def reconcile(declared: DataFrame, present: DataFrame, key: str, digest: str) -> DataFrame:
    """Status of every key of two inventories: OK, MISMATCH, MISSING or UNLISTED."""
    a = declared.select(key, F.col(digest).alias("_declared"))
    b = present.select(key, F.col(digest).alias("_present"))
    status = (
        F.when(F.col("_present").isNull(), "MISSING")
        .when(F.col("_declared").isNull(), "UNLISTED")
        .when(F.col("_declared") != F.col("_present"), "MISMATCH")
        .otherwise("OK")
    )
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), dfs)


def missing_in(declared: DataFrame, present: DataFrame) -> DataFrame:
    """Rows declared but not present (EXCEPT)."""
    return declared.subtract(present)


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both tables (INTERSECT)."""
    return a.intersect(b)


def families(df: DataFrame) -> DataFrame:
    return df.select("family").distinct()


def overlay(df: DataFrame, other: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Replace numeric columns by those of a second copy; key drift between the copies is refused.

    The check rides on the join itself: a key without a partner raises when its row is read.
    """
    fresh = other.select(key, *[F.col(c).alias(f"_o_{c}") for c in cols], F.lit(True).alias("_right"))
    both = df.withColumn("_left", F.lit(True)).join(fresh, key, "full_outer")
    ok = F.when(F.col("_left") & F.col("_right"), F.lit(True)).otherwise(
        F.raise_error("the two copies disagree on their keys").cast("boolean")
    )
    return both.where(ok).select(
        *[F.col(f"_o_{c}").alias(c) if c in cols else F.col(c) for c in df.columns]
    )
