"""Result sinks. Inputs and earlier results are never overwritten."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_result(df: DataFrame, out: str, name: str, fmt: str = "parquet", order: Sequence[str] = (),
                 partition_by: Sequence[str] = ()) -> str:
    """Write a result table below ``out``; an existing one raises.

    ``order`` sorts globally by range partitioning, so part files are in order. Stored windows
    should be partitioned by family, so that leave-one-family-out filters prune files.
    """
    path = f"{out.rstrip('/')}/{name}"
    rows = df.orderBy(*order) if order else df
    writer = rows.write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def write_summary(df: DataFrame, out: str, name: str) -> str:
    """A one-row report as one JSON object."""
    return write_result(df.coalesce(1), out, name, "json")
