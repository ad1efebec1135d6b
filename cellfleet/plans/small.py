"""Small tables: sizes are checked before anything is broadcast."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cellfleet.session import ensure_checkpoint_dir

# Rows a collected or broadcast table may have. Above it the callers keep a shuffle join.
SMALL_ROWS = 200_000


def local_table(spark: SparkSession, rows: Sequence, schema: T.StructType | str) -> DataFrame:
    """A driver-made table as a local relation, so that Catalyst knows its exact size."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(schema)
    columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in schema]
    table = pa.table([pa.array(c, t.type) for c, t in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, schema=schema)


def grid(spark: SparkSession, rows: Sequence, schema: str) -> DataFrame:
    """A case or candidate table made on the driver, broadcast up to ``SMALL_ROWS`` rows.

    A longer one is left without a hint, for Spark to choose the join by its known size.
    """
    table = local_table(spark, rows, schema)
    return F.broadcast(table) if len(rows) <= SMALL_ROWS else table


def each_case(df: DataFrame, rows: Sequence, schema: str, limit: int = 1_000) -> DataFrame:
    """Every row under every case of a short written-down table, without a join."""
    if len(rows) > limit:
        raise ValueError(f"{len(rows)} cases per row")
    kind = T._parse_datatype_string(schema)
    cases = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, kind)]) for row in rows
    ]
    return df.select("*", F.inline(F.array(*cases)))


def beside(*one_row: DataFrame) -> DataFrame:
    """One-row reports side by side."""
    out = one_row[0]
    for t in one_row[1:]:
        out = out.join(t, F.lit(True))
    return out


def settle(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Evaluate a presumably small aggregate once.

    Up to ``limit`` rows come back as a broadcast local table, so later passes do not compute
    it again. A larger result is returned as it was, without a hint, for a shuffle join.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(local_table(df.sparkSession, [tuple(r) for r in rows], df.schema))


def cut(df: DataFrame) -> DataFrame:
    """Evaluate a frame that several jobs read, and keep it in the shared checkpoint folder.

    Checkpoint files outlive executors, so a lost one costs no recomputation.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def collect_bounded(df: DataFrame, limit: int, what: str) -> list:
    """Collect a table whose size is bounded by the protocol, and refuse when it is not."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows
