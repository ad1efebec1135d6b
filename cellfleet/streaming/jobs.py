"""Incremental envelope, and helpers to run streams."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellfleet.operators.aggregates import envelope_columns
from cellfleet.session import ensure_checkpoint_dir
from cellfleet.streaming.keyed_log import KeyedLog


def stream_envelope(sdf: DataFrame, keys: Sequence[str] = ("scenario_id", "family"), watermark: str | None = None,
                    window: str | None = None) -> DataFrame:
    """The telemetry envelope as running state per scenario, or per scenario and event-time window."""
    src = sdf.withWatermark("ts", watermark) if watermark else sdf
    by = [F.col(k) for k in keys] + ([F.window("ts", window).alias("window")] if window else [])
    return src.groupBy(*by).agg(*[e.alias(n) for n, e in envelope_columns().items()])


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, which all executors see."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def run_envelope(sdf: DataFrame, root: str, keys: Sequence[str] = ("scenario_id", "family"), most: int | None = None,
                 least: int | None = None) -> DataFrame:
    """Process what is available and return the envelope as of the last batch.

    A batch appends the groups it changed to a log (`keyed_log`); it neither reads nor rewrites the others.
    """
    out = stream_envelope(sdf, keys)
    log = KeyedLog(sdf.sparkSession, f"{root}/log", keys, out.schema, most, least)
    q = (
        out.writeStream.outputMode("update").foreachBatch(log.append)
        .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return log.latest()


def run_append(out: DataFrame, root: str) -> DataFrame:
    """Process what is available into Parquet and read the result back."""
    q = (
        out.writeStream.outputMode("append").format("parquet")
        .option("path", f"{root}/data").option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{root}/data")
