"""First alarms by day from a stream of scores that come late and out of order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ALARM_SCHEMA = "battery_id string, t_alarm_day double, pred_soh double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each Arrow batch's first score of every battery, the lower one of a day: what is sent on is few rows."""
    for batch in batches:
        t = pa.table(batch).filter(pc.is_valid(batch.column("battery_id")))
        t = t.sort_by([("battery_id", "ascending"), ("reference_day", "ascending"), ("pred_soh", "ascending")])
        yield from t.group_by("battery_id", use_threads=False).aggregate(
            [("reference_day", "first"), ("pred_soh", "first")]
        ).rename_columns({"reference_day_first": "reference_day", "pred_soh_first": "pred_soh"}).select(
            ["battery_id", "reference_day", "pred_soh"]).to_batches()


class FirstAlarm(StatefulProcessor):
    """Holds a battery's earliest alarm until the watermark passes its day, then lets it out once.

    An earlier one that comes meanwhile takes its place. After that the battery stays silent as long as its
    alarms go on; its state expires ``keep_days`` after the last of them.
    """

    def __init__(self, keep_days: float):
        self.keep = int(keep_days * DAY_MS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "day double, pred double, at long")
        self.done = handle.getValueState("done", "until long")

    def _timer(self, at: int, old: int | None) -> None:
        if old is not None:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        day = pred = last = None
        for pdf in rows:
            last = max(float(pdf["reference_day"].max()), last if last is not None else float("-inf"))
            first = pdf.sort_values(["reference_day", "pred_soh"]).iloc[0]
            new = (float(first["reference_day"]), float(first["pred_soh"]))
            if day is None or new < (day, pred):
                day, pred = new
        if self.done.exists():
            until = self.done.get()[0]
            if (later := int(last * DAY_MS) + self.keep) > until:
                self._timer(later, until)
                self.done.update((later,))
        else:
            held = self.best.get() if self.best.exists() else None
            if held is None or (day, pred) < (held[0], held[1]):
                at = int(day * DAY_MS)
                self._timer(at, held[2] if held else None)
                self.best.update((day, pred, at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.best.exists():
            self.done.clear()
            return
        day, pred, at = self.best.get()
        self.best.clear()
        until = at + self.keep
        self.handle.registerTimer(max(until, timerValues.getCurrentWatermarkInMs() + 1))
        self.done.update((max(until, timerValues.getCurrentWatermarkInMs() + 1),))
        yield pd.DataFrame({"battery_id": [key[0]], "t_alarm_day": [day], "pred_soh": [pred]})

    def close(self) -> None:
        pass


def stream_alarm(sdf: DataFrame, threshold: float, late_days: float = 28.0, keep_days: float = 3650.0) -> DataFrame:
    """One alarm per battery, at its earliest day with a prediction at or below the threshold.

    ``sdf``: battery_id, reference_day, pred_soh. Scores may come up to ``late_days`` behind the newest day seen;
    an alarm leaves when the watermark passes its day. A row without a battery id is a heartbeat: it only moves
    the watermark on. Of scores of one day the lowest counts. Needs the RocksDB state store (`run_alarms` sets it).
    """
    at = F.timestamp_millis((F.col("reference_day") * DAY_MS).cast("long"))
    src = sdf.select("battery_id", F.col("reference_day").cast("double").alias("reference_day"), F.col("pred_soh").cast("double").alias("pred_soh"), at.alias("_ts"))
    src = src.withWatermark("_ts", f"{int(late_days * DAY_MS)} milliseconds")
    # The condition names the event time, so it is not pushed below the watermark, which has to see all rows.
    hits = src.where((F.col("pred_soh") <= threshold) & F.col("battery_id").isNotNull() | (F.col("_ts") < F.lit("0001-01-01").cast("timestamp")))
    few = hits.select("battery_id", "reference_day", "pred_soh").mapInArrow(_firsts, "battery_id string, reference_day double, pred_soh double")
    return few.groupBy("battery_id").transformWithStateInPandas(FirstAlarm(keep_days), ALARM_SCHEMA, "Append", "EventTime")


def run_alarms(sdf: DataFrame, root: str, threshold: float, late_days: float = 28.0, keep_days: float = 3650.0) -> DataFrame:
    """Process what is available into Parquet and read the alarms back."""
    from cellfleet.streaming.jobs import run_append

    spark, key = sdf.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        return run_append(stream_alarm(sdf, threshold, late_days, keep_days), root)
    finally:
        spark.conf.set(key, before)
