"""Streams in several micro-batches, with duplicates and late points."""

import os
import random
import re

import pyarrow as pa
import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

from cellfleet.catalog.replay_queries import file_stream
from cellfleet.operators import aggregates as A
from cellfleet.plans import scan
from cellfleet.plans.small import local_table
from cellfleet.sources import testbed as B
from cellfleet.streaming import alarms as AL
from cellfleet.streaming import jobs as R
from cellfleet.streaming import scores as SC
from cellfleet.streaming.keyed_log import KeyedLog


def advance(last, tail, index, soh):
    """One battery's new points in arrival order, one by one: accepted ones extend the tail, others are refused."""
    out = []
    for i, x in zip(index, soh):
        if x is None or x != x:
            out.append((i, SC.REFUSED_VALUE, None))
        elif i is None or i <= last:
            out.append((i, SC.REFUSED_INDEX, None))
        else:
            last, tail = i, [*tail[-19:], x]
            full = len(tail) == 20
            out.append((i, SC.SCORED if full else SC.WAITING, list(tail) if full else None))
    return last, tail, out


def some_points(seed, hot=0):
    """Points of a few batteries in several batches, with repeats, late ones, gaps and missing values."""
    r = random.Random(seed)
    batches, at = [], 0
    for b in range(4):
        rows = []
        for name in ["a"] * (hot or 25) + ["b"] * 25 + ["c"] * 3:
            base = {"a": (hot or 25), "b": 25, "c": 3}[name] * b
            index = None if r.random() < 0.02 else base + len(rows) + r.choice([0, 0, 0, 1, -3, -40])
            soh = r.choice([1.0, 0.5, 0.25]) if r.random() > 0.05 else r.choice([None, float("nan")])
            rows.append((name, index, soh, at))
            at += r.choice([1, 7, 97_003])
        batches.append(rows)
    return batches


def plain_contexts(batches):
    state, out = {}, []
    for rows in batches:
        for name in sorted({r[0] for r in rows}):
            mine = sorted((r for r in rows if r[0] == name), key=lambda r: r[3])
            last, tail, got = advance(*state.get(name, (-1, [])), [r[1] for r in mine], [r[2] for r in mine])
            state[name] = (last, tail)
            out += [(name, *g) for g in got]
    return sorted(out, key=repr)


POINTS = "battery_id string, reference_index long, soh_observed double, arrival long"


def written(spark, folder, batches, schema):
    for rows in batches:
        local_table(spark, rows, schema).repartition(2).write.mode("append").parquet(str(folder))
    return file_stream(spark, str(folder), "*.parquet", local_table(spark, batches[0], schema).schema, 2)


@pytest.mark.parametrize("hot", [0, 400])
def test_contexts_over_batches_are_those_of_single_points(spark, tmp_path, monkeypatch, hot):
    """Chunks of 40 points; with ``hot`` one battery has most of each batch and is cut before its first sort, too."""
    monkeypatch.setattr(scan, "CHUNK", 40)
    batches = some_points(3, hot)
    sdf = written(spark, tmp_path / "in", batches, POINTS)
    got = SC.run_scores(sdf, str(tmp_path / "out"), lambda df: df.select("battery_id", "reference_index", "status", "ctx"), hot_rows=50)
    got = [(r[0], r[1], r[2], r[3]) for r in got.collect()]
    got += [(r["battery_id"], r["reference_index"], r["status"], None) for r in SC.set_aside(spark, str(tmp_path / "out")).collect()]
    assert sorted(got, key=repr) == plain_contexts(batches)


def test_no_window_of_scores_takes_a_whole_battery(spark, monkeypatch):
    monkeypatch.setattr(scan, "CHUNK", 40)
    rows = [("a", i, 1.0, i) for i in range(600)] + [("b", i, 1.0, i) for i in range(300)]
    judged = SC.judged(local_table(spark, rows, POINTS), local_table(spark, [], SC.TAILS), hot_rows=50)
    size = judged.groupBy("battery_id", "chunk").count().agg(F.max("count")).first()[0]
    assert size == 40
    plan = judged._sc._jvm.PythonSQLUtils.explainString(judged._jdf.queryExecution(), "simple")
    specs = re.findall(r"Window \[.*\], \[(battery_id[^\]]*)\]", plan)
    assert specs and all("chunk" in s or "_seg" in s for s in specs), specs


LOG = "k string, v long"


def test_log_keeps_newest_rows_and_compacts_by_share(spark, tmp_path):
    log = KeyedLog(spark, str(tmp_path), ["k"], local_table(spark, [], LOG).schema, least=4)
    first = [(f"k{i}", 0) for i in range(10)]
    log.append(local_table(spark, first, LOG), 0)
    for b in range(1, 5):
        log.append(local_table(spark, [("k1", b), (f"n{b}", b)], LOG), b)
    want = dict(first) | {"k1": 4} | {f"n{b}": b for b in range(1, 5)}
    assert dict(log.latest().collect()) == want
    # Base at batch 0; 8 changed rows since are fewer than its 10. A batch's folder has its changed rows only.
    assert sorted(os.listdir(tmp_path / "base")) == ["batch=0"]
    assert [spark.read.parquet(str(tmp_path / "change" / f"batch={b}")).count() for b in range(5)] == [10, 2, 2, 2, 2]
    log.append(local_table(spark, [("k1", 5), ("k2", 5)], LOG), 5)
    assert sorted(os.listdir(tmp_path / "base")) == ["batch=0", "batch=5"]
    assert dict(log.latest().collect()) == want | {"k1": 5, "k2": 5}


def test_log_goes_on_after_a_restart_and_a_repeated_batch(spark, tmp_path):
    new = lambda: KeyedLog(spark, str(tmp_path), ["k"], local_table(spark, [], LOG).schema, most=2)
    assert new().latest(0).count() == 0
    for b in range(4):
        new().append(local_table(spark, [("a", b), (f"b{b}", b)], LOG), b)
    assert dict(new().latest(3).collect()) == {"a": 2, "b0": 0, "b1": 1, "b2": 2}
    new().append(local_table(spark, [("a", 30), ("b3", 3)], LOG), 3)  # the batch again, as after a failure
    assert dict(new().latest().collect()) == {"a": 30, "b0": 0, "b1": 1, "b2": 2, "b3": 3}
    new().append(local_table(spark, [], LOG), 4)
    assert new().latest().count() == 5


def test_envelope_over_batches_equals_batch(spark, tmp_path):
    li = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    for part in li.randomSplit([0.4, 0.3, 0.3], 1):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sdf = B.telemetry_columns(file_stream(spark, str(tmp_path / "in"), "*.parquet", li.schema))
    got = R.run_envelope(sdf, str(tmp_path / "out"))
    assert rows(got) == rows(A.telemetry_envelope(B.telemetry_columns(li)))


def test_windowed_envelope_accepts_a_watermark(spark, tmp_path):
    li = spark.read.parquet(f"{SMALL}/lineitem.parquet").limit(200).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    li.coalesce(1).write.parquet(str(tmp_path / "in"))
    sdf = B.telemetry_columns(file_stream(spark, str(tmp_path / "in"), "*.parquet", li.schema))
    out = R.stream_envelope(sdf, ("scenario_id",), "30 days", "14 days")
    assert out.isStreaming and "window" in out.columns


SCORES = "battery_id string, reference_day double, pred_soh double"
BEAT = [(None, 1e5, None)]


def alarms(spark, tmp_path, batches, **options):
    for part in batches:
        local_table(spark, part, SCORES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sdf = file_stream(spark, str(tmp_path / "in"), "*.parquet", local_table(spark, batches[0], SCORES).schema)
    return [tuple(r) for r in AL.run_alarms(sdf, str(tmp_path / "out"), 0.70, **options).orderBy("battery_id").collect()]


def test_one_alarm_per_battery(spark, tmp_path):
    parts = [[("a", 14.0, 0.69), ("a", 0.0, 0.9), ("b", 0.0, 0.9)], [("a", 28.0, 0.6), ("b", 14.0, 0.7)], [("b", 28.0, 0.5)], BEAT]
    assert alarms(spark, tmp_path, parts) == [("a", 14.0, 0.69), ("b", 14.0, 0.7)]


def test_an_earlier_alarm_inside_the_watermark_wins(spark, tmp_path):
    """Days come in reverse; a repeated score changes nothing, of one day the lower score counts."""
    parts = [[("a", 42.0, 0.5), ("b", 42.0, 0.6)], [("a", 28.0, 0.6), ("a", 42.0, 0.5)], [("a", 14.0, 0.68), ("a", 14.0, 0.65)], [("b", 0.0, 0.9)], BEAT]
    assert alarms(spark, tmp_path, parts, late_days=30.0) == [("a", 14.0, 0.65), ("b", 42.0, 0.6)]


def test_an_alarm_leaves_when_the_watermark_passes_and_only_once(spark, tmp_path):
    """A batch has run with the watermark past day 14 when an earlier score comes: the alarm has left. No second one while alarms go on."""
    parts = [[("a", 14.0, 0.6)], [("a", 60.0, 0.5)], [("a", 61.0, 0.5)], [("a", 0.0, 0.65)], [("a", 160.0, 0.4)], [("a", 260.0, 0.4)], BEAT]
    assert alarms(spark, tmp_path, parts, late_days=10.0, keep_days=120.0) == [("a", 14.0, 0.6)]


def test_state_expires_after_silence(spark, tmp_path):
    """Long after its last alarm a battery is forgotten, so a far later one is a new alarm."""
    parts = [[("a", 14.0, 0.6)], [("b", 500.0, 0.9)], [("b", 510.0, 0.9)], [("b", 520.0, 0.9)], [("a", 900.0, 0.5)], BEAT]
    assert alarms(spark, tmp_path, parts, late_days=10.0, keep_days=100.0) == [("a", 14.0, 0.6), ("a", 900.0, 0.5)]


def test_a_task_sends_one_row_a_battery():
    """A hot battery is reduced before the shuffle."""
    batch = pa.RecordBatch.from_pylist([{"battery_id": "a", "reference_day": float(9000 - i), "pred_soh": 0.5} for i in range(9000)]
                                       + [{"battery_id": "b", "reference_day": 1.0, "pred_soh": p} for p in (0.6, 0.4)])
    got = [r for b in AL._firsts(iter([batch])) for r in b.to_pylist()]
    assert sorted(got, key=lambda r: r["battery_id"]) == [{"battery_id": "a", "reference_day": 1.0, "pred_soh": 0.5}, {"battery_id": "b", "reference_day": 1.0, "pred_soh": 0.4}]


def test_envelope_slices_are_written_in_tasks_of_one_size(spark, monkeypatch):
    """Smaller splits make more files of a slice, not larger ones; there are four batches still."""
    from cellfleet.catalog import replay_queries as Q
    from cellfleet.operators.aggregates import telemetry_envelope
    from cellfleet.sources import testbed

    seen, real = [], Q.file_stream
    monkeypatch.setattr(Q, "file_stream", lambda s, folder, name, schema, n: seen.append((folder, n)) or real(s, folder, name, schema, n))
    d = spark.sparkContext.getCheckpointDir() or Q.R.work_folder(spark, "any").rsplit("/", 1)[0]
    d = f"{d}/many-files"
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    li.repartition(24).write.mode("overwrite").parquet(f"{d}/lineitem.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # a split per file
    try:
        got = Q.streamed_envelope(spark, d)
        files = len(spark.read.parquet(seen[0][0]).inputFiles())
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert files == 4 * 24 and seen[0][1] == 24
    want = telemetry_envelope(testbed.telemetry(spark, d))
    key = ["scenario_id", "n_samples", "max_temp_c", "min_soh_true"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
