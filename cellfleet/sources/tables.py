"""Table scans. Schemas are explicit; column pruning and pushdown are left to the scan."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from pathlib import PurePath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellfleet.functions.space import CONTEXT, FEATURES, Space
from cellfleet.plans.scan import KEY, POS, with_ordinal

TRAJECTORY_SCHEMA = (
    "trajectory_id string, reference_index int, reference_day double, soh_observed double, soh_true double"
)
MANIFEST_SCHEMA = "trajectory_id string, environment_family_id string, right_censored_on_soh_true int"
TELEMETRY_SCHEMA = (
    "scenario_id string, trajectory_id string, environment_family_id string, scenario_epoch_s double, "
    "orbit_no int, voltage_v double, current_a double, temperature_c double, soc double, dod_orbit double, "
    "efc double, ah_throughput double, wh_throughput double, q_max_ah_true double, soh_true double, "
    "rint_ohm_true double"
)
CYCLE_SCHEMA = "cell_id string, cycle_idx double, capacity double, voltage double, current double, temperature double"
REQUEST_SCHEMA = "battery_id string, reference_index int, soh_observed double, timestamp_utc string"
WINDOW_SCHEMA = (
    "sample_uid string, trajectory_id string, environment_family_id string, split string, horizon_steps int, "
    "frozen_outer_fold int, anchor_soh_observed double, target_soh_true double, target_delta_soh_true double, "
    "frozen_predicted_delta double, "
    + ", ".join(f"ctx_soh_{i:02d} double" for i in range(CONTEXT))
    + ", "
    + ", ".join(f"frozen_{i:02d}_{n} double" for i, n in enumerate(FEATURES))
)


def _struct(schema: str | T.StructType) -> T.StructType:
    return T._parse_datatype_string(schema) if isinstance(schema, str) else schema


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop))


def scan(spark: SparkSession, path: str, schema: str | T.StructType, cols: Sequence[str] | None = None,
         required: bool = True, optional: Sequence[str] = ()) -> DataFrame:
    """CSV, JSON or Parquet by file suffix. A leading byte-order mark in a CSV header is tolerated.

    A CSV is matched to the schema by its header, as files may hold the columns in any order; a column
    that the schema names and the header lacks is refused, or NULL if it is ``optional``. NaN and infinity become NULL. An optional
    input that is absent gives an empty table with its schema.
    """
    kind = _struct(schema)
    if not required and not _exists(spark, path):
        df = spark.createDataFrame([], kind)
    else:
        suffix = PurePath(path.rstrip("/")).suffix
        if suffix == ".csv":
            raw = spark.read.option("header", True).csv(path)
            wanted = [f for f in kind if not cols or f.name in cols]
            if missing := [f.name for f in wanted if f.name not in raw.columns and f.name not in optional]:
                raise ValueError(f"{path} lacks columns {missing}")
            given = {f.name: F.col(f.name) if f.name in raw.columns else F.lit(None) for f in wanted}
            df = raw.select(*[given[f.name].cast(f.dataType).alias(f.name) for f in wanted])
        elif suffix in (".json", ".jsonl"):
            df = spark.read.schema(kind).json(path)
        else:
            df = spark.read.schema(kind).parquet(path)
    return finite(df.select(*cols) if cols else df)


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinite doubles as NULL, the engine's only missing value."""
    inf = float("inf")
    return df.select(*[
        F.when(~F.isnan(c) & (F.abs(F.col(c)) < inf), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])


def positioned(points: DataFrame, key: str = KEY, index: str = POS) -> DataFrame:
    """Points by position: ``index`` counts the rows of a series from 0 in its own order.

    The index as given, which may have gaps, is kept as ``raw_index``. Windows, lags and labels of the
    operators then mean rows, not index steps.
    """
    raw = points.withColumnRenamed(index, "raw_index")
    return with_ordinal(raw, key, "raw_index", index)


def read_trajectories(spark: SparkSession, path: str, dim: DataFrame | str) -> DataFrame:
    """Reference points by position, with the family and censoring flag of their trajectory.

    A trajectory without a manifest row, or with several, is refused.
    """
    from cellfleet.operators.contracts import checked_join

    manifest = scan(spark, dim, MANIFEST_SCHEMA) if isinstance(dim, str) else dim
    family = manifest.withColumnRenamed("environment_family_id", "family")
    points = scan(spark, path, TRAJECTORY_SCHEMA)
    checked_join(points.select(KEY).distinct(), family, KEY, "left", "m:1", cover=True)
    return positioned(points).join(family, KEY)


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """Stored windows with the engine's names; sorted by ``sample_uid`` only when written out."""
    return scan(spark, path, WINDOW_SCHEMA).withColumnsRenamed(
        {"environment_family_id": "family", "horizon_steps": "horizon", "target_delta_soh_true": "y_delta"}
    )


def read_telemetry(spark: SparkSession, path: str, cols: Sequence[str] | None = None, required: bool = True) -> DataFrame:
    return scan(spark, path, TELEMETRY_SCHEMA, cols, required)


def usable_cycles(cycles: DataFrame) -> DataFrame:
    """Cycles with a finite positive capacity, re-indexed without gaps in cycle order.

    Cycle numbers are integers and unique per cell.
    """
    ok = ~F.isnan("capacity") & (F.col("capacity") > 0) & (F.col("capacity") < F.lit(float("inf")))
    src = cycles.where(ok).withColumn("cycle_no", F.col("cycle_idx").cast("long"))
    return with_ordinal(src, "cell_id", "cycle_no", "cycle_idx")


def read_cycles(spark: SparkSession, path: str, meta: str | None = None) -> DataFrame:
    """Discharge cycles of public cells, with one JSON line of metadata per cell if given."""
    out = usable_cycles(scan(spark, path, CYCLE_SCHEMA, optional=("voltage", "current", "temperature")))
    if meta is None:
        return out
    return out.join(spark.read.json(meta), "cell_id", "left")


def read_json(spark: SparkSession, path: str) -> dict:
    """One JSON object from any file system that Spark reads; a byte-order mark is tolerated."""
    return json.loads(spark.read.text(path, wholetext=True).first()["value"].removeprefix("\ufeff"))


def read_alphas(spark: SparkSession, path: str) -> dict[int, float]:
    """Ridge strengths per horizon from a JSON object with keys ``2`` or ``h2``."""
    return {int(k.removeprefix("h")): float(v) for k, v in read_json(spark, path).items()}


def read_space(spark: SparkSession, path: str) -> Space:
    """Clip and z-score parameters from a one-object JSON file."""
    d = read_json(spark, path)
    names = tuple(d.get("feature_names", FEATURES))
    if len({len(d[k]) for k in ("clip_lo", "clip_hi", "scaler_mean", "scaler_std")} | {len(names)}) != 1:
        raise ValueError("space arrays differ in length")
    return Space(names, *[tuple(map(float, d[k])) for k in ("clip_lo", "clip_hi", "scaler_mean", "scaler_std")])


def read_replay_config(spark: SparkSession, path: str):
    """Global replay coefficients from JSON, plain or under ``global_coefficients``; the temperature may be missing.

    All five scales must be there: a replay never runs on a default by mistake.
    """
    from cellfleet.operators.replay import ReplayConfig

    d = read_json(spark, path)
    d = d.get("global_coefficients", d)
    names = ("calendar_scale", "cycle_scale", "knee_gain_scale", "knee_start_offset", "rint_growth_scale")
    if missing := [n for n in names if n not in d]:
        raise ValueError(f"replay coefficients missing: {missing}")
    return ReplayConfig(*(float(d[n]) for n in names), float(d.get("temperature_reference_c", 25.0)))


def read_prior(spark: SparkSession, path: str, space: Space, space_sha256: str | None = None):
    """A source head per horizon from JSON: ``coef`` (a row per horizon 1, 2, ..), ``intercept``, ``feature_names``.

    The order of features must be the space's. With ``space_sha256``, the digest that the space was recorded with,
    the file's own SHA-256 must equal it: the head then stems from the fit that made the space.
    """
    from cellfleet.operators.learning import Prior

    if space_sha256 is not None:
        found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
        if found != space_sha256:
            raise ValueError(f"prior of digest {found} did not make the space, which names {space_sha256}")
    d = read_json(spark, path)
    if tuple(d["feature_names"]) != space.names:
        raise ValueError(f"feature order differs: {d['feature_names']} against {list(space.names)}")
    rows, shift = d["coef"], d["intercept"]
    if len(rows) != len(shift) or any(len(r) != len(space.names) for r in rows):
        raise ValueError("prior arrays differ in length")
    return Prior({h + 1: tuple(map(float, r)) for h, r in enumerate(rows)}, {h + 1: float(v) for h, v in enumerate(shift)})


def read_half_widths(spark: SparkSession, path: str) -> DataFrame:
    """Half-widths stored as ``protocol|arm|coverage|hN`` keys of one JSON object, as a table."""
    return half_width_table(spark, read_json(spark, path)["half_widths"])


def half_width_table(spark: SparkSession, table: dict[str, float]) -> DataFrame:
    from cellfleet.plans.small import local_table

    rows = []
    for key, width in sorted(table.items()):
        protocol, arm, level, h = key.split("|")
        rows.append((protocol, arm, float(level), int(h.removeprefix("h")), float(width)))
    return local_table(spark, rows, "protocol string, arm string, coverage double, horizon int, half_width double")


#: Bytes up to which Spark reads a file as one value; pieces in which a longer one is read.
WHOLE, PIECE = 64 << 20, 8 << 20


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, n_bytes and SHA-256 of files (file, n_bytes, path), each read in pieces by its task."""
    for batch in batches:
        for file, size, path in zip(*(c.to_pylist() for c in batch.columns)):
            digest = hashlib.sha256()
            store, name = _file_system(path)
            with store.open_input_stream(name) as source:
                while piece := source.read(PIECE):
                    digest.update(piece)
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([size]), pa.array([digest.hexdigest()])], ["file", "n_bytes", "sha256"])


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def file_inventory(spark: SparkSession, root: str, whole: int | None = None) -> DataFrame:
    """Path below ``root``, size and SHA-256 of every file under it, at any depth.

    Files of at most ``whole`` bytes are values of Spark's file source. Longer ones, of any length, are read in pieces
    of PIECE bytes by the tasks they are dealt to, so memory does not grow with them; this needs a file system that
    ``pyarrow.fs`` opens. A SHA-256 is sequential, so one file is one task. Spark lists no empty files.
    """
    whole = WHOLE if whole is None else whole
    base = "/" + root.split("://", 1)[-1].strip("/") + "/"
    name = F.substring_index("path", base, -1).alias("file")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    small = files.where(F.col("length") <= whole).select(name, F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))
    # The filter reaches the scan, and without ``content`` no long file is opened there.
    large = files.where(F.col("length") > whole).select(name, F.col("length").alias("n_bytes"), "path").repartition("path")
    return small.unionByName(large.mapInArrow(_streamed, "file string, n_bytes long, sha256 string"))


def reconcile_files(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """Declared against present files: OK, MISMATCH, MISSING or UNLISTED."""
    from cellfleet.operators.joins import reconcile

    return reconcile(manifest, file_inventory(spark, root), "file", "sha256")


