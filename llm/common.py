"""Shared helpers: the shared work folder, stored tables, files, and Arrow batches."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a function of Arrow batches gets at once.
ROWS = 512
_KEY = "spark.checkpoint.dir"
_LOCAL: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names, which all executors see.

    Only a local master may go without that setting; it then gets a temporary folder.
    """
    root = spark.conf.get(_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_KEY} must name a shared folder on a cluster")
        if not _LOCAL:
            folder = tempfile.TemporaryDirectory(prefix="spark-llm-", dir="/tmp")
            atexit.register(folder.cleanup)
            _LOCAL.append(f"file://{folder.name}")
        root = _LOCAL[0]
    return f"{root.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that later steps read more than once, and read it back: it survives executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) of the rows that have an id; other columns are ignored."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text")).where("doc_id IS NOT NULL")


def by_batch(df: DataFrame, work: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """Apply a function of one Arrow batch that returns columns by name; None skips the batch."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Few rows at a time: Python holds no more texts than these.
            for at in range(0, batch.num_rows, ROWS):
                if (out := work(batch.slice(at, ROWS))) is not None:
                    yield pa.RecordBatch.from_arrays([out[n] for n in names], names)

    return df.mapInArrow(run, schema)


def filesystem(uri: str):
    """The file system and path of a URI, for binary files written inside tasks."""
    from pyarrow import fs

    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), uri[5:]
    return fs.LocalFileSystem(), os.path.abspath(uri)


def held_out(mod: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def filtered(docs: DataFrame, keep: Callable[[list], list[bool]], column: str = "text") -> DataFrame:
    """The rows of a frame whose ``column`` (null: empty) a function keeps; all columns pass unchanged."""
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                yield part.filter(pa.array(keep([v or "" for v in part.column(at).to_pylist()])))

    return docs.mapInArrow(run, docs.schema)
