"""A table of one row per key as an append-only log of changes, with compaction.

Each micro-batch appends the rows it changed and nothing else. Readers take every key's newest row from the last
base and the changes after it. A new base is written when as many changed rows as the base has lie after it, so a
row is rewritten once for each doubling of changes, and after `MOST` batches, so that readers open few folders.

A batch writes folders of its own number and finishes with a note; a retried batch writes the same folders anew,
from the note before it. Folders that no note's base reaches back to may be deleted at any time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cellfleet.plans.small import local_table

#: Batches after which a base is written at the latest, and changed rows below which none is.
MOST, LEAST = 64, 10_000
NOTE = "base long, base_rows long, changed_rows long"


class KeyedLog:
    """``schema`` has the key columns and the values; a batch has at most one row per key."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], schema: StructType,
                 most: int | None = None, least: int | None = None):
        self.spark, self.root, self.keys, self.schema = spark, root, list(keys), schema
        self.most, self.least = most or MOST, LEAST if least is None else least
        self._held: tuple[int, tuple[int, int, int]] | None = None

    def _note(self, before: int | None = None) -> tuple[int, tuple[int, int, int]]:
        """Number and note of the last finished batch, read from storage only after a restart."""
        if self._held and (before is None or self._held[0] == before - 1):
            return self._held
        if before == 0:
            return -1, (-1, 0, 0)
        notes = self.spark.read.schema(f"{NOTE}, batch long").parquet(f"{self.root}/note")
        if before is not None:
            notes = notes.where(F.col("batch") < before)
        last = notes.orderBy(F.col("batch").desc()).first()
        if last is None:
            return -1, (-1, 0, 0)
        return last["batch"], (last["base"], last["base_rows"], last["changed_rows"])

    def _read(self, kind: str, batch: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{kind}/batch={batch}").withColumn("_batch", F.lit(batch).cast("long"))

    def _merged(self, base: int, last: int) -> DataFrame:
        parts = [self._read("base", base)] if base >= 0 else []
        parts += [self._read("change", i) for i in range(base + 1, last + 1)]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        values = [f.name for f in self.schema if f.name not in self.keys]
        newest = F.max_by(F.struct(*values), "_batch")
        return rows.groupBy(*self.keys).agg(newest.alias("_v")).select(*self.keys, "_v.*").select(*self.schema.names)

    def append(self, changed: DataFrame, batch: int) -> None:
        """Log the rows that a batch changed; cost follows their number, compaction included."""
        _, (base, base_rows, rows) = self._note(batch)
        changed.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.root}/change/batch={batch}")
        rows += self._read("change", batch).count()
        if rows >= max(base_rows, self.least) or batch - base >= self.most:
            self._merged(base, batch).write.mode("overwrite").parquet(f"{self.root}/base/batch={batch}")
            base, base_rows, rows = batch, self._read("base", batch).count(), 0
        note = local_table(self.spark, [(base, base_rows, rows)], NOTE)
        note.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/note/batch={batch}")
        self._held = (batch, (base, base_rows, rows))

    def latest(self, before: int | None = None) -> DataFrame:
        """Every key's newest row, of all batches or of those before one."""
        last, (base, _, _) = self._note(before)
        if last < 0:
            return local_table(self.spark, [], self.schema)
        return self._merged(base, last)
