"""Online 20-point contexts: every new point of a battery with the 19 accepted before it.

Points count in order of arrival; one whose index is not above all accepted ones is refused. A micro-batch is a
table, so it is worked on by the ordered batch operators: a battery's points are cut into chunks, running
maxima and positions are two-level scans, and contexts reach into the chunk before by copied rows. No task
gets all points of a hot battery. What the next batch needs is each changed battery's last 19 points, kept
in an append-only log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cellfleet.functions.space import CONTEXT
from cellfleet.plans import scan
from cellfleet.plans.scan import POS
from cellfleet.plans.small import cut
from cellfleet.streaming.keyed_log import KeyedLog

REFUSED_INDEX = "REFUSED_INDEX_NOT_INCREASING"
REFUSED_VALUE = "REFUSED_VALUE_MISSING"
SCORED = "SCORED"
WAITING = "SHORT_HISTORY"
BATTERY = "battery_id"
TAILS = T.StructType().add(BATTERY, "string").add(
    "tail", T.ArrayType(T.StructType().add(POS, "long").add("soh_observed", "double")))
REACH = CONTEXT - 1


def judged(points: DataFrame, tails: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """A batch's points with ``chunk``, ``status`` (NULL: accepted), ``_p``: place after 19 earlier ones.

    ``points``: battery_id, reference_index, soh_observed, arrival (equal arrivals count by index). A battery id
    that is NULL is left out; a NULL or negative index is refused as not rising, a NULL or NaN value for itself.
    """
    src = points.where(F.col(BATTERY).isNotNull()).select(BATTERY, F.col(POS).cast("long").alias(POS), "soh_observed", "arrival")
    rows = scan.ordered_scan(src, BATTERY, ["arrival", POS, "soh_observed"], hot_rows=hot_rows, pos="_at")
    known = src.select(BATTERY).distinct().join(tails, BATTERY, "left").select(
        BATTERY, F.element_at("tail", -1)[POS].alias("_last"))
    rows = scan.halo(rows, key=BATTERY, pos="_at").drop("home")
    rows = scan.attach_dim(rows, known, BATTERY)
    value = F.col("soh_observed").isNotNull() & ~F.isnan("soh_observed")
    index = F.when(value, F.col(POS))
    rows = scan.attach(rows, before={"_m": (F.max(index), F.max)}, key=BATTERY, pos="_at")
    earlier = scan.series(BATTERY, "_at").rowsBetween(Window.unboundedPreceding, -1)
    bound = F.greatest("_last", "_m", F.max(index).over(earlier), F.lit(-1))
    rises = F.col(POS).isNotNull() & (F.col(POS) > bound)
    rows = rows.withColumn("status", F.when(~value, REFUSED_VALUE).when(~rises, REFUSED_INDEX))
    rows = scan.running_sums(rows, {"_n": F.col("status").isNull().cast("long")}, key=BATTERY, pos="_at")
    return rows.withColumn("_p", F.col("_n") + (REACH - 1)).drop("_n", "_m", "_last")


def contexts(points: DataFrame, tails: DataFrame, hot_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The batch's points with ``status`` and, where it is SCORED, ``ctx``; and the changed batteries' new tails."""
    rows = cut(judged(points, tails, hot_rows))
    new = rows.where("status IS NULL").select(BATTERY, "_p", POS, "soh_observed", F.lit(True).alias("_new"))
    old = tails.join(new.select(BATTERY).distinct(), BATTERY, "left_semi")
    old = old.select(BATTERY, F.size("tail").alias("_s"), F.posexplode("tail").alias("pos", "col")).select(
        BATTERY, (REACH - F.col("_s") + F.col("pos")).cast("long").alias("_p"), F.col("col.reference_index").alias(POS),
        F.col("col.soh_observed").alias("soh_observed"), F.lit(False).alias("_new"))
    near = scan.halo(new.unionByName(old), back=REACH, ahead=REACH, key=BATTERY, pos="_p")
    near = near.withColumns({"ctx": F.collect_list("soh_observed").over(scan.frame(REACH, key=BATTERY, pos="_p")),
                             "_more": F.lead("_p", REACH).over(scan.series(BATTERY, "_p"))}).where("home")
    near = cut(near.where(F.col("_new") | F.col("_more").isNull()))
    full = F.size("ctx") == CONTEXT
    taken = near.where("_new").select(BATTERY, POS, "soh_observed", F.when(full, SCORED).otherwise(WAITING).alias("status"), F.when(full, F.col("ctx")).alias("ctx"))
    refused = rows.where("status IS NOT NULL").select(BATTERY, POS, "soh_observed", "status", F.lit(None).cast("array<double>").alias("ctx"))
    last = F.sort_array(F.collect_list(F.struct("_p", POS, "soh_observed")))
    tail = near.where(F.col("_more").isNull()).groupBy(BATTERY).agg(last.alias("_t"))
    tail = tail.select(BATTERY, F.transform("_t", lambda t: F.struct(t[POS].alias(POS), t["soh_observed"].alias("soh_observed"))).alias("tail"))
    return taken.unionByName(refused), tail


def run_scores(sdf: DataFrame, root: str, score: Callable[[DataFrame], DataFrame], hot_rows: int | None = None) -> DataFrame:
    """Process what is available; online scores of every accepted point with a full context.

    ``score`` is any column pipeline over battery_id, reference_index, soh_observed and ctx. A retried batch
    overwrites its own folder and starts from the tails before it.
    """
    spark = sdf.sparkSession
    log = KeyedLog(spark, f"{root}/tails", [BATTERY], TAILS)

    def write(batch: DataFrame, batch_id: int) -> None:
        points = cut(batch)
        out, tail = contexts(points, log.latest(batch_id), hot_rows)
        score(out.where(F.col("status") == SCORED)).write.mode("overwrite").parquet(f"{root}/data/batch={batch_id}")
        out.where(F.col("status") != SCORED).drop("ctx").write.mode("overwrite").parquet(f"{root}/aside/batch={batch_id}")
        log.append(tail, batch_id)

    q = sdf.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/data").drop("batch")


def set_aside(spark, root: str) -> DataFrame:
    """Points that got no score, with the reason: refused ones and those of short histories."""
    return spark.read.parquet(f"{root}/aside").drop("batch")
