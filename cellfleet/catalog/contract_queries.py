"""Queries over data contracts, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellfleet.catalog.registry import ANCHORS, TRAJ, WIN, points, query, sql, stored_points, windows
from cellfleet.operators import contracts as V
from cellfleet.operators import joins as J
from cellfleet.operators import replay as D
from cellfleet.operators import windows as W
from cellfleet.plans.scan import KEY, POS
from cellfleet.plans.small import grid
from cellfleet.sources import tables as S
from cellfleet.sources import testbed as B

# Damaged copies of the inputs, made by rules so that both engines see the same damage.
DAMAGED = TRAJ + """, dmg AS (SELECT trajectory_id::varchar AS battery_id, reference_index AS arrival,
  CASE WHEN reference_index % 17 = 5 THEN reference_index + 0.5::double ELSE reference_index::double END AS reference_index,
  CASE WHEN reference_index % 13 = 1 THEN soh_observed * 100 WHEN reference_index % 13 = 2 THEN -soh_observed
       WHEN reference_index % 13 = 3 THEN NULL ELSE soh_observed END AS soh_observed FROM traj)"""


def _damaged(spark, d):
    p, i, x = points(spark, d), F.col(POS), F.col("soh_observed")
    return p.select(
        F.col(KEY).cast("string").alias("battery_id"), i.alias("arrival"),
        F.when(i % 17 == 5, i + F.lit(0.5)).otherwise(i.cast("double")).alias(POS),
        F.when(i % 13 == 1, x * 100).when(i % 13 == 2, -x).when(i % 13 == 3, F.lit(None)).otherwise(x).alias("soh_observed"),
    )


@query(sql(DAMAGED + """, w AS (SELECT count_if(reference_index <> floor(reference_index)) AS index_not_integral, count_if(soh_observed IS NULL) AS soh_not_finite,
  count_if(soh_observed <= 0) AS soh_not_positive, count_if(soh_observed > 1.5) AS soh_above_max, count_if(soh_observed > 1.5 AND soh_observed <= 100) AS soh_percent_scale FROM dmg),
  o AS (UNPIVOT w ON COLUMNS(*) INTO NAME rule VALUE n)""", "o", "rule n"))
def value_violations(spark, d):
    """V3: value rules, counted in one pass."""
    return V.value_violations(_damaged(spark, d))


# Every 11th arrival repeats the index before it.
@query(sql(TRAJ + """, a AS (SELECT trajectory_id::varchar AS battery_id, reference_index AS arrival, CASE WHEN trajectory_id % 3 = 0 AND reference_index % 11 = 10 THEN reference_index - 1 ELSE reference_index END AS idx FROM traj),
  l AS (SELECT *, idx <= lag(idx) OVER (PARTITION BY battery_id ORDER BY arrival) AS bad FROM a),
  o AS (SELECT battery_id, count_if(bad) AS n_bad FROM l GROUP BY 1 HAVING count_if(bad) > 0)""", "o", "battery_id n_bad"))
def order_violations(spark, d):
    """V4: index that does not rise in arrival order; arrivals are far apart."""
    i = F.col(POS)
    idx = F.when((F.col(KEY) % 3 == 0) & (i % 11 == 10), i - 1).otherwise(i)
    p = points(spark, d).select(F.col(KEY).cast("string").alias("battery_id"), (i * 97_003).alias("arrival"), idx.alias(POS))
    return V.order_violations(p)


@query(sql(TRAJ + ", o AS (SELECT trajectory_id AS battery_id, count(*) AS n_points FROM traj GROUP BY 1 HAVING count(*) < 60)", "o", "battery_id n_points"))
def short_histories(spark, d):
    """V5: batteries with fewer points than asked for."""
    return V.short_groups(points(spark, d).withColumnRenamed(KEY, "battery_id"), 60)


DRIVERS = """
per AS (SELECT l_suppkey AS trajectory_id, floor(date_diff('day', DATE '1995-01-01', l_shipdate::date) / 14)::bigint AS bin,
  15 + 100 * avg(l_discount) AS mean_temp_c, 15 + 100 * max(l_discount) AS max_temp_c, avg(l_quantity) / 100 AS dod, 0.2::double + avg(l_tax) AS mean_c_rate,
  sum(l_quantity::bigint)::bigint AS q, 0.65::double + avg(l_discount) AS mean_soc, avg(l_quantity) AS mean_abs_beta_deg FROM lineitem GROUP BY 1, 2),
drv AS (SELECT trajectory_id, trajectory_id % 6 AS family, row_number() OVER w - 1 AS reference_index, 14.0::double * (row_number() OVER w - 1) AS age_days,
  mean_temp_c, max_temp_c, dod, mean_c_rate, (sum(q) OVER (w ROWS UNBOUNDED PRECEDING))::double / 50 AS efc, mean_soc, mean_abs_beta_deg,
  CASE WHEN trajectory_id % 6 <= 1 THEN 'train' WHEN trajectory_id % 6 <= 3 THEN 'calibration' ELSE 'test' END AS split
  FROM per WINDOW w AS (PARTITION BY trajectory_id ORDER BY bin)),
par AS (SELECT s_suppkey AS trajectory_id, 0.0003::double + 1e-5 * s_nationkey AS k_cal, 0.0022::double + 0.0003::double * (s_suppkey % 7) AS k_cyc, 0.8::double AS dod_exponent,
  0.3::double AS crate_exponent, 0.02::double AS temperature_sensitivity, 0.10::double AS knee_start_loss, 0.5::double AS knee_gain, 0.2::double AS beta_cal, 0.1::double AS beta_cyc,
  40 + 0.1::double * s_nationkey AS q0_ah, 0.045::double AS initial_rint_ohm, 1.2::double AS rint_exponent FROM supplier)"""


def _bad_tables(spark, d):
    """Drivers and parameters with rule-made damage."""
    drv, par = B.drivers(spark, d), B.parameters(spark, d)
    i = F.col(POS)
    drv = drv.where(~((F.col("mean_temp_c") > 20.013) & (i == 0)))
    drv = drv.unionByName(drv.where((F.col("dod") > 0.2503) & (i == 7)))
    q0 = F.col("q0_ah")
    par = par.where(F.col(KEY) % 5 != 0).unionByName(par.where(q0 < 40.35))
    return drv, par.withColumn("k_cal", F.when(q0.between(41, 41.25), -F.col("k_cal")).otherwise(F.col("k_cal")))


BAD = DRIVERS + """, d0 AS (SELECT * FROM drv WHERE NOT (mean_temp_c > 20.013 AND reference_index = 0)),
bdrv AS (SELECT * FROM d0 UNION ALL SELECT * FROM d0 WHERE dod > 0.2503 AND reference_index = 7),
p0 AS (SELECT * FROM par WHERE trajectory_id % 5 <> 0), p1 AS (SELECT * FROM p0 UNION ALL SELECT * FROM par WHERE q0_ah < 40.35::double),
bpar AS (SELECT * REPLACE (CASE WHEN q0_ah BETWEEN 41 AND 41.25::double THEN -k_cal ELSE k_cal END AS k_cal) FROM p1)"""


@query(sql(BAD + """, st AS (SELECT trajectory_id, min(reference_index) AS i, arg_min(age_days, reference_index) AS a FROM bdrv GROUP BY 1), o AS (
  SELECT 'duplicate_parameter_rows' AS rule, count(*) AS n FROM (SELECT 1 FROM bpar GROUP BY trajectory_id HAVING count(*) > 1) UNION ALL
  SELECT 'duplicate_points', count(*) FROM (SELECT 1 FROM bdrv GROUP BY trajectory_id, reference_index HAVING count(*) > 1) UNION ALL
  SELECT 'start_index_not_0', count_if(i <> 0) FROM st UNION ALL SELECT 'start_age_not_0', count_if(abs(a) > 1e-8) FROM st UNION ALL
  SELECT 'missing_parameters', count(*) FROM st ANTI JOIN bpar USING (trajectory_id) UNION ALL
  SELECT 'unused_parameters', count(*) FROM (SELECT DISTINCT trajectory_id FROM bpar) b ANTI JOIN bdrv USING (trajectory_id) UNION ALL
  """ + " UNION ALL ".join(f"SELECT '{c}_not_positive', count_if({c} <= 0) FROM bpar" for c in D.POSITIVE_PARAMETERS) + ")", "o", "rule n"))
def driver_violations(spark, d):
    """V6: the declared driver and parameter contract as rule counts."""
    drv, par = _bad_tables(spark, d)
    # Declared columns that the inputs here lack are there without values; the contract checks names first.
    drv, par = (t.withColumns({c: F.lit(None).cast("string") for c in names if c not in t.columns})
                for t, names in ((drv, D.DRIVER_COLUMNS), (par, D.PARAMETER_COLUMNS)))
    return V.driver_violations(drv, par, **D.declared_contract())


@query(sql(DRIVERS + """, f AS (SELECT *, age_days - lag(age_days) OVER w AS da, CASE WHEN reference_index % 29 = 28 THEN efc - 1000 ELSE efc END AS e FROM drv WINDOW w AS (PARTITION BY trajectory_id ORDER BY reference_index)),
  g AS (SELECT *, e - lag(e) OVER (PARTITION BY trajectory_id ORDER BY reference_index) AS de FROM f),
  o AS (SELECT 'age_days_falls' AS rule, count_if(da < -1e-12) AS n FROM g UNION ALL SELECT 'efc_falls', count_if(de < -1e-9) FROM g UNION ALL SELECT 'efc_negative', count_if(e < -1e-15) FROM g)""", "o", "rule n"))
def cumulative_violations(spark, d):
    """V7: cumulative channels that fall."""
    drv = B.drivers(spark, d)
    drv = drv.withColumn("efc", F.when(F.col(POS) % 29 == 28, F.col("efc") - 1000).otherwise(F.col("efc")))
    return V.cumulative_violations(drv, {"age_days": 1e-12, "efc": 1e-9}, ["efc"])


@query(sql(ANCHORS + ", d AS (SELECT trajectory_id, max(censored) AS censored FROM anchors GROUP BY 1), m AS (SELECT trajectory_id, CASE WHEN trajectory_id % 7 = 0 THEN 1 ELSE max(CASE WHEN eol_day IS NULL THEN 1 ELSE 0 END) END AS declared FROM ends GROUP BY trajectory_id), o AS (SELECT * FROM d JOIN m USING (trajectory_id) WHERE censored <> declared)",
           "o", "trajectory_id censored declared"))
def censor_flag_drift(spark, d):
    """V8: trajectories whose derived censoring flag differs from the manifest."""
    p = stored_points(spark, d)
    flag = F.min((F.col("soh_true") > 0.7).cast("int"))
    man = p.groupBy(KEY).agg(F.when(F.col(KEY) % 7 == 0, F.lit(1)).otherwise(flag).alias("declared"))
    return V.flag_drift(W.rul_anchors(p), man, "censored", "declared")


@query(sql(DRIVERS + ", o AS (SELECT d.trajectory_id, d.reference_index, k_cyc, q0_ah FROM drv d JOIN par USING (trajectory_id))", "o", "trajectory_id reference_index", "k_cyc q0_ah"))
def parameters_joined(spark, d):
    """Drivers with their parameters, m:1 and full coverage asserted."""
    par = B.parameters(spark, d).select(KEY, "k_cyc", "q0_ah")
    return V.checked_join(B.drivers(spark, d).select(KEY, POS), par, KEY, "left", "m:1", cover=True)


@query(sql(TRAJ + ", o AS (SELECT trajectory_id, reference_index, soh_true, true AS long_enough FROM traj WHERE trajectory_id IN (SELECT trajectory_id FROM traj GROUP BY 1 HAVING count(*) >= 65) UNION ALL SELECT trajectory_id, count(*), 0, false FROM traj GROUP BY 1 HAVING count(*) < 65)",
           "o", "trajectory_id reference_index long_enough", "soh_true"))
def short_groups_reported(spark, d):
    """Usable groups, and one row for every group left out."""
    used, skipped = V.split_short_groups(stored_points(spark, d), 65, KEY, POS)
    a = used.select(KEY, POS, "soh_true", F.lit(True).alias("long_enough"))
    b = skipped.select(KEY, F.col("n_rows").alias(POS), F.lit(0.0).alias("soh_true"), F.lit(False).alias("long_enough"))
    return J.union_all([a, b])


@query(sql(WIN + ", ids AS (SELECT DISTINCT family, trajectory_id FROM traj), b AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY trajectory_id) AS r FROM ids), o AS (SELECT w.* FROM win w JOIN b USING (family, trajectory_id) WHERE r <= 10 AND horizon = 4 AND w.family <> 2)",
           "o", "trajectory_id family reference_index horizon", "y_delta"))
def stratum_rows(spark, d):
    """One horizon, outside the held-out family, inside the budget."""
    w = windows(spark, d)
    return V.stratum(w, 4, 2, W.budget_members(points(spark, d), 10)).select(KEY, "family", POS, "horizon", "y_delta")


@query(sql("""req AS (SELECT DISTINCT 'PROTOCOL_FIXED_HOLDOUT' AS protocol, 'FINAL_MODEL' AS arm, CASE user_id % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.95 ELSE 0.99 END::double AS coverage, (2 * (user_id % 4 + 1))::int AS horizon FROM events),
  o AS (SELECT *, 'NO_CALIBRATED_HALF_WIDTH' AS reason FROM req WHERE NOT (coverage IN (0.9, 0.95) AND horizon IN (2, 4, 8)))""", "o", "protocol arm horizon reason", "coverage"))
def half_width_refusals(spark, d):
    """Levels without a calibrated half-width are refused."""
    ev = spark.read.parquet(f"{d}/events.parquet").select("user_id")
    u = F.col("user_id") % 3
    req = ev.select(
        F.lit("PROTOCOL_FIXED_HOLDOUT").alias("protocol"), F.lit("FINAL_MODEL").alias("arm"),
        F.when(u == 0, 0.9).when(u == 1, 0.95).otherwise(0.99).alias("coverage"),
        (2 * (F.col("user_id") % 4 + 1)).cast("int").alias("horizon"),
    ).distinct()
    return V.half_width_refusals(req, B.half_widths(spark))


# ---------------------------------------------------------------- joins and sets

CAL = DRIVERS + ", l2 AS (SELECT *, (trajectory_id * 31 + reference_index * 14) % 365 AS day_of_year FROM drv), cal AS (SELECT DISTINCT family, day_of_year, 0.6::double + day_of_year / 1000.0::double + family / 100.0::double AS mean_soc_cal FROM l2)"


def calendar_tables(spark, d):
    """A full reference table without mean_soc, and the calendar that supplies it."""
    doy = (F.col(KEY) * 31 + F.col(POS) * 14) % 365
    l2 = B.drivers(spark, d).drop("mean_soc").withColumn("day_of_year", doy)
    soc = F.lit(0.6) + F.col("day_of_year") / F.lit(1000.0) + F.col("family") / F.lit(100.0)
    return l2, l2.select("family", "day_of_year").distinct().withColumn("mean_soc", soc)


@query(sql(CAL + ", o AS (SELECT l.trajectory_id, l.reference_index, mean_soc_cal FROM l2 l LEFT JOIN cal USING (family, day_of_year))", "o", "trajectory_id reference_index", "mean_soc_cal"))
def calendar_join(spark, d):
    """M:1 join on a composite key with a coverage check."""
    l2, cal = calendar_tables(spark, d)
    out = V.checked_join(l2, cal, ["family", "day_of_year"], "left", "m:1", cover=True)
    return out.select(KEY, POS, F.col("mean_soc").alias("mean_soc_cal"))


@query(sql(TRAJ + ", o AS (SELECT a.trajectory_id, a.reference_index, a.soh_true, b.soh_observed AS other FROM traj a LEFT JOIN (SELECT * FROM traj WHERE soh_observed < soh_true) b USING (trajectory_id, reference_index))",
           "o", "trajectory_id reference_index", "soh_true other"))
def one_to_one_left(spark, d):
    """1:1 join on trajectory and index, left side kept whole."""
    p = stored_points(spark, d)
    b = p.where(F.col("soh_observed") < F.col("soh_true")).select(KEY, POS, F.col("soh_observed").alias("other"))
    return V.checked_join(p.select(KEY, POS, "soh_true"), b, [KEY, POS], "left", "1:1")


@query(sql(TRAJ + ", o AS (SELECT count(*) AS n_common, max(abs(a.soh_true - b.soh_observed)) AS max_abs_diff FROM traj a JOIN traj b ON a.trajectory_id = b.trajectory_id AND a.family = b.family AND a.reference_index = b.reference_index)",
           "o", "n_common", "max_abs_diff"))
def table_deviation(spark, d):
    """Largest difference of a measure between two tables on three keys."""
    p = stored_points(spark, d)
    b = p.withColumn("soh_true", F.col("soh_observed"))
    return J.table_deviation(p, b, ["family", KEY, POS], "soh_true")


@query(sql("a AS (SELECT DISTINCT user_id AS trajectory_id FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT CASE WHEN event_id % 50 = 7 THEN -user_id ELSE user_id END AS trajectory_id FROM events WHERE event_type = 'error'), o AS (SELECT trajectory_id, 'right' AS missing_in FROM a ANTI JOIN b USING (trajectory_id) UNION ALL SELECT trajectory_id, 'left' FROM b ANTI JOIN a USING (trajectory_id))",
           "o", "trajectory_id missing_in"))
def identity_mismatch(spark, d):
    """Identities on one side only, both ways."""
    ev, u = spark.read.parquet(f"{d}/events.parquet"), F.col("user_id")
    damaged = F.when(F.col("event_id") % 50 == 7, -u).otherwise(u)
    of = lambda t, key: ev.where(F.col("event_type") == t).select(key.alias(KEY))
    return J.id_mismatch(of("click", u), of("error", damaged))


@query(sql("decl AS (SELECT l_partkey AS k, count(*)::varchar AS h FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), pres AS (SELECT l_partkey AS k, count(*)::varchar AS h FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), o AS (SELECT coalesce(a.k, b.k) AS part_id, CASE WHEN b.h IS NULL THEN 'MISSING' WHEN a.h IS NULL THEN 'UNLISTED' WHEN a.h <> b.h THEN 'MISMATCH' ELSE 'OK' END AS status FROM decl a FULL JOIN pres b ON a.k = b.k)",
           "o", "part_id status"))
def inventory_reconcile(spark, d):
    """Full outer reconcile of declared and present keys."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    of = lambda flag: li.where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("part_id")).agg(
        F.count("*").cast("string").alias("digest"))
    return J.reconcile(of("R"), of("A"), "part_id", "digest")


@query()
def file_reconcile(spark, d):
    """Files of the landing zone against a manifest with one stale hash and one missing file."""
    inv = S.file_inventory(spark, d)
    stale = F.when(F.col("file").startswith("region"), F.lit("stale")).otherwise(F.col("sha256"))
    gone = grid(spark, [("gone.parquet", "0")], "file string, sha256 string")
    manifest = inv.select("file", stale.alias("sha256")).unionByName(gone)
    return S.reconcile_files(spark, d, manifest)


@query(sql(TRAJ + ", o AS (SELECT trajectory_id, family, reference_index, floor(soh_observed * 1000) / 1000 AS soh_observed, soh_true FROM traj)", "o", "trajectory_id family reference_index", "soh_observed soh_true"))
def overlay_columns(spark, d):
    """Numeric columns replaced from a second copy with the same keys."""
    p = stored_points(spark, d).withColumn("uid", F.concat_ws("|", KEY, POS))
    other = p.select("uid", (F.floor(F.col("soh_observed") * 1000) / F.lit(1000.0)).alias("soh_observed"))
    return J.overlay(p, other, "uid", ["soh_observed"]).select(KEY, "family", POS, "soh_observed", "soh_true")


@query(sql("o AS (SELECT DISTINCT user_id AS trajectory_id FROM events EXCEPT SELECT l_suppkey FROM lineitem)", "o", "trajectory_id"))
def ids_missing(spark, d):
    """Declared ids that are not present (EXCEPT)."""
    a = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias(KEY))
    b = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias(KEY))
    return J.missing_in(a, b)


@query(sql("o AS (SELECT user_id AS trajectory_id FROM events INTERSECT SELECT l_suppkey FROM lineitem)", "o", "trajectory_id"))
def ids_common(spark, d):
    """Ids of both tables (INTERSECT)."""
    a = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias(KEY))
    b = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias(KEY))
    return J.common(a, b)


@query(sql("o AS (SELECT DISTINCT user_id % 6 AS family FROM events)", "o", "family"))
def distinct_families(spark, d):
    """Distinct families."""
    return J.families(spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 6).alias("family")))
