"""Queries of merging sinks, ordered replay, windows of retention, places in two levels and clustered boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moorline.operators import archive, explore, ingest, keyed, layout, reference, replay
from moorline.plans import q_features as Q
from moorline.plans import q_ingest as I
from moorline.plans import q_read as R
from moorline.plans.scratch import folder as scratch
from moorline.plans.scratch import written
from moorline.sources import tables as T

KEYS = ingest.KEYS


def src_11_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What the merge step makes of each id of its input."""
    current, incoming = I.versions_to_merge(spark, d)
    return ingest.scd2_outcomes(current, incoming, ["station_id"], "fetched_at", ["name", "capacity"], I.loose()).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def src_16_merge_sink(spark: SparkSession, d: str) -> DataFrame:
    """The newest row of each entity and day as a table in partitions, made by two merges, the second of which runs twice."""
    o = T.obs_long(spark, d).select(*KEYS, F.date_format("observed_at", "yyyy-MM-dd").alias("day"), "observed_at", "bikes", "docks")
    path, keys = scratch(spark, "merged"), [*KEYS, "day"]
    late = o.where(F.col("observed_at").between("2024-01-15", "2024-01-25"))
    for updates in (o.where(F.col("observed_at") < "2024-01-20 06:00:00"), late, late):
        keyed.merge(spark, path, updates, keys, "observed_at", ["system_id", "day"], written)
    return spark.read.schema(o.schema).parquet(path)


def arc_04_recent(spark: SparkSession, d: str) -> DataFrame:
    """Hours of the last six, without the newest, that lack their file."""
    o = T.obs_long(spark, d).withColumn("hour", F.date_trunc("hour", F.col("observed_at")).cast("timestamp_ntz"))
    now = F.to_timestamp_ntz(F.lit("2024-01-20 12:34:00"))
    return archive.gaps(o, o.where("bikes % 5 < 3 and bikes >= 0"), ["system_id", "hour"], now)


def arc_08_windows(spark: SparkSession, d: str) -> DataFrame:
    """Rows kept and dropped by each kind of keep-window."""
    now = lambda at: F.to_timestamp_ntz(F.lit(at))
    j = T.job_runs(spark, d).withColumn("name", F.regexp_extract("job", "^[a-z]+", 0))
    runs = j.select(F.lit("job_runs").alias("kind"), archive.kept_run("name", "status", "started_at", now("2024-02-14 12:00:00"), ("click", "view")).alias("kept"))
    hours = T.obs_long(spark, d).select(F.lit("hourly").alias("kind"), archive.kept_hour("observed_at", now("2024-01-29 07:30:00")).alias("kept"))
    months = T.read(spark, d, "orders").select(F.lit("months").alias("kind"), archive.kept_month("o_orderdate", now("1998-06-30 00:00:00")).alias("kept"))
    return runs.unionByName(hours).unionByName(months).groupBy("kind", "kept").agg(F.count(F.lit(1)).alias("n"))


def raw_files(spark: SparkSession, d: str) -> DataFrame:
    """Raw feeds as files named by their epochs: system_id, epoch_s, path."""
    path = scratch(spark, "raw")
    f = I.feed_json(spark, d).withColumn("epoch_s", F.unix_timestamp(F.col("hour").cast("timestamp")) + 3600)
    f = written(f.withColumn("file", F.concat(F.col("epoch_s").cast("string"), F.lit(".json"))), "feeds")
    f.select("system_id", "file", F.col("raw").alias("value")).repartition("system_id", "file").write.partitionBy("system_id", "file").text(path)
    return f.select("system_id", "epoch_s", F.concat(F.lit(f"{path}/system_id="), "system_id", F.lit("/file="), "file").alias("path"))


def arc_10_apply(spark: SparkSession, d: str) -> DataFrame:
    """All raw files replayed in two runs, ten days of them at once."""
    files, target = raw_files(spark, d), scratch(spark, "replayed")
    ten = F.lpad(F.floor(F.col("epoch_s") / 864_000).cast("string"), 9, "0")
    replay.replay(spark, files, target, ten, most=2)
    replay.replay(spark, files, target, ten)
    rows = spark.read.parquet(f"{target}/rows")
    return rows.groupBy("system_id", "observed_at").agg(F.count(F.lit(1)).alias("n"), F.sum("bikes").alias("sum_bikes"), F.sum("flags").alias("sum_flags"))


def qry_02_clustered(spark: SparkSession, d: str) -> DataFrame:
    """The box of qry_02 from the current stations in a clustered layout."""
    path = scratch(spark, "clustered")
    layout.write(R.all_stations(spark, d), path, 8)
    return layout.inside(spark.read.parquet(path), 139.02, 35.0, 139.08, 35.05).select(*KEYS, "lat", "lon")


def addresses(spark: SparkSession, d: str) -> DataFrame:
    """Stations with an address: nation, segment and name in one text; some are written otherwise and match nothing."""
    c = T.read(spark, d, "customer").join(F.broadcast(T.read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.concat("n_name", "c_mktsegment", "c_name")
    return c.select("c_custkey", F.when(F.col("c_custkey") % 17 == 0, F.lower(text)).otherwise(text).alias("address"))


def place_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """First level: nations. Second level, inside a nation: its segments, whole and by their first four letters; some nations lack some."""
    n = T.read(spark, d, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    s = T.read(spark, d, "customer").select(F.col("c_nationkey").alias("code"), "c_mktsegment").distinct()
    whole = s.where((F.col("code") + F.length("c_mktsegment")) % 3 != 0).select("code", F.col("c_mktsegment").alias("sub_name"))
    second = whole.unionByName(s.select("code", F.substring("c_mktsegment", 1, 4).alias("sub_name"))).distinct()
    return n.where("code % 7 <> 3"), second.withColumn("sub_code", F.concat(F.col("code").cast("string"), F.lit("-"), "sub_name"))


def ref_02_places(spark: SparkSession, d: str) -> DataFrame:
    """Places of all addresses against an older list of them: what a rewrite adds, changes and leaves."""
    new = reference.places(addresses(spark, d), "address", *place_lists(spark, d), ["c_custkey"])
    new = written(new, "places")
    k = F.col("c_custkey")
    base = new.where(k % 13 != 0).withColumn("code", F.when(k % 5 == 0, -1).otherwise(F.col("code")))
    return keyed.rewritten(base, new, ["c_custkey"], ["code", "sub_code"]).select("c_custkey", "code", "sub_code", "outcome")


def eda_08_bands(spark: SparkSession, d: str) -> DataFrame:
    """Capacities told from all, from the prefecture and from neighbours within a kilometre, by how many there are."""
    s = T.stations(spark, d)
    return explore.banded_mae(s.where("not geo_suspect"), reference.neighbours(s, 1000.0), "pref_code", "capacity")


QUERIES = {f.__name__: f for f in (src_11_outcomes, src_16_merge_sink, arc_04_recent, arc_08_windows, arc_10_apply, qry_02_clustered, ref_02_places, eda_08_bands)}

ORACLE = {
    "src_11_outcomes": f"""WITH {I.MERGE}
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN c.station_id IS NULL THEN 'new' WHEN NOT ({I.CHANGED}) THEN 'unchanged' WHEN x.f > valid_from THEN 'changed' ELSE 'skipped_older' END AS outcome FROM inc LEFT JOIN (SELECT * FROM cur WHERE valid_to IS NULL) c USING (station_id)) GROUP BY 1""",
    "src_16_merge_sink": f"""WITH {T.OBS}, x AS (SELECT system_id, station_id, strftime(observed_at, '%Y-%m-%d') AS day, max(struct_pack(o := observed_at, b := bikes, d := docks)) AS v FROM obs WHERE observed_at < TIMESTAMP '2024-01-20 06:00:00' OR observed_at BETWEEN TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-01-25' GROUP BY ALL)
SELECT system_id, station_id, day, v.o AS observed_at, v.b AS bikes, v.d AS docks FROM x""",
    "arc_04_recent": f"""WITH {T.OBS}, o AS (SELECT system_id, date_trunc('hour', observed_at)::TIMESTAMP AS hour, bikes FROM obs)
SELECT system_id, hour FROM o WHERE hour >= TIMESTAMP '2024-01-20 06:00:00' AND hour < TIMESTAMP '2024-01-20 12:00:00' GROUP BY ALL HAVING count(*) FILTER (bikes % 5 < 3 AND bikes >= 0) = 0""",
    "arc_08_windows": f"""WITH {T.JOBS}, {T.OBS}, x AS (SELECT 'job_runs' AS kind, started_at >= CASE WHEN regexp_extract(job, '^[a-z]+') IN ('click', 'view') AND status = 'ok' THEN TIMESTAMP '2024-02-14 12:00:00' - INTERVAL 90 DAY ELSE TIMESTAMP '2024-02-14 12:00:00' - INTERVAL 30 DAY END AS kept FROM jobs
UNION ALL SELECT 'hourly', observed_at >= TIMESTAMP '2024-01-28 05:30:00' FROM obs UNION ALL SELECT 'months', date_trunc('month', o_orderdate) + INTERVAL 1 MONTH > TIMESTAMP '1998-06-30' - INTERVAL 60 DAY FROM orders)
SELECT kind, kept, count(*) AS n FROM x GROUP BY ALL""",
    "arc_10_apply": f"WITH {I.FEED_ROWS} SELECT system_id, hour + INTERVAL 1 HOUR AS observed_at, count(*) AS n, sum(bikes)::BIGINT AS sum_bikes, sum(flags)::BIGINT AS sum_flags FROM norm WHERE n = 1 GROUP BY ALL",
    "qry_02_clustered": R.ORACLE["qry_02_box"],
    "ref_02_places": """WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN lower(n_name || c_mktsegment || c_name) ELSE n_name || c_mktsegment || c_name END AS address FROM customer JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT DISTINCT c_nationkey AS code, c_mktsegment AS m FROM customer), sec AS (SELECT code, m AS sub_name FROM s WHERE (code + length(m)) % 3 <> 0 UNION SELECT code, substr(m, 1, 4) FROM s),
f AS (SELECT c_custkey, address, n_nationkey AS code, n_name, row_number() OVER (PARTITION BY c_custkey ORDER BY length(n_name) DESC) AS r FROM a LEFT JOIN nation ON starts_with(address, n_name) AND n_nationkey % 7 <> 3),
g AS (SELECT f.c_custkey, f.code, f.code::VARCHAR || '-' || sub_name AS sub_code, row_number() OVER (PARTITION BY f.c_custkey ORDER BY length(sub_name) DESC NULLS LAST) AS r FROM (SELECT * FROM f WHERE r = 1) f LEFT JOIN sec ON sec.code = f.code AND starts_with(substr(address, length(n_name) + 1), sub_name))
SELECT c_custkey, code, sub_code, CASE WHEN c_custkey % 13 = 0 THEN 'added' WHEN c_custkey % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS outcome FROM g WHERE r = 1""",
    "eda_08_bands": f"""WITH {T.STATIONS}, {Q.EDGES.replace("dist <= 500", "dist <= 1000").replace("0.0101", "0.0201")}, k AS (SELECT system_id, station_id, pref_code, capacity::DOUBLE AS v FROM stations WHERE NOT geo_suspect AND capacity IS NOT NULL),
n AS (SELECT e.system_id, e.station_id, avg(b.v) AS near, count(*) AS c FROM edges e JOIN k b ON b.system_id = e.nb_system_id AND b.station_id = e.nb_station_id GROUP BY ALL),
x AS (SELECT k.*, sum(v) OVER () AS ts, count(*) OVER () AS tc, sum(v) OVER p AS s, count(*) OVER p AS pc, near, coalesce(c, 0) AS c FROM k LEFT JOIN n USING (system_id, station_id) WINDOW p AS (PARTITION BY pref_code)),
y AS (SELECT *, (ts - v) / (tc - 1) AS a, CASE WHEN pc > 1 THEN (s - v) / (pc - 1) ELSE (ts - v) / (tc - 1) END AS o FROM x)
SELECT CASE WHEN c >= 20 THEN 20 WHEN c >= 5 THEN 5 WHEN c >= 1 THEN 1 ELSE 0 END::INT AS least_neighbours, count(*) AS n, round(avg(abs(a - v)), 6) AS mae_all, round(avg(abs(o - v)), 6) AS mae_group, round(avg(abs(coalesce(near, o) - v)), 6) AS mae_near FROM y GROUP BY 1""",
}
