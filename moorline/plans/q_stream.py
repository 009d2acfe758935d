"""Queries of the streaming forms: driver tables are read as a stream of files, and run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moorline.config import SPARSE
from moorline.plans import q_features as Q
from moorline.plans import q_ingest as I
from moorline.plans import q_read as R
from moorline.plans.scratch import files_in
from moorline.sources import tables as T
from moorline.streaming import streams as S

KEYS = S.KEYS


#: Starts of the slices of the event tables: each becomes one micro-batch.
SLICES = ("2024-01-06", "2024-01-11", "2024-01-16", "2024-01-21", "2024-01-26")
FILE_BYTES = 2 << 20  #: about what a file of a slice holds


def stream_of(spark: SparkSession, df: DataFrame, name: str, time: str, late: str | None = None) -> DataFrame:
    """A batch table laid down in slices of ``time``, oldest first, and read as a stream of one slice a trigger.

    All slices have the same number of files, by the table's size, and a trigger takes that many: a large slice is
    written and read by many tasks. Slices with fewer filled files get empty ones.
    Rows where the flag ``late`` is true come with the last slice, whatever their time.
    """
    path = I.scratch(spark, name)
    place = F.lit(0)
    for start in SLICES:
        place = place + (F.col(time).cast("timestamp_ntz") >= F.to_timestamp_ntz(F.lit(f"{start} 00:00:00"))).cast("int")
    if late:
        place = F.when(F.col(late), len(SLICES)).otherwise(place)
    sliced = I.scratch(spark, f"{name}-slices")
    df.withColumn("_slice", place).write.partitionBy("_slice").parquet(sliced)
    rows = spark.read.schema(df.withColumn("_slice", place).schema).parquet(sliced)
    n_files = -(-files_in(spark, sliced)[1] // (FILE_BYTES * (len(SLICES) + 1))) or 1
    for n in range(len(SLICES) + 1):
        one = rows.where(F.col("_slice") == n).drop("_slice")
        (one.repartition(n_files) if n_files > 1 else one.coalesce(1)).write.mode("append").parquet(path)
        for _ in range(files_in(spark, path)[0], n_files * (n + 1)):
            spark.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", n_files).parquet(path)


def drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    return S.run_all(stream, I.scratch(spark, f"{name}-out"), I.scratch(spark, f"{name}-state"))


def folded(stream: DataFrame, fold, name: str) -> int:  # noqa: ANN001
    """Drive a stream over a foreachBatch to the end of what is there; the number of the last batch."""
    spark = stream.sparkSession
    q = stream.writeStream.foreachBatch(fold).option("checkpointLocation", I.scratch(spark, f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q.lastProgress["batchId"] if q.lastProgress else 0


def edge(df: DataFrame) -> DataFrame:
    return df.withColumn("observed_at", F.col("observed_at").cast("timestamp"))


def feed_tables(spark: SparkSession, d: str) -> str:
    """The three tables that the feed stream writes."""
    path = I.scratch(spark, "feeds-out")
    folded(stream_of(spark, I.feed_json(spark, d), "feeds", "hour"), S.feed_sinks(path, ["system_id", "hour"]), "feeds")
    return path


def str_01_feeds(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{feed_tables(spark, d)}/rows").select("system_id", "hour", "station_id", "bikes", "docks", "flags", "reported_age_s")


def str_01_warnings(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{feed_tables(spark, d)}/warnings").drop("batch")


def str_01_quarantine(spark: SparkSession, d: str) -> DataFrame:
    q = spark.read.parquet(f"{feed_tables(spark, d)}/quarantine")
    return q.select("system_id", "hour", F.size("issues").alias("n_issues"), F.array_join("issues", "; ").alias("issues"))


def some_late(spark: SparkSession, d: str) -> DataFrame:
    """Observations with a flag on those that reach the stream with the last slice."""
    return edge(T.obs_long(spark, d)).withColumn("late", F.col("fetched_at") == F.col("observed_at").cast("timestamp_ntz"))


def str_02_deduplicate(spark: SparkSession, d: str) -> DataFrame:
    """Rows once each: doubled ones (in their own batch, and again with the last one) fall to state or watermark, and rows that first come too late are dropped."""
    o = some_late(spark, d).select(*KEYS, "observed_at", "bikes", "late")
    again = o.where("bikes % 2 = 0").unionByName(o.where("bikes % 3 = 0").withColumn("late", F.lit(True)))
    x = drained(spark, S.deduplicate(stream_of(spark, o.unionByName(again), "dedup", "observed_at", "late")), "dedup")
    return x.select(*KEYS, F.col("observed_at").cast("timestamp_ntz").alias("observed_at"))


def str_03_latest(spark: SparkSession, d: str) -> DataFrame:
    """Latest state after all daily snapshots, folded by foreachBatch, several to a batch; every seventh day's are anomalous."""
    _, rows = I.daily_rows(spark, d)
    x = rows.select(*KEYS, "observed_at", (F.dayofmonth("observed_at") % 7 == 0).alias("is_anomalous"), "bikes", "docks", "flags")
    path = I.scratch(spark, "latest")
    last = folded(stream_of(spark, x, "snapshots", "observed_at"), S.merge_latest(path), "latest")
    return spark.read.parquet(f"{path}/edition={last}").select(*KEYS, "observed_at", "bikes", "docks", "flags", "is_present")


def str_04_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Completed hours: those that end by the watermark. Rows that come after their hour is out are dropped."""
    x = drained(spark, S.hourly(stream_of(spark, some_late(spark, d), "hourly", "observed_at", "late")), "hourly")
    return x.select(*KEYS, F.col("hour_start").cast("timestamp_ntz").alias("hour_start"), "n", "sum_bikes", "sum_docks")


def str_05_flow(spark: SparkSession, d: str) -> DataFrame:
    S.with_state(spark)
    x = drained(spark, S.flow(stream_of(spark, T.obs_long(spark, d), "flow", "observed_at"), SPARSE.flow_min, SPARSE.change_cap_min), "flow")
    return x.select(*KEYS, F.timestamp_micros("us").cast("timestamp_ntz").alias("observed_at"), "rentals", "returns", "n_changes", F.round("since_change_min", 6).alias("since_change_min"))


def str_06_suppress(spark: SparkSession, d: str) -> DataFrame:
    S.with_state(spark)
    j = T.job_runs(spark, d).where("status = 'failed'").select("job", "started_at")
    x = drained(spark, S.suppress(stream_of(spark, j, "alerts", "started_at"), "job", "started_at", 86400), "alerts")
    return x.select(F.col("key").alias("job"), F.timestamp_micros("us").cast("timestamp_ntz").alias("sent_at"))


#: Rows of the last batch are late by the watermark that the batch before it ran under, which is that of the rows of the batch before that.
LATE = f"""{T.OBS}, flagged AS (SELECT *, fetched_at = observed_at AS late FROM obs),
mark AS (SELECT max(observed_at) - INTERVAL 10 MINUTE AS wm FROM flagged WHERE NOT late AND observed_at < TIMESTAMP '{SLICES[-2]}')"""

QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("str_")}

ORACLE = {
    "str_01_feeds": I.ORACLE["src_02_normalise"],
    "str_01_warnings": I.ORACLE["src_02_warnings"],
    "str_01_quarantine": f"SELECT * FROM ({I.ORACLE['src_01_validate']}) WHERE n_issues > 0",
    "str_02_deduplicate": f"""WITH {LATE}, kept AS (SELECT system_id, station_id, observed_at FROM flagged WHERE NOT late OR observed_at > (SELECT wm FROM mark)) SELECT DISTINCT * FROM kept""",
    "str_03_latest": f"""WITH {I.DAILY}, x AS (SELECT *, day(observed_at) % 7 = 0 AS bad FROM daily), h AS (SELECT DISTINCT system_id, observed_at AS at_, bad FROM x),
s AS (SELECT system_id, station_id, min(observed_at) AS f FROM x GROUP BY ALL), g AS (SELECT s.system_id, s.station_id, at_, h.bad, x.bikes, x.docks, x.flags, x.observed_at IS NOT NULL AS here FROM s JOIN h ON h.system_id = s.system_id AND at_ >= f LEFT JOIN x ON x.system_id = s.system_id AND x.station_id = s.station_id AND x.observed_at = at_),
v AS (SELECT *, last_value(bikes IGNORE NULLS) OVER w AS b, last_value(docks IGNORE NULLS) OVER w AS dk, last_value(flags IGNORE NULLS) OVER w AS fl, last_value(CASE WHEN NOT bad OR here THEN here END IGNORE NULLS) OVER w AS pr FROM g WINDOW w AS (PARTITION BY system_id, station_id ORDER BY at_)),
c AS (SELECT *, lag(struct_pack(b, dk, fl, pr)) OVER (PARTITION BY system_id, station_id ORDER BY at_) AS p FROM v), k AS (SELECT * FROM c WHERE p IS NULL OR p <> struct_pack(b, dk, fl, pr))
SELECT system_id, station_id, max(at_) AS observed_at, arg_max(b, at_) AS bikes, arg_max(dk, at_) AS docks, arg_max(fl, at_) AS flags, arg_max(pr, at_) AS is_present FROM k GROUP BY ALL""",
    "str_04_hourly": f"""WITH {LATE.replace("FROM flagged WHERE NOT late", "FROM flagged WHERE bikes >= 0 AND docks >= 0 AND NOT late")}, kept AS (SELECT *, date_trunc('hour', observed_at)::TIMESTAMP AS hour_start FROM flagged WHERE bikes >= 0 AND docks >= 0),
top AS (SELECT max(observed_at) - INTERVAL 10 MINUTE AS final FROM kept)
SELECT system_id, station_id, hour_start, count(*) AS n, sum(bikes)::BIGINT AS sum_bikes, sum(docks)::BIGINT AS sum_docks FROM kept WHERE (NOT late OR hour_start + INTERVAL 1 HOUR > (SELECT wm FROM mark)) AND hour_start + INTERVAL 1 HOUR <= (SELECT final FROM top) GROUP BY ALL""",
    "str_05_flow": f"WITH {T.OBS}, {Q.FLOW} SELECT system_id, station_id, observed_at, rentals, returns, n_changes, round(since, 6) AS since_change_min FROM flow",
    "str_06_suppress": R.ORACLE["mon_12_suppress"],
}
