"""Driver tables mapped onto the engine's data model, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each entity and observation."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.when(F.col("user_id") % 3 == 0, "a").otherwise("b").alias("system_id"),
        F.col("user_id").cast("string").alias("station_id"),
        F.col("ts").alias("observed_at"),
        (F.col("ts") + F.make_dt_interval(secs=F.col("event_id") % 240)).alias("fetched_at"),
        F.when(F.col("event_id") % 97 == 0, -1).otherwise(F.floor(F.abs("value")) % 20).cast("int").alias("bikes"),
        ((F.col("event_id") * 7) % 15).cast("int").alias("docks"),
        F.when(F.col("event_id") % 50 == 0, 1).otherwise(7).cast("int").alias("flags"),
        (F.col("event_id") % 60).cast("int").alias("reported_age_s"),
    )


OBS = """obs AS (
  SELECT CASE WHEN user_id % 3 = 0 THEN 'a' ELSE 'b' END AS system_id, user_id::VARCHAR AS station_id, ts AS observed_at,
    ts + to_seconds(event_id % 240) AS fetched_at,
    CASE WHEN event_id % 97 = 0 THEN -1 ELSE floor(abs(value))::BIGINT % 20 END::INT AS bikes,
    ((event_id * 7) % 15)::INT AS docks, CASE WHEN event_id % 50 = 0 THEN 1 ELSE 7 END::INT AS flags, (event_id % 60)::INT AS reported_age_s
  FROM events)"""


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger: every customer as a station, with coordinates, codes and a declared capacity. Every thousand stations fill a square of their own, so their density does not grow with the table."""
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.when(k % 3 == 0, "a").otherwise("b").alias("system_id"),
        k.cast("string").alias("station_id"),
        F.col("c_name").alias("name"),
        F.round(35 + (k % 1000) / F.lit(5000) + F.floor(k / 1000) % 40 * 0.25, 6).alias("lat"),
        F.round(139 + ((k * 7) % 1000) / F.lit(5000) + F.floor(k / 40000) * 0.25, 6).alias("lon"),
        F.when(k % 11 == 0, None).otherwise(F.abs(F.col("c_acctbal")).cast("int") % 30).cast("int").alias("capacity"),
        (k % 13).cast("int").alias("capacity_est"),
        F.col("c_nationkey").cast("int").alias("pref_code"),
        (k % 2 == 0).alias("is_charging"),
        (k % 37 == 0).alias("geo_suspect"),
    )


STATIONS = """stations AS (
  SELECT CASE WHEN c_custkey % 3 = 0 THEN 'a' ELSE 'b' END AS system_id, c_custkey::VARCHAR AS station_id, c_name AS name,
    round(35 + (c_custkey % 1000) / 5000.0::DOUBLE + (c_custkey // 1000) % 40 * 0.25::DOUBLE, 6) AS lat, round(139 + ((c_custkey * 7) % 1000) / 5000.0::DOUBLE + (c_custkey // 40000) * 0.25::DOUBLE, 6) AS lon,
    CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE trunc(abs(c_acctbal))::INT % 30 END::INT AS capacity,
    (c_custkey % 13)::INT AS capacity_est, c_nationkey::INT AS pref_code, c_custkey % 2 = 0 AS is_charging, c_custkey % 37 = 0 AS geo_suspect
  FROM customer)"""


def attribute_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute snapshots in time: a customer's orders, their status and priority as changing attributes."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").cast("string").alias("station_id"),
        F.col("o_orderdate").alias("fetched_at"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderstatus").alias("name"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("capacity"),
    )


VERSIONS = """versions AS (
  SELECT o_custkey::VARCHAR AS station_id, o_orderdate AS fetched_at, o_orderkey AS seq, o_orderstatus AS name, substr(o_orderpriority, 1, 1)::INT AS capacity
  FROM orders)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows: a probability in thousandths, an outcome, a weight, and slice keys."""
    x = read(spark, sf_dir, "lineitem")
    h = (F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17 + F.col("l_partkey") * 7) % 1001
    return x.select(
        F.when(F.col("l_suppkey") % 3 == 0, "a").otherwise("b").alias("system_id"),
        F.col("l_suppkey").cast("string").alias("station_id"),
        h.cast("int").alias("p1000"),
        ((F.col("l_partkey") * 13 + F.col("l_linenumber")) % 1001).cast("int").alias("q1000"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.col("l_quantity").cast("long").alias("w"),
        F.element_at(F.array(F.lit(5), F.lit(15), F.lit(30), F.lit(60)), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("h_min"),
        (F.col("l_partkey") % 14).cast("int").alias("bikes"),
        F.element_at(F.array(F.lit("sat"), F.lit("sun_holiday"), F.lit("weekday")), (F.col("l_orderkey") % 3 + 1).cast("int")).alias("dow_type"),
        ((F.col("l_orderkey") * 5) % 1440).cast("int").alias("minute"),
        F.to_date("l_shipdate").alias("day"),
    )


SCORES = """scores AS (
  SELECT CASE WHEN l_suppkey % 3 = 0 THEN 'a' ELSE 'b' END AS system_id, l_suppkey::VARCHAR AS station_id,
    ((l_orderkey * 31 + l_linenumber * 17 + l_partkey * 7) % 1001)::INT AS p1000, ((l_partkey * 13 + l_linenumber) % 1001)::INT AS q1000,
    (l_returnflag = 'R')::INT AS y, l_quantity::BIGINT AS w, ([5, 15, 30, 60])[l_linenumber % 4 + 1]::INT AS h_min, (l_partkey % 14)::INT AS bikes,
    (['sat', 'sun_holiday', 'weekday'])[l_orderkey % 3 + 1] AS dow_type, ((l_orderkey * 5) % 1440)::INT AS minute, l_shipdate::DATE AS day
  FROM lineitem)"""


def job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job log: an event is a run, its type the job, ``error`` a failure."""
    e = read(spark, sf_dir, "events")
    ok = F.when(F.col("event_type") == "error", "failed").when(F.col("event_id") % 41 == 0, "running").otherwise("ok")
    return e.select(
        F.col("event_id").alias("run_id"),
        F.concat(F.col("event_type"), F.lit("-"), (F.col("user_id") % 4).cast("string")).alias("job"),
        F.when(F.col("user_id") % 3 == 0, "a").otherwise("b").alias("system_id"),
        F.col("ts").alias("started_at"),
        F.when(ok != "running", F.col("ts") + F.make_dt_interval(secs=F.col("event_id") % 90)).alias("finished_at"),
        ok.alias("status"),
        F.when(ok == "failed", F.concat(F.lit("e"), (F.col("event_id") % 7).cast("string"))).alias("error"),
        F.col("props").alias("detail"),
    )


JOBS = """jobs AS (
  SELECT event_id AS run_id, event_type || '-' || (user_id % 4)::VARCHAR AS job, CASE WHEN user_id % 3 = 0 THEN 'a' ELSE 'b' END AS system_id, ts AS started_at,
    CASE WHEN event_type = 'error' OR event_id % 41 <> 0 THEN ts + to_seconds(event_id % 90) END AS finished_at,
    CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 41 = 0 THEN 'running' ELSE 'ok' END AS status,
    CASE WHEN event_type = 'error' THEN 'e' || (event_id % 7)::VARCHAR END AS error, props AS detail
  FROM events)"""
