"""Streaming jobs run over the available input, then read back."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import query, table
from checks.rules import BOOK, FACTS, answers
from sparkcurate.session import fresh_path
from sparkcurate.streaming import jobs


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query("""
WITH w AS (SELECT event_type AS key, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n,
  quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, avg(value) AS mean
  FROM events GROUP BY ALL)
SELECT key, strftime(start, '%Y-%m-%d') AS day, n, round(p50, 4) AS p50, round(p95, 4) AS p95, round(mean * n, 2) AS total
FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_latency_windows(spark: SparkSession, sf: str) -> DataFrame:
    """ST2: percentiles per day and key; only closed windows come out."""
    windows = jobs.latency_counts(_stream(spark, sf, "events"), "ts", "event_type", "value")
    path = fresh_path(spark, "windows")
    run = jobs.to_table(windows, path, fresh_path(spark, "windows-state"))
    run.awaitTermination()
    out = jobs.latency_windows(spark.read.schema(windows.schema).parquet(path))
    return out.select("key", F.date_format("start", "yyyy-MM-dd").alias("day"), "n",
                      F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"),
                      F.round(F.col("mean") * F.col("n"), 2).alias("total"))


@query(f"""
WITH {FACTS}
SELECT i AS id, parsed AND no_claims AND n_ok = n_ev AND cue AND calibrated AND runbook AND sub_ok AND ladder AND no_promise AS passed
FROM v""")
def stream_gate(spark: SparkSession, sf: str) -> DataFrame:
    """ST1: the gate over a stream of answers, accepted and quarantined rows in two tables."""
    source = fresh_path(spark, "answers")
    rows = answers(spark, sf).select(F.col("id").cast("string").alias("id"), "complaint", "answer")
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    good, bad = fresh_path(spark, "passed"), fresh_path(spark, "quarantine")
    jobs.gate(stream, BOOK, good, bad, fresh_path(spark, "gate-state")).awaitTermination()
    passed = spark.read.parquet(good).select("id", F.lit(True).alias("passed"))
    held = spark.read.parquet(bad).select("id", F.lit(False).alias("passed"))
    return passed.unionByName(held).withColumn("id", F.col("id").cast("long"))


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_first_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """ST3: replays of an id within the delay are dropped."""
    stream = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first = jobs.first_arrivals(stream, ("user_id", "event_type"), "ts", "1 day")
    path = fresh_path(spark, "arrivals")
    jobs.to_table(first.select("user_id", "event_type"), path, fresh_path(spark, "arrivals-state")).awaitTermination()
    out = spark.read.schema("user_id LONG, event_type STRING").parquet(path)
    return out.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH RECURSIVE k AS (SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY ALL UNION ALL
  SELECT e.user_id, e.event_type, min(e.ts) FROM k JOIN events e ON e.user_id = k.user_id AND e.event_type = k.event_type
    AND e.ts > k.ts + INTERVAL 3 DAY GROUP BY ALL)
SELECT user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS kept FROM k""")
def stream_kept_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """ST2, ST3: arrivals three days apart, over five runs from one checkpoint, with replays in the next and late copies
    three runs on."""
    before = {name: spark.conf.get(name, None) for name in jobs.ROCKSDB}
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    run = F.floor((F.col("ts").cast("double") - F.lit(1704067200)) / (6 * 86400))
    again = F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).when(
        F.col("event_id") % 10 == 1, F.array(F.lit(0), F.lit(3))).otherwise(F.array(F.lit(0)))
    rows = events.withColumn("after", F.explode(again)).withColumn("run", run + F.col("after"))
    source, path, state = (fresh_path(spark, f"arrivals-{part}") for part in ("in", "out", "state"))
    schema = "event_id LONG, user_id LONG, event_type STRING, ts TIMESTAMP"
    for name, setting in jobs.ROCKSDB.items():
        spark.conf.set(name, setting)
    for number in range(5):
        rows.where(F.col("run") == number).select("event_id", "user_id", "event_type", "ts").write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        kept = jobs.kept_arrivals(stream, ("user_id", "event_type"), "ts", timedelta(days=3))
        jobs.to_table(kept, path, state).awaitTermination()
    for name, setting in before.items():
        if setting is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, setting)
    out = spark.read.schema(schema).parquet(path)
    return out.select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("kept"))
