"""Batch twins of the streaming queries, which the tests hold the streams against. They go beyond the reference's own operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodespar.plans.registry import query
from lodespar.sources.catalog import table


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, s""")
def stream_session(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = events.groupBy(F.session_window("ts", "1 hour").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def stream_stateful_counter(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT event_id, min(ts) AS ts FROM events GROUP BY 1")
def stream_dedup(spark, sf_dir):
    first = Window.partitionBy("event_id").orderBy("ts")
    return table(spark, sf_dir, "events").select("event_id", "ts").withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
