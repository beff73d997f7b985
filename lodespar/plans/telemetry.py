"""Queries of telemetry: the events table as samples of what a system did."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodespar.operators import telemetry
from lodespar.plans.registry import query
from lodespar.sources.catalog import table

POINTS = {"p1": 0.01, "p5": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999, "p9999": 0.9999}


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("SELECT date_trunc('day', ts) AS bucket, event_type, count(*) AS n_events FROM events GROUP BY 1, 2")
def ev_throughput_window(spark, sf_dir):
    return telemetry.throughput(_events(spark, sf_dir), "ts", "day", "event_type").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("SELECT date_trunc('hour', ts) AS bucket, user_id % 11 AS container, CASE WHEN event_id % 3 = 0 THEN 'W' ELSE 'R' END AS op, count(*) AS n_events FROM events GROUP BY 1, 2, 3")
def ev_io_window(spark, sf_dir):
    """Page reads and writes of each container by hour."""
    rows = _events(spark, sf_dir).select("ts", (F.col("user_id") % 11).alias("container"), F.when(F.col("event_id") % 3 == 0, "W").otherwise("R").alias("op"))
    return telemetry.throughput(rows, "ts", "hour", "container", "op").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 3 = 0) / CAST(count(*) AS DOUBLE) AS hit_rate, count(*) FILTER (event_id % 3 = 1) / CAST(count(*) AS DOUBLE) AS page_miss_rate,
 count(*) FILTER (event_id % 3 = 2) / CAST(count(*) AS DOUBLE) AS frame_miss_rate FROM events WHERE value < 10000 GROUP BY 1""")
def ev_hit_rate_window(spark, sf_dir):
    """Shares of hint hits, page misses and frame misses; samples of ten thousand and more are dropped, as the tracer does."""
    kind = F.col("event_id") % 3
    rows = _events(spark, sf_dir).where("value < 10000")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), telemetry.rate(kind == 0).alias("hit_rate"), telemetry.rate(kind == 1).alias("page_miss_rate"), telemetry.rate(kind == 2).alias("frame_miss_rate"))


@query("SELECT event_id, event_type, ts FROM events WHERE (event_id * 7919) % 100 = 0")
def ev_sample(spark, sf_dir):
    """One sample in a hundred, by the event's number: sampling is what the tracer does."""
    return _events(spark, sf_dir).where("event_id * 7919 % 100 = 0").select("event_id", "event_type", "ts")


_NS = "CAST(round(value * 1000) AS BIGINT)"
_POINTS = ", ".join(f"quantile_disc(value, {p}) AS {k}" for k, p in POINTS.items())


@query(f"""WITH s AS (SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS greatest, CAST(sum({_NS}) AS DOUBLE) AS t, CAST(sum(CAST({_NS} AS HUGEINT) * {_NS}) AS DOUBLE) AS q, {_POINTS} FROM events GROUP BY 1)
SELECT event_type, n, least, greatest, t / n / 1000 AS mean, sqrt(greatest(q / n - (t / n) * (t / n), 0)) / 1000 AS deviation, {", ".join(POINTS)} FROM s""")
def lat_percentiles(spark, sf_dir):
    """Latencies of each kind: mean, deviation and exact quantiles from the first to the 99.99th hundredth."""
    return telemetry.latency_quantiles(_events(spark, sf_dir), "value", "event_type", POINTS, width=1.0)


@query()
def lat_percentiles_approx(spark, sf_dir):
    """The same by a sketch of bounded size, in one pass."""
    return telemetry.latency_quantiles(_events(spark, sf_dir), "value", "event_type", POINTS, width=1.0, accuracy=10_000)


@query("SELECT least(CAST(floor(value / 25) * 25 AS BIGINT), 150) AS bucket, count(*) AS n FROM events GROUP BY 1")
def lat_histogram(spark, sf_dir):
    return telemetry.histogram(_events(spark, sf_dir), F.col("value"), 25, 150)


@query("SELECT event_type, round(avg(CAST(round(value * 1000) AS BIGINT)), 3) AS mean FROM events WHERE event_id >= 100 GROUP BY 1")
def lat_mean_after_warmup(spark, sf_dir):
    """The mean without the first hundred samples."""
    ns = F.round(F.col("value") * 1000).cast("long")
    return _events(spark, sf_dir).where("event_id >= 100").groupBy("event_type").agg(F.round(F.avg(ns), 3).alias("mean"))


_COUNTS = "SELECT user_id % 11 AS container, count(*) FILTER (event_id % 3 = 0) AS writes, count(*) FILTER (event_id % 3 <> 0) AS reads FROM events WHERE {0} GROUP BY 1"


@query(f"WITH a AS ({_COUNTS.format('TRUE')}), b AS ({_COUNTS.format('event_id < 5000 AND user_id % 11 <> 4')}) SELECT a.container, a.writes - coalesce(b.writes, 0) AS writes, a.reads - coalesce(b.reads, 0) AS reads FROM a LEFT JOIN b ON a.container = b.container")
def stats_diff(spark, sf_dir):
    """What each container did since a former snapshot; one that is missing there counts from zero."""
    rows = _events(spark, sf_dir).withColumn("container", F.col("user_id") % 11)
    count = lambda df: df.groupBy("container").agg(F.count_if(F.col("event_id") % 3 == 0).alias("writes"), F.count_if(F.col("event_id") % 3 != 0).alias("reads"))
    return telemetry.counter_diff(count(rows), count(rows.where("event_id < 5000 AND container <> 4")), "container", "writes", "reads")


@query("""WITH s AS (SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), c AS (SELECT event_type, day, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day) AS BIGINT) AS total FROM s)
SELECT event_type, day, total - coalesce(lag(total) OVER (PARTITION BY event_type ORDER BY day), 0) AS total FROM c""")
def stats_steps(spark, sf_dir):
    """Steps of a running counter, from each of its samples to the next."""
    from pyspark.sql import Window

    by = _events(spark, sf_dir).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    running = by.withColumn("total", F.sum("n").over(Window.partitionBy("event_type").orderBy("day"))).drop("n")
    return telemetry.counter_steps(running, "event_type", "day", "total")


@query("SELECT user_id % 11 AS container, CAST(sum(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS buffered_reads, CAST(sum(CASE WHEN event_id % 4 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS direct_reads, count(*) AS n FROM events GROUP BY 1")
def file_stats(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("container", F.col("user_id") % 11)
    return rows.groupBy("container").agg(F.count_if(F.col("event_id") % 4 == 0).alias("buffered_reads"), F.count_if(F.col("event_id") % 4 == 1).alias("direct_reads"), F.count("*").alias("n"))
