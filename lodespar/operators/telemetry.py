"""Measures of what a system did: throughput and hit rates by time, latency quantiles and histograms, differences of counters."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def throughput(events: DataFrame, ts: str, every: str, *by: str) -> DataFrame:
    return events.groupBy(F.date_trunc(every, ts).alias("bucket"), *by).agg(F.count("*").alias("n_events"))


def rate(hit: Column) -> Column:
    return F.count_if(hit) / F.count("*")


def latency_quantiles(rows: DataFrame, value: str, by: str, points: dict[str, float], width: float, accuracy: int | None = None) -> DataFrame:
    """For each ``by``: n, least, greatest, mean, deviation (of the population) and the discrete quantiles ``points``.

    Quantiles are exact, in two passes: values are counted in ranges of ``width``, which says in which range each quantile is and
    at which place; only the rows of those ranges are sorted, each range by itself. With ``accuracy`` they're sketches instead. Mean and
    deviation are of whole thousandths, so that the rows' order doesn't matter."""
    ns = F.round(F.col(value) * 1000).cast("long")
    total, squares = F.sum(ns).cast("double"), F.sum(ns.cast("decimal(19,0)") * ns.cast("decimal(19,0)")).cast("double")
    n = F.count("*")
    stats = [n.alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"), (total / n / 1000).alias("mean"), (F.sqrt(F.greatest(squares / n - (total / n) * (total / n), F.lit(0.0))) / 1000).alias("deviation")]
    if accuracy:
        return rows.groupBy(by).agg(*stats, *(F.percentile_approx(value, p, accuracy).alias(k) for k, p in points.items()))
    overall = rows.groupBy(by).agg(*stats)
    ranged = rows.where(F.col(value).isNotNull()).select(by, F.col(value).alias("x"), F.floor(F.col(value) / width).alias("range"))
    counts = ranged.groupBy(by, "range").agg(F.count("*").alias("n"))
    group = Window.partitionBy(by)  # one row a range
    counts = counts.select(by, "range", F.sum("n").over(group.orderBy("range")).alias("upto"), F.sum("n").over(group).alias("of"), "n")
    asked = F.explode(F.array(*(F.struct(F.lit(k).alias("point"), F.greatest(F.ceil(F.col("of") * F.lit(Decimal(str(p)))), F.lit(1)).cast("long").alias("place")) for k, p in points.items())))
    where = counts.select(by, "range", "upto", "n", asked.alias("q")).where("q.place <= upto and q.place > upto - n").select(by, "range", "q.point", (F.col("q.place") - F.col("upto") + F.col("n")).alias("place"))
    some = ranged.join(where.select(by, "range").distinct(), [by, "range"])
    placed = some.withColumn("place", F.row_number().over(Window.partitionBy(by, "range").orderBy("x")).cast("long"))
    found = placed.join(where, [by, "range", "place"]).groupBy(by).agg(*(F.max(F.when(F.col("point") == k, F.col("x"))).alias(k) for k in points))
    return overall.join(found, by, "left")


def histogram(rows: DataFrame, value: Column, step: int, cap: int) -> DataFrame:
    """Counts in buckets of ``step`` up to ``cap``; what is higher goes to the bucket ``cap``."""
    return rows.groupBy(F.least((F.floor(value / step) * step).cast("long"), F.lit(cap).cast("long")).alias("bucket")).agg(F.count("*").alias("n"))


def counter_diff(now: DataFrame, before: DataFrame, key: str, *counters: str) -> DataFrame:
    """Counters of each key less what they were; a key without a former value counts from zero."""
    old = before.select(key, *(F.col(x).alias(f"old_{x}") for x in counters))
    return now.join(old, key, "left").select(key, *((F.col(x) - F.coalesce(F.col(f"old_{x}"), F.lit(0))).alias(x) for x in counters))


def counter_steps(samples: DataFrame, by: str, order: str, *counters: str) -> DataFrame:
    """Each sample's counters less those of the sample before."""
    w = Window.partitionBy(by).orderBy(order)
    return samples.select(by, order, *((F.col(x) - F.coalesce(F.lag(x).over(w), F.lit(0))).alias(x) for x in counters))
