"""Queries of the key-value benchmark: events are its log, users its keys, and customers its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodespar.operators import kv, secondary
from lodespar.plans.registry import query
from lodespar.sources import generators
from lodespar.sources.catalog import table

_LOG = "log AS (SELECT event_id AS seq, (event_id * 48271) % (SELECT count(*) FROM customer) + (SELECT min(c_custkey) FROM customer) AS k, value AS v FROM events)"


def _log(spark, sf_dir):
    size = table(spark, sf_dir, "customer").agg(F.count("*").alias("n"), F.min("c_custkey").alias("least")).first()
    key = F.col("event_id") * 48271 % max(1, size.n) + (size.least or 0)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), key.alias("k"), F.col("value").alias("v"))


@query(f"""WITH {_LOG} SELECT seq, k, 8 + strlen(c_name) AS size FROM log JOIN customer ON c_custkey = k WHERE seq % 2 = 0""")
def ycsb_read(spark, sf_dir):
    """Each read's bytes: an eight-byte key and the value, found through the secondary table."""
    rows = table(spark, sf_dir, "customer")
    second = secondary.derive(rows.select(F.col("c_custkey").alias("k"), "c_custkey"), ["k"], ["c_custkey"])
    found = secondary.lookup(second, rows.select("c_custkey", "c_name"), ["c_custkey"])
    return _log(spark, sf_dir).where("seq % 2 = 0").join(found, "k").select("seq", "k", (F.octet_length("c_name") + 8).cast("long").alias("size"))


@query("SELECT count(*) AS n, bit_xor(c_custkey) AS checksum FROM customer")
def ycsb_secondary_count(spark, sf_dir):
    """Rows that a scan of the whole secondary table reaches in its primary, before the workload runs."""
    rows = table(spark, sf_dir, "customer")
    second = secondary.derive(rows.select(F.col("c_custkey").alias("k"), "c_custkey"), ["k"], ["c_custkey"])
    return secondary.lookup(second, rows.select("c_custkey"), ["c_custkey"]).agg(F.count("*").alias("n"), F.bit_xor("c_custkey").alias("checksum"))


@query(f"WITH {_LOG}, u AS (SELECT k, arg_max(v, seq) AS v FROM log WHERE seq % 2 = 1 GROUP BY k) SELECT c_custkey AS k, CASE WHEN u.k IS NULL THEN c_acctbal ELSE u.v END AS v FROM customer LEFT JOIN u ON u.k = c_custkey")
def ycsb_update_lww(spark, sf_dir):
    """The last writer of a key wins."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return kv.update(rows, _log(spark, sf_dir).where("seq % 2 = 1"), "k", "seq", "v")


@query("""WITH z AS (SELECT sum(pow(1.0 / c_custkey, 0.5)) AS zeta, count(*) AS n, 1.0 + pow(0.5, 0.5) AS two FROM customer WHERE c_custkey > 0),
p AS (SELECT *, 1 / (1 - 0.5) AS alpha, (1 - pow(2.0 / n, 1 - 0.5)) / (1 - two / zeta) AS eta FROM z),
d AS (SELECT event_id, ((event_id * 7919) % 100003) / 100003.0::DOUBLE AS u, p.* FROM events, p)
SELECT event_id, CAST(CASE WHEN u * zeta < 1 THEN 0 WHEN u * zeta < two THEN 1 ELSE least(n - 1, floor(n * pow(eta * u - eta + 1, alpha) + 1e-9)) END AS BIGINT) AS k FROM d""")
def ycsb_zipf(spark, sf_dir):
    """Skewed keys from uniform numbers, by the closed form for a skew of one half; the constants are one row."""
    n = table(spark, sf_dir, "customer").where("c_custkey > 0").agg(F.count("*").alias("n"), F.sum(F.pow(F.lit(1.0) / F.col("c_custkey"), F.lit(0.5))).alias("zeta")).first()
    uniform = (F.col("event_id") * 7919 % 100003) / F.lit(100003.0)
    return table(spark, sf_dir, "events").select("event_id", generators.zipf(uniform, n.n, 0.5, n.zeta).alias("k"))


@query("""WITH o AS (SELECT event_id, (event_id * 7919) % 100 AS u FROM events)
SELECT w AS workload, CASE WHEN u < reads THEN 'read' ELSE 'update' END AS op, count(*) AS n FROM o, (VALUES ('A', 50), ('B', 95), ('C', 100)) m(w, reads) GROUP BY 1, 2""")
def ycsb_mix(spark, sf_dir):
    """Reads and updates that each workload draws: half, one in twenty and no updates."""
    drawn = F.col("event_id") * 7919 % 100
    mix = F.explode(F.array(*(F.struct(F.lit(w).alias("workload"), F.lit(r).alias("reads")) for w, r in (("A", 50), ("B", 95), ("C", 100)))))
    rows = table(spark, sf_dir, "events").select(drawn.alias("u"), mix.alias("m"))
    return rows.groupBy(F.col("m.workload").alias("workload"), generators.choose(F.col("u"), [("read", F.col("m.reads"))], "update").alias("op")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN u < 20 THEN 'insert' WHEN u < 45 THEN 'update' WHEN u < 50 THEN 'delete' ELSE 'get' END AS op, count(*) AS n FROM (SELECT (event_id * 7919) % 100 AS u FROM events) GROUP BY 1""")
def kv_op_mix(spark, sf_dir):
    """A weighted choice of operations."""
    drawn = F.col("event_id") * 7919 % 100
    return table(spark, sf_dir, "events").groupBy(generators.choose(drawn, [("insert", F.lit(20)), ("update", F.lit(45)), ("delete", F.lit(50))], "get").alias("op")).agg(F.count("*").alias("n"))


@query("""SELECT event_type AS kind, count(*) FILTER (value >= 20) AS commits, count(*) FILTER (value < 20) AS aborts,
 CAST(sum(CAST(round(value * 1000) AS BIGINT)) FILTER (value >= 20) AS BIGINT) AS latency FROM events GROUP BY 1""")
def ycsb_stats(spark, sf_dir):
    done = F.col("value") >= 20
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count_if(done).alias("commits"), F.count_if(~done).alias("aborts"), F.sum(F.when(done, F.round(F.col("value") * 1000).cast("long"))).alias("latency"))


@query("SELECT k, lpad(hex((k * 48271) % 1000003), 8, '0') AS v, k // 1000 AS part FROM (SELECT unnest(range(20000)) AS k)")
def ycsb_generate(spark, sf_dir):
    """Sequential keys with values made from them, in ranges of a thousand: the loader's rows."""
    return generators.key_values(spark, 20_000, 1000).select("k", "v", "part")


@query("SELECT count(*) AS n, count(DISTINCT p) AS n_places, min(p) AS least, max(p) AS greatest FROM (SELECT (c_custkey * 48271) % 2147483647 AS p FROM customer)")
def kv_permutation(spark, sf_dir):
    """Keys in an order that a seed decides: each place is taken once."""
    place = F.col("c_custkey") * 48271 % 2147483647
    return table(spark, sf_dir, "customer").select(place.alias("p")).agg(F.count("*").alias("n"), F.countDistinct("p").alias("n_places"), F.min("p").alias("least"), F.max("p").alias("greatest"))
