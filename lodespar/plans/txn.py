"""Queries of transactions: events as a log of operations on customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodespar.operators import txn
from lodespar.plans.registry import query
from lodespar.sources.catalog import table

# An event's operation, key, value and transaction; keys are spread over half as many again as the table has.
_OPS = """ops AS (SELECT event_id AS seq, CASE CAST(event_id % 4 AS INTEGER) WHEN 0 THEN 'insert' WHEN 1 THEN 'update' WHEN 2 THEN 'upsert' ELSE 'delete' END AS op,
 (event_id * 7919) % (SELECT count(*) * 3 // 2 FROM customer) AS k, value AS v, event_id // 5 AS txn FROM events)"""
_BASE = "base AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer)"
_FOLD = """, m AS (SELECT o.*, b.k IS NOT NULL AS present,
 last_value(CASE WHEN op IN ('insert', 'upsert') THEN TRUE WHEN op = 'delete' THEN FALSE END IGNORE NULLS) OVER (PARTITION BY o.k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was
 FROM kept o LEFT JOIN base b ON b.k = o.k),
s AS (SELECT *, CASE WHEN op = 'insert' AND coalesce(was, present) THEN 'key_exists' WHEN op IN ('update', 'delete') AND NOT coalesce(was, present) THEN 'key_not_found' ELSE 'ok' END AS status FROM m),
net AS (SELECT k, arg_max(op, seq) AS last_op, arg_max(v, seq) AS v FROM s WHERE status = 'ok' GROUP BY k)"""
_AFTER = "SELECT coalesce(b.k, n.k) AS k, CASE WHEN n.k IS NULL THEN b.v ELSE n.v END AS v FROM base b FULL OUTER JOIN net n ON n.k = b.k WHERE coalesce(n.last_op <> 'delete', TRUE)"


def _base(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))


def _ops(spark, sf_dir):
    e, n = F.col("event_id"), table(spark, sf_dir, "customer").count() * 3 // 2
    op = F.element_at(F.array(*map(F.lit, ("insert", "update", "upsert", "delete"))), (e % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(e.alias("seq"), op.alias("op"), (e * 7919 % max(1, n)).alias("k"), F.col("value").alias("v"), F.expr("event_id div 5").alias("txn"))


@query(f"WITH {_BASE}, {_OPS}, kept AS (SELECT * FROM ops){_FOLD} {_AFTER}")
def txn_rwset_fold(spark, sf_dir):
    return txn.fold(_base(spark, sf_dir), _ops(spark, sf_dir), "k")[0]


@query(f"WITH {_BASE}, {_OPS}, kept AS (SELECT * FROM ops){_FOLD} SELECT seq, k, op, status FROM s")
def txn_op_status(spark, sf_dir):
    return txn.fold(_base(spark, sf_dir), _ops(spark, sf_dir), "k")[1]


@query(f"WITH {_BASE}, {_OPS}, kept AS (SELECT * FROM ops){_FOLD} SELECT k, v FROM ({_AFTER}) WHERE k >= 20 AND k < 180")
def txn_scan_read_your_writes(spark, sf_dir):
    """A range scan over the table and the transaction's own pending operations; rows it has deleted are left out."""
    return txn.fold(_base(spark, sf_dir), _ops(spark, sf_dir), "k")[0].where("k >= 20 AND k < 180")


@query(f"WITH {_BASE}, {_OPS}, kept AS (SELECT * FROM ops WHERE txn % 3 <> 0){_FOLD} {_AFTER}")
def txn_abort_noop(spark, sf_dir):
    """Every third transaction aborts: nothing of it remains."""
    ops = _ops(spark, sf_dir)
    return txn.transact(_base(spark, sf_dir), ops, "k", aborted=ops.where("txn % 3 = 0").select("txn").distinct())


@query("""WITH m AS (SELECT (event_id * 7919) % (SELECT count(*) * 3 // 2 FROM customer) AS k, event_id // 5 AS txn, max(CASE WHEN event_id % 4 = 1 THEN 1 ELSE 0 END) AS x FROM events GROUP BY 1, 2),
g AS (SELECT k, count(*) AS n, CAST(sum(x) AS BIGINT) AS x FROM m GROUP BY k)
SELECT k, n AS n_txns, x AS n_exclusive, CAST(n * (n - 1) // 2 - (n - x) * (n - x - 1) // 2 AS BIGINT) AS n_conflicts FROM g WHERE x > 0 AND n > 1""")
def lock_conflicts(spark, sf_dir):
    return txn.lock_conflicts(_ops(spark, sf_dir).withColumn("exclusive", F.col("op") == "update"), "k")


@query("SELECT name, n_rows FROM (SELECT 'customer' AS name, count(*) AS n_rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part)")
def txn_container_stats(spark, sf_dir):
    counted = [table(spark, sf_dir, x).agg(F.lit(x).alias("name"), F.count("*").alias("n_rows")) for x in ("customer", "orders", "part")]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])
