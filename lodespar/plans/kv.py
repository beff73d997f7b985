"""Queries of the ordered, unique index: the customer, part and orders tables as key-value tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodespar.functions.keys import big_endian, half_open
from lodespar.operators import kv
from lodespar.plans.registry import query
from lodespar.sources.catalog import table


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))


def _batch(spark, sf_dir):
    """Orders as operations: every second key is beyond the customers."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") * 2).alias("k"), F.col("o_totalprice").alias("v"))


_BASE = "base AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer)"
_OPS = "ops AS (SELECT o_orderkey AS seq, o_custkey * 2 AS k, o_totalprice AS v FROM orders)"
_LAST = "last AS (SELECT k, arg_max(v, seq) AS v FROM ops GROUP BY k)"


@query("""SELECT s_suppkey * 7 AS k, c.c_name AS name, CASE WHEN c.c_custkey IS NULL THEN 'key_not_found' ELSE 'ok' END AS status
FROM supplier LEFT JOIN customer c ON c.c_custkey = s_suppkey * 7""")
def kv_point_get(spark, sf_dir):
    keys = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 7).alias("k"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return kv.get(rows, keys, "k")


@query(f"""WITH {_BASE}, {_OPS}, r AS (SELECT seq, k, row_number() OVER (PARTITION BY k ORDER BY seq) AS n FROM ops)
SELECT r.seq, r.k, CASE WHEN b.k IS NULL AND n = 1 THEN 'ok' ELSE 'key_exists' END AS status FROM r LEFT JOIN base b ON b.k = r.k""")
def kv_insert_status(spark, sf_dir):
    return kv.insert(_customers(spark, sf_dir), _batch(spark, sf_dir), "k", "seq")[1]


@query(f"""WITH {_BASE}, {_OPS}, f AS (SELECT k, arg_min(v, seq) AS v FROM ops GROUP BY k)
SELECT k, v FROM base UNION ALL SELECT k, v FROM f WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.k = f.k)""")
def kv_insert(spark, sf_dir):
    return kv.insert(_customers(spark, sf_dir), _batch(spark, sf_dir), "k", "seq")[0]


@query(f"WITH {_BASE}, {_OPS}, {_LAST} SELECT b.k, CASE WHEN l.k IS NULL THEN b.v ELSE l.v END AS v FROM base b LEFT JOIN last l ON l.k = b.k")
def kv_update(spark, sf_dir):
    return kv.update(_customers(spark, sf_dir), _batch(spark, sf_dir), "k", "seq", "v")


@query(f"WITH {_BASE}, {_OPS} SELECT seq, o.k, CASE WHEN b.k IS NULL THEN 'key_not_found' ELSE 'ok' END AS status FROM ops o LEFT JOIN base b ON b.k = o.k")
def kv_update_status(spark, sf_dir):
    return kv.update_status(_customers(spark, sf_dir), _batch(spark, sf_dir), "k", "seq")


@query(f"WITH {_BASE} SELECT k, v FROM base WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F' AND o_custkey = k)")
def kv_delete(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    return kv.delete(_customers(spark, sf_dir), keys, "k")


@query(f"WITH {_BASE}, {_OPS}, {_LAST} SELECT coalesce(b.k, l.k) AS k, CASE WHEN l.k IS NULL THEN b.v ELSE l.v END AS v FROM base b FULL OUTER JOIN last l ON l.k = b.k")
def kv_upsert(spark, sf_dir):
    return kv.upsert(_customers(spark, sf_dir), _batch(spark, sf_dir), "k", "seq", "v")


@query(f"""WITH {_BASE}, {_OPS}, {_LAST} SELECT coalesce(b.k, l.k) AS k, CASE WHEN l.k IS NULL THEN b.v ELSE l.v END AS v,
CASE WHEN l.k IS NULL THEN NULL ELSE b.v END AS old_v FROM base b FULL OUTER JOIN last l ON l.k = b.k""")
def kv_upsert_returning_old(spark, sf_dir):
    return kv.upsert(_customers(spark, sf_dir), _batch(spark, sf_dir), "k", "seq", "v", old="old_v")


@query("""WITH n AS (SELECT o_custkey * 2 AS k, count(*) AS q FROM orders GROUP BY 1)
SELECT coalesce(c_custkey, k) AS k, CAST(coalesce(c_nationkey, 0) + coalesce(q, 0) AS BIGINT) AS v FROM customer FULL OUTER JOIN n ON k = c_custkey""")
def kv_upsert_merge(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("v"))
    ones = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("k"), F.lit(1).cast("long").alias("v"))
    return kv.upsert_merge(base, ones, "k", "v", F.sum, lambda a, b: a + b)


@query("""WITH o AS (SELECT o_custkey AS k, string_agg(o_orderpriority, '' ORDER BY o_orderkey) AS v FROM orders GROUP BY 1)
SELECT c_custkey AS k, c_mktsegment || coalesce(v, '') AS v FROM customer LEFT JOIN o ON k = c_custkey""")
def kv_upsert_fold(spark, sf_dir):
    """A merge that isn't commutative: texts are appended in the order of the operations."""
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    ops = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"))
    return kv.upsert_fold(base, ops, "k", "seq", "v", F.concat)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey")
def kv_scan_ordered(spark, sf_dir):
    return kv.scan(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"])


@query("SELECT doc_id, strlen(text) AS size FROM documents WHERE strlen(text) % 2 = 0 AND doc_id % 2 = 0 ORDER BY doc_id")
def kv_scan_filter(spark, sf_dir):
    """A predicate on key and value: even keys whose value has an even number of bytes."""
    size = F.octet_length("text")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return kv.scan(rows, ["doc_id"], (size % 2 == 0) & (F.col("doc_id") % 2 == 0)).select("doc_id", size.cast("long").alias("size"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 9000 ORDER BY o_orderkey")
def kv_scan_range(spark, sf_dir):
    return kv.scan(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], low=1000, high=9000)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 9000 AND o_orderstatus = 'O' ORDER BY o_orderkey")
def kv_scan_range_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return kv.scan(rows, ["o_orderkey"], F.col("o_orderstatus") == "O", 1000, 9000).drop("o_orderstatus")


@query("SELECT c_nationkey, c_name, c_custkey FROM customer WHERE (c_nationkey, c_name) > (3, 'Customer#000000050') ORDER BY c_nationkey, c_name LIMIT 100")
def kv_cursor_page(spark, sf_dir):
    """The hundred rows after a key of two columns: a page is what a cursor returns."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_name", "c_custkey")
    return kv.page(rows, ["c_nationkey", "c_name"], 100, (3, "Customer#000000050"))


@query("WITH p AS (SELECT DISTINCT s_suppkey * 47 AS x FROM supplier) SELECT x, (SELECT min(c_custkey * 3) FROM customer WHERE c_custkey * 3 >= x) AS bound FROM p")
def kv_lower_bound(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 3).alias("k"))
    return kv.bound(rows, table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 47).alias("x")), "k", "x", strict=False)


@query("WITH p AS (SELECT DISTINCT s_suppkey * 47 AS x FROM supplier) SELECT x, (SELECT min(c_custkey * 3) FROM customer WHERE c_custkey * 3 > x) AS bound FROM p")
def kv_upper_bound(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 3).alias("k"))
    return kv.bound(rows, table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 47).alias("x")), "k", "x", strict=True)


@query("""SELECT o_orderkey, lpad(hex(o_orderkey), 16, '0') AS packed FROM orders
WHERE lpad(hex(o_orderkey), 16, '0') >= '0000000000000100' AND lpad(hex(o_orderkey), 16, '0') < '0000000000000200'""")
def kv_binary_range(spark, sf_dir):
    """A half-open range of big-endian keys, compared as bytes."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", big_endian(F.col("o_orderkey")).alias("b"))
    return rows.where(half_open(F.col("b"), F.unhex(F.lit("0000000000000100")), F.unhex(F.lit("0000000000000200")))).select("o_orderkey", F.hex("b").alias("packed"))


@query("""WITH c AS (SELECT o_custkey, o_orderkey AS k, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_totalprice, o_orderkey) AS p FROM orders)
SELECT o_custkey, count(*) AS n_rows, count(*) FILTER (p > k) AS n_below, count(*) FILTER (p = k) AS n_repeats FROM c GROUP BY 1""")
def kv_bulk_load_check(spark, sf_dir):
    """Whether each customer's orders, as they came in, could be loaded as a stream sorted by their number."""
    return kv.order_faults(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), "o_orderkey", by="o_custkey", order=["o_orderdate", "o_totalprice", "o_orderkey"])


@query("""WITH c AS (SELECT l_partkey AS k, lag(l_partkey) OVER (ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey) AS p FROM lineitem)
SELECT count(*) AS n_rows, count(*) FILTER (p > k) AS n_below, count(*) FILTER (p = k) AS n_repeats FROM c""")
def kv_bulk_stream_check(spark, sf_dir):
    """Whether all lines, in the order of their orders, could be loaded as one stream sorted by their item."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return kv.stream_faults(lines, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"])


@query("""SELECT (SELECT count(*) - count(DISTINCT o_orderkey) FROM orders) AS n_repeats, (SELECT count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)) AS n_dangling,
(SELECT count(*) FROM orders WHERE o_orderkey IS NULL) AS n_null""")
def kv_consistency(spark, sf_dir):
    """Keys of orders that repeat, customers that orders name and that don't exist, and keys that are null."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    repeats = orders.groupBy("o_orderkey").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - F.when(F.col("o_orderkey").isNull(), 0).otherwise(1)), F.lit(0)).alias("n_repeats"), F.coalesce(F.sum(F.when(F.col("o_orderkey").isNull(), F.col("n"))), F.lit(0)).alias("n_null"))
    there = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    dangling = orders.join(there, "o_custkey", "left_anti").agg(F.count("*").alias("n_dangling"))
    return repeats.select("n_repeats", "n_null", F.lit(1).alias("one")).join(dangling.withColumn("one", F.lit(1)), "one").drop("one")


@query("""WITH r AS (SELECT floor(o_orderkey / 1000) AS g, count(*) AS n, CAST(sum(strlen(o_orderpriority) + 8) AS BIGINT) AS used FROM orders GROUP BY 1)
SELECT count(*) AS n_ranges, CAST(sum(n) AS BIGINT) AS n_rows, min(n) AS min_rows, max(n) AS max_rows, min(used) AS min_bytes, max(used) AS max_bytes, CAST(sum(used) AS DOUBLE) / count(*) AS mean_bytes FROM r""")
def kv_range_stats(spark, sf_dir):
    """How evenly ranges of a thousand keys are filled: what range-partitioned files of them would hold."""
    return kv.range_stats(table(spark, sf_dir, "orders"), "o_orderkey", F.octet_length("o_orderpriority") + 8, 1000)


@query("""SELECT c_custkey AS k, CASE WHEN strlen(o.o_orderpriority) = strlen(c_mktsegment) THEN o.o_orderpriority ELSE c_mktsegment END AS v
FROM customer LEFT JOIN orders o ON o.o_orderkey = c_custkey""")
def kv_opportunistic_update(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    new = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("v"))
    return kv.rewrite_same_length(rows, new, "k", "v")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT (o_orderstatus = 'P')")
def kv_ghost_scan(spark, sf_dir):
    """Rows that are inserted but not yet visible carry a flag; scans leave them out."""
    rows = table(spark, sf_dir, "orders").withColumn("ghost", F.col("o_orderstatus") == "P")
    return rows.where(~F.col("ghost")).select("o_orderkey", "o_totalprice")


@query(f"""WITH {_BASE}, {_OPS}, r AS (SELECT seq, k, row_number() OVER (PARTITION BY k ORDER BY seq) AS n FROM ops),
s AS (SELECT 'insert' AS op, CASE WHEN b.k IS NULL AND n = 1 THEN 'ok' ELSE 'key_exists' END AS status FROM r LEFT JOIN base b ON b.k = r.k
UNION ALL SELECT 'update', CASE WHEN b.k IS NULL THEN 'key_not_found' ELSE 'ok' END FROM ops o LEFT JOIN base b ON b.k = o.k)
SELECT op, status, count(*) AS n FROM s GROUP BY op, status""")
def kv_op_stats(spark, sf_dir):
    rows, batch = _customers(spark, sf_dir), _batch(spark, sf_dir)
    done = kv.insert(rows, batch, "k", "seq")[1].select(F.lit("insert").alias("op"), "status").unionByName(kv.update_status(rows, batch, "k", "seq").select(F.lit("update").alias("op"), "status"))
    return done.groupBy("op", "status").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING') GROUP BY 1")
def semi_exists(spark, sf_dir):
    """Whether a key has a value, without reading it."""
    some = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(some, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count("*").alias("n"))
