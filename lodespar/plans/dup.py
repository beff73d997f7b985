"""Queries of repeating keys, heaps and hash tables: line items by order and line number."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodespar.operators import dup
from lodespar.plans.registry import query
from lodespar.sources.catalog import table

_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_BY = ", ".join(_ORDER)
_SUFFIX = f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_BY}) - 1 AS suffix FROM lineitem"


def _lines(spark, sf_dir):
    numbered = dup.append_suffix(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", order=_ORDER)
    return numbered.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("suffix").cast("long").alias("suffix"))


@query(_SUFFIX)
def dup_append_suffix(spark, sf_dir):
    return _lines(spark, sf_dir)


@query(f"SELECT * FROM ({_SUFFIX}) WHERE l_orderkey = 77")
def dup_scan_key(spark, sf_dir):
    return dup.scan_key(_lines(spark, sf_dir), "l_orderkey", 77)


@query(f"SELECT * FROM ({_SUFFIX}) WHERE l_orderkey BETWEEN 100 AND 900")
def dup_scan_range_inclusive(spark, sf_dir):
    return dup.scan_range(_lines(spark, sf_dir), "l_orderkey", 100, 900)


@query(f"SELECT * FROM ({_SUFFIX}) WHERE l_orderkey >= 100 AND l_orderkey < 900")
def dup_cursor_range(spark, sf_dir):
    return dup.cursor_range(_lines(spark, sf_dir), "l_orderkey", 100, 900)


@query("SELECT l_orderkey, l_partkey FROM lineitem UNION ALL SELECT o_orderkey, NULL FROM orders")
def heap_append_scan(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return dup.append(lines, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(None).cast("long").alias("l_partkey")))


@query("SELECT count(*) AS n, count(DISTINCT l_orderkey) AS n_keys, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem")
def heap_count(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("n_keys"), F.sum("l_linenumber").alias("lines"))


@query("""SELECT CAST((l_partkey * 2654435761 + 12345) % 64 AS INTEGER) AS bucket, count(*) AS n_rows, count(DISTINCT l_partkey) AS n_keys FROM lineitem GROUP BY 1""")
def hash_bucket_stats(spark, sf_dir):
    return dup.bucket_stats(table(spark, sf_dir, "lineitem"), "l_partkey", 64)


@query("SELECT p_partkey, p_name, CAST((p_partkey * 2654435761 + 12345) % 64 AS INTEGER) AS bucket FROM part ORDER BY p_partkey")
def hash_scan_ordered(spark, sf_dir):
    """Global key order over all buckets."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", dup.bucket_of(F.col("p_partkey"), 64).alias("bucket")).orderBy("p_partkey")


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_partkey >= 50 AND p_partkey < 1500 AND p_size % 2 = 0")
def hash_scan_range_filter(spark, sf_dir):
    """A range of a hash table: no order is asked for, so nothing is shuffled."""
    return table(spark, sf_dir, "part").where("p_partkey >= 50 AND p_partkey < 1500 AND p_size % 2 = 0").select("p_partkey", "p_retailprice")


@query("""WITH b AS (SELECT CAST((l_partkey * 2654435761 + 12345) % 64 AS INTEGER) AS bucket, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1)
SELECT CAST(floor(n / 8) * 8 AS BIGINT) AS keys_from, count(*) AS n_buckets, CAST(sum(n) AS BIGINT) AS n_keys FROM b GROUP BY 1""")
def hash_bucket_sizes(spark, sf_dir):
    """How evenly buckets are filled: how many of them have so many keys, in steps of eight."""
    by = dup.bucket_stats(table(spark, sf_dir, "lineitem"), "l_partkey", 64)
    return by.groupBy((F.floor(F.col("n_keys") / 8) * 8).alias("keys_from")).agg(F.count("*").alias("n_buckets"), F.sum("n_keys").alias("n_keys"))
