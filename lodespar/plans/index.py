"""Queries of secondary tables: lookups through them, and what becomes of one that isn't kept up to date.

The primary is ``orders`` after a batch of changes: of ten orders by key, those ending in 3 have moved to the next customer, and
those ending in 7 are deleted; the secondary (customer, order) was stored before it, when orders ending in 5 weren't there yet."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodespar.operators import secondary
from lodespar.plans.registry import query
from lodespar.sources.catalog import table

_STATES = """p AS (SELECT o_orderkey, o_custkey + CASE WHEN o_orderkey % 10 = 3 THEN 1 ELSE 0 END AS o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 7),
s AS (SELECT o_orderkey, o_custkey AS stored FROM orders WHERE o_orderkey % 10 <> 5),
v AS (SELECT coalesce(p.o_orderkey, s.o_orderkey) AS o_orderkey, p.o_custkey, s.stored, p.o_orderstatus,
 CASE WHEN p.o_orderkey IS NULL THEN 'dangling' WHEN s.o_orderkey IS NULL THEN 'missing' WHEN p.o_custkey = s.stored THEN 'ok' ELSE 'stale' END AS state
 FROM p FULL OUTER JOIN s ON p.o_orderkey = s.o_orderkey)"""


def _now(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").where("o_orderkey % 10 <> 7")
    return rows.withColumn("o_custkey", F.col("o_custkey") + F.when(F.col("o_orderkey") % 10 == 3, 1).otherwise(0))


def _stored(spark, sf_dir):
    return secondary.derive(table(spark, sf_dir, "orders").where("o_orderkey % 10 <> 5"), ["o_custkey"], ["o_orderkey"])


def _checked(spark, sf_dir):
    return secondary.verify(_stored(spark, sf_dir), _now(spark, sf_dir), "o_custkey", "o_orderkey")


@query("SELECT s.o_custkey, p.o_orderkey, p.o_totalprice FROM (SELECT o_custkey, o_orderkey FROM orders) s JOIN orders p ON p.o_orderkey = s.o_orderkey")
def sec_index_join(spark, sf_dir):
    """Every secondary row with its primary row."""
    orders = table(spark, sf_dir, "orders")
    second = secondary.derive(orders, ["o_custkey"], ["o_orderkey"])
    return secondary.lookup(second, orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(f"""WITH {_STATES} SELECT bit_xor(o_orderkey) AS checksum, count(*) AS n_rows, count(*) FILTER (state <> 'ok') AS n_repaired FROM v WHERE state <> 'dangling'""")
def idx_scan_checksum(spark, sf_dir):
    """A scan of the primary through the repaired secondary: a checksum of what it reaches, and how many entries had to be repaired."""
    fixed = secondary.repair(_checked(spark, sf_dir), "o_custkey", "o_orderkey")
    found = secondary.lookup(fixed, _now(spark, sf_dir).select("o_orderkey"), ["o_orderkey"])
    return found.agg(F.bit_xor("o_orderkey").alias("checksum"), F.count("*").alias("n_rows"), F.count_if("repaired").alias("n_repaired"))


@query(f"""WITH {_STATES} SELECT o_orderstatus, count(*) AS n_rows, count(*) FILTER (state = 'ok') / CAST(count(*) AS DOUBLE) AS ok_share FROM v WHERE state <> 'dangling' GROUP BY 1""")
def idx_hint_correctness(spark, sf_dir):
    """Of the primary's rows, by status, the share that the stored secondary leads to under their present key."""
    status = _now(spark, sf_dir).select("o_orderkey", "o_orderstatus")
    rows = _checked(spark, sf_dir).join(status, "o_orderkey")
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"), (F.count_if(F.col("state") == "ok") / F.count("*")).alias("ok_share"))


@query(f"WITH {_STATES} SELECT state, count(*) AS n FROM v GROUP BY 1")
def idx_stale_inject(spark, sf_dir):
    """How many entries the batch has left in each state."""
    return _checked(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


@query(f"""WITH {_STATES}, a AS (SELECT *, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS asked FROM v), f AS (SELECT policy, state,
 state <> 'ok' AND (policy = 'always' OR (policy = 'on_lookup' AND asked)) AS fix FROM a, (VALUES ('always'), ('on_lookup'), ('never')) t(policy))
SELECT policy, count(*) FILTER (fix) AS n_repaired, count(*) FILTER (state <> 'ok' AND NOT fix) AS n_wrong FROM f GROUP BY policy""")
def idx_repair_policy(spark, sf_dir):
    """Entries repaired, and still wrong, if all are repaired, those that a batch of lookups asks for, or none: in one pass."""
    asked = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("asked", F.lit(True))
    rows = _checked(spark, sf_dir).where("state <> 'ok'").join(asked, "o_orderkey", "left").agg(F.count("*").alias("n"), F.count("asked").alias("seen"))
    each = F.array(*(F.struct(F.lit(p).alias("policy"), fixed.alias("n_repaired"), (F.col("n") - fixed).alias("n_wrong")) for p, fixed in (("always", F.col("n")), ("on_lookup", F.col("seen")), ("never", F.lit(0).cast("long")))))
    return rows.select(F.inline(each))


_SNAP = {
    "insert": ("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0", "SELECT o_orderkey, o_custkey FROM orders"),
    "update": ("SELECT o_orderkey, o_custkey FROM orders", "SELECT o_orderkey, o_custkey + CASE WHEN o_orderkey % 10 = 3 THEN 1 ELSE 0 END AS o_custkey FROM orders"),
    "delete": ("SELECT o_orderkey, o_custkey FROM orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 10 = 7"),
}
_DIFF = """SELECT CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_custkey = b.o_custkey THEN 'kept' ELSE 'changed' END AS change, count(*) AS n_rows
FROM ({0}) a FULL OUTER JOIN ({1}) b ON a.o_orderkey = b.o_orderkey GROUP BY 1"""


def _diff(spark, sf_dir, kind):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    before = orders.where("o_orderkey % 2 = 0") if kind == "insert" else orders
    after = {"insert": orders, "update": orders.withColumn("o_custkey", F.col("o_custkey") + F.when(F.col("o_orderkey") % 10 == 3, 1).otherwise(0)), "delete": orders.where("o_orderkey % 10 = 7")}[kind]
    return secondary.snapshot_diff(before, after, "o_orderkey", "o_custkey")


@query(_DIFF.format(*_SNAP["insert"]))
def idx_snapshot_insert(spark, sf_dir):
    """Two snapshots of (order, customer), before and after as many rows again are inserted."""
    return _diff(spark, sf_dir, "insert")


@query(_DIFF.format(*_SNAP["update"]))
def idx_snapshot_update(spark, sf_dir):
    """The same when a tenth of the orders change customers."""
    return _diff(spark, sf_dir, "update")


@query(_DIFF.format(*_SNAP["delete"]))
def idx_snapshot_delete(spark, sf_dir):
    """The same when nine tenths of the rows are deleted."""
    return _diff(spark, sf_dir, "delete")


@query("""SELECT layout, CAST(sum(16 + CASE layout WHEN 'keys' THEN 0 WHEN 'keys_price' THEN 8 ELSE 8 + strlen(o_orderpriority) END) AS BIGINT) AS bytes, count(*) AS n
FROM orders, (VALUES ('keys'), ('keys_price'), ('covering')) v(layout) GROUP BY layout""")
def idx_size(spark, sf_dir):
    """Bytes, before encoding, of a secondary table of two eight-byte keys alone, with the price, and with all that a lookup returns."""
    rows = table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.sum(F.octet_length("o_orderpriority")).alias("text"))
    each = (("keys", F.col("n") * 16), ("keys_price", F.col("n") * 24), ("covering", F.col("n") * 24 + F.col("text")))
    return rows.select(F.inline(F.array(*(F.struct(F.lit(x).alias("layout"), size.alias("bytes"), F.col("n").alias("n")) for x, size in each))))


@query("SELECT o_custkey, count(*) AS n FROM (SELECT o_custkey, o_orderkey FROM orders) s JOIN orders p USING (o_orderkey, o_custkey) GROUP BY 1")
def sec_index_count(spark, sf_dir):
    """Rows that a scan of the secondary reaches, for each of its keys."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return secondary.lookup(secondary.derive(orders, ["o_custkey"], ["o_orderkey"]), orders.select("o_orderkey"), ["o_orderkey"]).groupBy("o_custkey").agg(F.count("*").alias("n"))
