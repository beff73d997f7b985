"""Queries of the order-entry workload on the test tables.

A nation stands for a district and a region for a warehouse; a customer belongs to its nation, an order to its customer's;
orders with status O aren't delivered; a part is an item, with ``p_size`` as the quantity in stock and ``p_retailprice`` as
its price. Sums of money are taken as decimals, so that the rows' order doesn't matter."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodespar.functions import keys
from lodespar.operators import dup, kv, secondary
from lodespar.plans.registry import query
from lodespar.sources.catalog import table

_MONEY = "CAST(sum(CAST({0} AS DECIMAL(18,2))) AS DOUBLE)"


def district_orders(spark, sf_dir):
    """Orders with their district."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("d_id"))
    return table(spark, sf_dir, "orders").join(customers, "o_custkey")


@query("""WITH n AS (SELECT max(o_orderkey) + 1 AS next FROM orders)
SELECT count(DISTINCT l_partkey) AS low_stock FROM lineitem JOIN part ON l_partkey = p_partkey, n
WHERE l_orderkey >= next - 20 AND l_orderkey < next AND p_size < 15""")
def tpcc_stock_level(spark, sf_dir):
    """Items of the last twenty orders whose stock is below the threshold. The next order's number is one row, looked up first."""
    next_id = table(spark, sf_dir, "orders").agg(F.max("o_orderkey") + 1).first()[0] or 0
    recent = table(spark, sf_dir, "lineitem").where(keys.half_open(F.col("l_orderkey"), next_id - 20, next_id)).select("l_partkey").distinct()
    stock = table(spark, sf_dir, "part").where("p_size < 15").select(F.col("p_partkey").alias("l_partkey"))
    return recent.join(stock, "l_partkey").agg(F.count("*").alias("low_stock"))


@query("""WITH o AS (SELECT o_orderkey, c_nationkey AS d_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey DESC) AS r FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT d_id, count(DISTINCT CASE WHEN p_size < 15 THEN l_partkey END) AS low_stock FROM o JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE r <= 20 GROUP BY d_id""")
def tpcc_stock_level_districts(spark, sf_dir):
    """The same for the last twenty orders of every district; a task keeps twenty of a district before the shuffle."""
    last = Window.partitionBy("d_id").orderBy(F.desc("o_orderkey"))
    recent = district_orders(spark, sf_dir).select("d_id", "o_orderkey").withColumn("r", F.row_number().over(last)).where("r <= 20")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    items = recent.join(lines, "o_orderkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    return items.groupBy("d_id").agg(F.countDistinct(F.when(F.col("p_size") < 15, F.col("p_partkey"))).alias("low_stock"))


_SYL = "[" + ", ".join(f"'{x}'" for x in keys.SYLLABLES) + "]"


def name_sql(n: str) -> str:
    """SQL of the last name of a number."""
    return f"{_SYL}[CAST({n} // 100 % 10 AS INTEGER) + 1] || {_SYL}[CAST({n} // 10 % 10 AS INTEGER) + 1] || {_SYL}[CAST({n} % 10 AS INTEGER) + 1]"


NAMED_SQL = f"named AS (SELECT c_nationkey AS d_id, {name_sql('(c_custkey % 40)')} AS c_last, c_name AS c_first, c_custkey FROM customer)"
BY_NAME_SQL = """by_name AS (SELECT d_id, c_last, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY d_id, c_last ORDER BY c_first, c_custkey) AS r, count(*) OVER (PARTITION BY d_id, c_last) AS n FROM named) WHERE r = CAST(ceil(n / 2.0) AS BIGINT))"""


def named_customers(spark, sf_dir):
    """Customers with their district and last name, one of forty; what they're called stands for the first name."""
    rows = table(spark, sf_dir, "customer")
    return rows.select(F.col("c_nationkey").alias("d_id"), keys.last_name(F.col("c_custkey") % 40).alias("c_last"), F.col("c_name").alias("c_first"), "c_custkey")


@query(f"""WITH {NAMED_SQL}, {BY_NAME_SQL}, ask AS (SELECT s_suppkey, s_nationkey AS d_id, {name_sql('(s_suppkey * 7 % 40)')} AS c_last FROM supplier)
SELECT s_suppkey, ask.d_id, ask.c_last, c_custkey, CASE WHEN c_custkey IS NULL THEN 'key_not_found' ELSE 'ok' END AS status FROM ask LEFT JOIN by_name USING (d_id, c_last)""")
def tpcc_customer_by_name(spark, sf_dir):
    """A lookup through the secondary table: all customers of a district with the last name asked for, and the middle one by first name."""
    asked = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("d_id"), keys.last_name(F.col("s_suppkey") * 7 % 40).alias("c_last"))
    found = secondary.lookup_middle(asked, named_customers(spark, sf_dir), ["d_id", "c_last"], ["c_first", "c_custkey"])
    return found.select("s_suppkey", "d_id", "c_last", "c_custkey", F.when(F.col("c_custkey").isNull(), kv.NOT_FOUND).otherwise(kv.OK).alias("status"))


@query(f"""WITH {NAMED_SQL}, {BY_NAME_SQL}, ask AS (SELECT s_suppkey, s_nationkey AS d_id, {name_sql('(s_suppkey * 7 % 40)')} AS c_last, s_suppkey * 7919 % 100 < 60 AS by_last, s_suppkey * 7 AS asked_id FROM supplier),
who AS (SELECT s_suppkey, by_last, b.c_custkey FROM ask JOIN by_name b USING (d_id, c_last) WHERE by_last UNION ALL SELECT s_suppkey, by_last, c.c_custkey FROM ask JOIN customer c ON c.c_custkey = asked_id WHERE NOT by_last),
lo AS (SELECT o_custkey, max(o_orderkey) o_orderkey FROM orders GROUP BY o_custkey)
SELECT s_suppkey, by_last, c_custkey, l_orderkey, l_partkey, l_linenumber, l_quantity FROM who JOIN lo ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = lo.o_orderkey""")
def tpcc_order_status(spark, sf_dir):
    """The lines of the customer's latest order: sixty of a hundred ask by district and last name, the others by number."""
    asked = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("d_id"), keys.last_name(F.col("s_suppkey") * 7 % 40).alias("c_last"), (F.col("s_suppkey") * 7919 % 100 < 60).alias("by_last"), (F.col("s_suppkey") * 7).alias("asked_id"))
    named = named_customers(spark, sf_dir)
    by_name = secondary.lookup_middle(asked.where("by_last"), named, ["d_id", "c_last"], ["c_first", "c_custkey"]).where("c_custkey is not null").select("s_suppkey", "by_last", "c_custkey")
    by_id = asked.where("not by_last").withColumnRenamed("asked_id", "c_custkey").select("s_suppkey", "by_last", "c_custkey").join(named.select("c_custkey"), "c_custkey", "left_semi")
    latest = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("l_orderkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    found = by_name.unionByName(by_id).join(latest, "c_custkey").join(lines, "l_orderkey")
    return found.select("s_suppkey", "by_last", "c_custkey", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity")


@query("""SELECT c_nationkey, c_custkey, o_orderkey, o_orderdate FROM customer JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderdate, o_orderkey) AS o_orderdate FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def tpcc_latest_order(spark, sf_dir):
    latest = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("o_orderkey"), F.max_by("o_orderdate", "o_orderkey").alias("o_orderdate"))
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey").join(latest, "c_custkey").select("c_nationkey", "c_custkey", "o_orderkey", "o_orderdate")


_ORDERED = "u AS (SELECT l_partkey k, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) q, count(*) c FROM lineitem GROUP BY l_partkey)"


@query(f"""WITH {_ORDERED} SELECT p_partkey, CAST(CASE WHEN q IS NULL THEN p_size WHEN p_size > q + 10 THEN p_size - q ELSE p_size - q + 91 END AS BIGINT) AS s_quantity,
CAST(coalesce(q, 0) AS BIGINT) AS s_ytd, coalesce(c, 0) AS s_order_cnt FROM part LEFT JOIN u ON p_partkey = k""")
def tpcc_new_order_stock(spark, sf_dir):
    """Stock after the batch, by the rule applied once to each item's total: equal to the ordered form if an item has one line."""
    used = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count("*").alias("c"))
    after = F.when(F.col("q").isNull(), F.col("p_size").cast("long")).otherwise(keys.stock_after(F.col("p_size").cast("long"), F.col("q")))
    return table(spark, sf_dir, "part").join(used, "p_partkey", "left").select("p_partkey", after.alias("s_quantity"), F.coalesce("q", F.lit(0)).alias("s_ytd"), F.coalesce("c", F.lit(0)).alias("s_order_cnt"))


@query("""WITH RECURSIVE l AS (SELECT l_partkey AS k, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem),
f AS (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_size AS BIGINT) AS s, CAST(0 AS BIGINT) AS n FROM part
UNION ALL SELECT f.k, CASE WHEN f.s > l.q + 10 THEN f.s - l.q ELSE f.s - l.q + 91 END, l.n FROM f JOIN l ON l.k = f.k AND l.n = f.n + 1)
SELECT k AS p_partkey, arg_max(s, n) AS s_quantity FROM f GROUP BY k""")
def tpcc_new_order_stock_ordered(spark, sf_dir):
    """Stock after each line in turn: the rule wraps at every line, so an item's lines are folded in their order, in a stream."""
    stock = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("p_size"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice").join(stock, "p_partkey")
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"]
    after = kv.fold_in_order(lines, "p_partkey", order, "p_size", "l_quantity", lambda s, q: s - q if s > q + 10 else s - q + 91)
    return stock.join(after, "p_partkey", "left").select("p_partkey", F.coalesce("state", "p_size").alias("s_quantity"))


@query("""WITH a AS (SELECT l_orderkey, sum(CAST(l_quantity * p_retailprice AS DECIMAL(18,2))) AS amount FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT o_orderkey, CAST(CAST(amount AS DECIMAL(18,2)) * CAST((100 - c_custkey % 50) * (100 + n_nationkey % 20 + n_regionkey % 20) AS INTEGER) AS DOUBLE) / 10000 AS total
FROM orders JOIN a ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def tpcc_new_order_total(spark, sf_dir):
    """Sum of quantity times price, less the customer's discount, plus the taxes of warehouse and district: whole per cents here."""
    price = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(price, "l_partkey")
    amount = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum((F.col("l_quantity") * F.col("p_retailprice")).cast("decimal(18,2)")).alias("amount"))
    who = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "n_nationkey", "n_regionkey")
    rate = ((100 - F.col("o_custkey") % 50) * (100 + F.col("n_nationkey") % 20 + F.col("n_regionkey") % 20)).cast("int")
    total = (F.col("amount").cast("decimal(18,2)") * rate).cast("double") / 10000
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(amount, "o_orderkey").join(who, "o_custkey").select("o_orderkey", total.alias("total"))


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'a') AND contains(p_type, 'STEEL') THEN 'B' ELSE 'G' END AS brand_generic FROM part")
def tpcc_brand_generic(spark, sf_dir):
    """B if both texts have their mark, else G."""
    both = F.contains("p_name", F.lit("a")) & F.contains("p_type", F.lit("STEEL"))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(both, "B").otherwise("G").alias("brand_generic"))


@query("""SELECT o_orderkey, c_nationkey AS d_id, 3001 + row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate, o_orderkey) - 1 AS o_id FROM orders JOIN customer ON o_custkey = c_custkey""")
def tpcc_order_seq(spark, sf_dir):
    """Order numbers given out by each district from 3001, in order of time: those of earlier days are counted, those of a day sorted."""
    numbered = dup.append_suffix(district_orders(spark, sf_dir), "d_id", order=["o_orderdate", "o_orderkey"], name="nth", coarse=F.to_date("o_orderdate"))
    return numbered.select("o_orderkey", "d_id", (F.col("nth") + 3001).cast("long").alias("o_id"))


@query("""SELECT l_orderkey, count(*) AS n_lines, bool_and(p_partkey IS NOT NULL) AS commits FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 100 <> 0) ON p_partkey = l_partkey GROUP BY 1""")
def tpcc_rollback_gate(spark, sf_dir):
    """An order commits only if every line's item is known: one of a hundred isn't."""
    known = table(spark, sf_dir, "part").where("p_partkey % 100 <> 0").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("known"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(known, "l_partkey", "left")
    return lines.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.bool_and(F.coalesce("known", F.lit(False))).alias("commits"))


@query("""SELECT l_orderkey, count(*) AS n_lines, count(*) FILTER (s_nationkey <> c_nationkey) AS n_remote, bool_and(s_nationkey = c_nationkey) AS all_local
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def tpcc_remote_lines(spark, sf_dir):
    """Lines supplied from another district than the customer's."""
    home = district_orders(spark, sf_dir).select(F.col("o_orderkey").alias("l_orderkey"), "d_id")
    supply = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(supply, "l_suppkey").join(home, "l_orderkey")
    local = F.col("s_nationkey") == F.col("d_id")
    return lines.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.count_if(~local).alias("n_remote"), F.bool_and(local).alias("all_local"))


@query(f"""WITH p AS (SELECT o_custkey, {_MONEY.format('o_totalprice')} AS amount, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey, round(c_acctbal - coalesce(amount, 0), 2) AS balance, coalesce(amount, 0) AS ytd_payment, coalesce(n, 0) AS payment_cnt FROM customer LEFT JOIN p ON o_custkey = c_custkey""")
def tpcc_payment(spark, sf_dir):
    """Customers after all payments: orders' totals stand for their amounts."""
    paid = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(keys.money(F.col("o_totalprice")).alias("amount"), F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(paid, "c_custkey", "left").select("c_custkey", F.round(F.col("c_acctbal") - F.coalesce("amount", F.lit(0.0)), 2).alias("balance"), F.coalesce("amount", F.lit(0.0)).alias("ytd_payment"), F.coalesce("n", F.lit(0)).alias("payment_cnt"))


@query(f"SELECT n_regionkey AS w_id, n_nationkey AS d_id, {_MONEY.format('o_totalprice')} AS ytd FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
def tpcc_payment_ytd(spark, sf_dir):
    """Payments of each district, each warehouse and all."""
    at = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("d_id"), F.col("n_regionkey").alias("w_id"))
    return district_orders(spark, sf_dir).select("d_id", "o_totalprice").join(at, "d_id").rollup("w_id", "d_id").agg(keys.money(F.col("o_totalprice")).alias("ytd"))


@query("""SELECT c_custkey, left('| ' || c_custkey || ' ' || c_nationkey || ' ' || n_regionkey || ' $' || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) || ' ' || c_name || c_mktsegment, 40) AS data
FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal < 0""")
def tpcc_bad_credit_data(spark, sf_dir):
    """Customers with bad credit get the payment's note before their data, cut to its size."""
    at = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    bad = table(spark, sf_dir, "customer").where("c_acctbal < 0").join(at, "c_nationkey")
    note = F.concat(F.lit("| "), F.concat_ws(" ", "c_custkey", "c_nationkey", "n_regionkey", F.concat(F.lit("$"), F.col("c_acctbal").cast("decimal(18,2)").cast("string"))), F.lit(" "))
    return bad.select("c_custkey", keys.bad_credit(note, F.concat("c_name", "c_mktsegment"), 40).alias("data"))


OLDEST_SQL = "old AS (SELECT c_nationkey d_id, min(o_orderkey) o_orderkey, arg_min(o_custkey, o_orderkey) AS o_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY c_nationkey)"


def oldest_open(spark, sf_dir):
    """Each district's oldest order that isn't delivered; districts without one drop out."""
    open_orders = district_orders(spark, sf_dir).where("o_orderstatus = 'O'")
    return open_orders.groupBy("d_id").agg(F.min("o_orderkey").alias("o_orderkey"), F.min_by("o_custkey", "o_orderkey").alias("o_custkey"))


@query(f"WITH {OLDEST_SQL} SELECT d_id, old.o_orderkey, count(*) n_lines, {_MONEY.format('l_extendedprice')} amount FROM old JOIN lineitem ON l_orderkey = old.o_orderkey GROUP BY d_id, old.o_orderkey")
def tpcc_delivery(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    return oldest_open(spark, sf_dir).join(lines, "o_orderkey").groupBy("d_id", "o_orderkey").agg(F.count("*").alias("n_lines"), keys.money(F.col("l_extendedprice")).alias("amount"))


@query(f"WITH {OLDEST_SQL} SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM old WHERE old.o_orderkey = orders.o_orderkey)")
def tpcc_delivery_remaining(spark, sf_dir):
    """Orders that are open after the delivery."""
    left = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey")
    return kv.delete(left, oldest_open(spark, sf_dir).select("o_orderkey"), "o_orderkey")


@query(f"""WITH {OLDEST_SQL}, a AS (SELECT o_custkey, {_MONEY.format('l_extendedprice')} AS amount, count(DISTINCT o_orderkey) AS n FROM old JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey, round(c_acctbal + coalesce(amount, 0), 2) AS balance, coalesce(n, 0) AS delivery_cnt FROM customer LEFT JOIN a ON o_custkey = c_custkey""")
def tpcc_delivery_customers(spark, sf_dir):
    """Customers after the delivery: the lines' amounts are added to the balance."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    got = oldest_open(spark, sf_dir).join(lines, "o_orderkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(keys.money(F.col("l_extendedprice")).alias("amount"), F.countDistinct("o_orderkey").alias("n"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").join(got, "c_custkey", "left").select("c_custkey", F.round(F.col("c_acctbal") + F.coalesce("amount", F.lit(0.0)), 2).alias("balance"), F.coalesce("n", F.lit(0)).alias("delivery_cnt"))


@query("SELECT o_orderkey, CAST(((((o_orderkey * 7919) % 1024) | (1 + (o_custkey * 104729) % 3000)) + 987) % 3000 + 1 AS BIGINT) AS c_id FROM orders")
def tpcc_nurand(spark, sf_dir):
    """Non-uniform numbers from two uniform ones, here made from the keys."""
    drawn = keys.nurand(1023, 1, 3000, F.col("o_orderkey") * 7919 % 1024, F.col("o_custkey") * 104729 % 3000 + 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", drawn.alias("c_id"))


@query(f"SELECT c_custkey, {_SYL}[CAST(c_custkey % 1000 // 100 AS INTEGER) + 1] || {_SYL}[CAST(c_custkey // 10 % 10 AS INTEGER) + 1] || {_SYL}[CAST(c_custkey % 10 AS INTEGER) + 1] AS c_last FROM customer")
def tpcc_clast(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", keys.last_name(F.col("c_custkey") % 1000).alias("c_last"))


@query("SELECT CAST(sum(CAST(o_orderkey * 1000003 + o_custkey AS HUGEINT) * 4611686018427) % 18446744073709551616 AS DECIMAL(20,0)) AS checksum, count(*) AS n FROM orders")
def tpcc_checksum(spark, sf_dir):
    """A wrapping sum over the rows: the same in any order."""
    mixed = (F.col("o_orderkey") * 1000003 + F.col("o_custkey")).cast("decimal(20,0)") * F.lit(4611686018427).cast("decimal(14,0)")
    return table(spark, sf_dir, "orders").agg(keys.wrapping_sum(mixed).alias("checksum"), F.count("*").alias("n"))


@query("""SELECT event_type AS kind, count(*) AS n, count(*) FILTER (value >= 20) AS commits, count(*) FILTER (value < 20) AS aborts,
 CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS total, min(value) AS least, max(value) AS greatest FROM events GROUP BY ROLLUP (event_type)""")
def tpcc_stats_rollup(spark, sf_dir):
    """Commits, aborts and latencies of each kind of transaction, and of all."""
    ns = F.round(F.col("value") * 1000).cast("long")
    return table(spark, sf_dir, "events").rollup(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 20).alias("commits"), F.count_if(F.col("value") < 20).alias("aborts"), F.sum(ns).alias("total"), F.min("value").alias("least"), F.max("value").alias("greatest"))


@query("""WITH k AS (SELECT event_type AS kind, count(*) FILTER (value >= 20) AS commits, count(*) AS tries, CAST(sum(CAST(round(value * 1000) AS BIGINT)) FILTER (value >= 20) AS DOUBLE) AS total FROM events GROUP BY 1)
SELECT kind, commits, tries, commits / 2592000.0::DOUBLE AS per_second, commits / CAST(sum(commits) OVER () AS DOUBLE) AS of_commits, tries / CAST(sum(tries) OVER () AS DOUBLE) AS of_tries, total / commits AS mean_latency FROM k""")
def tpcc_throughput(spark, sf_dir):
    """Commits a second over the thirty days, each kind's share, and the mean latency of its commits. The window is over one row a kind."""
    done = F.col("value") >= 20
    by = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count_if(done).alias("commits"), F.count("*").alias("tries"), F.sum(F.when(done, F.round(F.col("value") * 1000).cast("long"))).cast("double").alias("total"))
    everything = Window.partitionBy()
    share = lambda c: F.col(c) / F.sum(c).over(everything).cast("double")
    return by.select("kind", "commits", "tries", (F.col("commits") / F.lit(2592000.0)).alias("per_second"), share("commits").alias("of_commits"), share("tries").alias("of_tries"), (F.col("total") / F.col("commits")).alias("mean_latency"))


@query("""WITH d AS (SELECT * FROM (VALUES (0, 'district not found'), (1, 'customer not found'), (2, 'item not found'), (3, 'stock update failed'), (4, 'user abort')) t(code, reason))
SELECT event_type AS kind, reason, count(*) AS n FROM events JOIN d ON code = event_id % 5 WHERE value < 20 GROUP BY 1, 2""")
def tpcc_abort_dim(spark, sf_dir):
    """Aborts by the name of their reason: a join with a table of five rows."""
    names = ("district not found", "customer not found", "item not found", "stock update failed", "user abort")
    reasons = spark.createDataFrame(list(enumerate(names)), "code long, reason string")
    aborted = table(spark, sf_dir, "events").where("value < 20").select(F.col("event_type").alias("kind"), (F.col("event_id") % 5).alias("code"))
    return aborted.join(F.broadcast(reasons), "code").groupBy("kind", "reason").agg(F.count("*").alias("n"))


@query("""SELECT 'customer_by_nation' AS secondary, count(*) AS n FROM customer c JOIN customer p ON p.c_custkey = c.c_custkey
UNION ALL SELECT 'orders_by_customer', count(*) FROM orders s JOIN orders p ON p.o_orderkey = s.o_orderkey""")
def tpcc_secondary_check(spark, sf_dir):
    """Rows that are reached through each secondary table."""
    out = []
    for name, of, second, key in (("customer_by_nation", "customer", ["c_nationkey", "c_name"], ["c_custkey"]), ("orders_by_customer", "orders", ["o_custkey"], ["o_orderkey"])):
        primary = table(spark, sf_dir, of)
        found = secondary.lookup(secondary.derive(primary, second, key), primary.select(*key, F.lit(1).alias("there")), key)
        out.append(found.agg(F.lit(name).alias("secondary"), F.count("there").alias("n")))
    return out[0].unionByName(out[1])
