"""The order-entry workload's writes: what new orders, payments and deliveries add to the tables and change in them.

The test tables stand for the workload's as in ``tpcc``: a nation is a district and a region a warehouse. An order of ``orders`` is an
input of NewOrder, with its lines; one with an item that isn't known (one in a hundred) is rolled back and leaves nothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodespar.functions import keys
from lodespar.operators import dup, kv, secondary
from lodespar.plans import tpcc
from lodespar.plans.registry import query
from lodespar.sources import generators
from lodespar.sources.catalog import table

_COMMITTED = """bad AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey % 100 = 0),
o AS (SELECT o_orderkey, o_custkey, o_orderdate, c_nationkey AS d_id, 3000 + row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate, o_orderkey) AS o_id
 FROM orders JOIN customer ON o_custkey = c_custkey WHERE NOT EXISTS (SELECT 1 FROM bad WHERE l_orderkey = o_orderkey)),
l AS (SELECT o.d_id, o.o_id, l_linenumber AS ol_number, l_partkey AS ol_i_id, s_nationkey AS ol_supply_d_id, CAST(l_quantity AS BIGINT) AS ol_quantity,
 CAST(CAST(l_quantity * p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS ol_amount, 'dist-' || l_partkey || '-' || o.d_id AS ol_dist_info
 FROM o JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey)"""


def _committed(spark, sf_dir):
    """Orders with all items known, with their district and the number it gives them: from 3001, in order of time."""
    lines = table(spark, sf_dir, "lineitem")
    bad = lines.where("l_partkey % 100 = 0").select(F.col("l_orderkey").alias("o_orderkey"))
    good = tpcc.district_orders(spark, sf_dir).join(bad, "o_orderkey", "left_anti")
    numbered = dup.append_suffix(good, "d_id", order=["o_orderdate", "o_orderkey"], name="nth", coarse=F.to_date("o_orderdate"))
    return numbered.withColumn("o_id", (F.col("nth") + 3001).cast("long"))


def _lines(spark, sf_dir):
    """The committed orders' lines, with their price and the stock row's text for the order's district, which is made after the join."""
    orders = _committed(spark, sf_dir).select(F.col("o_orderkey").alias("l_orderkey"), "d_id", "o_id")
    stock = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    supply = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("ol_supply_d_id"))
    rows = table(spark, sf_dir, "lineitem").join(orders, "l_orderkey").join(supply, "l_suppkey").join(stock, "l_partkey")
    amount = (F.col("l_quantity") * F.col("p_retailprice")).cast("decimal(18,2)").cast("double")
    text = F.concat(F.lit("dist-"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("d_id").cast("string"))
    return rows.select("d_id", "o_id", F.col("l_linenumber").alias("ol_number"), F.col("l_partkey").alias("ol_i_id"), "ol_supply_d_id", F.col("l_quantity").cast("long").alias("ol_quantity"), amount.alias("ol_amount"), text.alias("ol_dist_info"))


@query(f"WITH {_COMMITTED} SELECT o.d_id, o.o_id, o_custkey AS o_c_id, count(*) AS o_ol_cnt, bool_and(ol_supply_d_id = o.d_id) AS o_all_local, 0 AS o_carrier_id FROM o JOIN l ON l.d_id = o.d_id AND l.o_id = o.o_id GROUP BY 1, 2, 3")
def tpcc_new_order_orders(spark, sf_dir):
    """The rows that NewOrder adds to the orders."""
    of = _lines(spark, sf_dir).groupBy("d_id", "o_id").agg(F.count("*").alias("o_ol_cnt"), F.bool_and(F.col("ol_supply_d_id") == F.col("d_id")).alias("o_all_local"))
    heads = _committed(spark, sf_dir).select("d_id", "o_id", F.col("o_custkey").alias("o_c_id"))
    return heads.join(of, ["d_id", "o_id"]).withColumn("o_carrier_id", F.lit(0))


@query(f"WITH {_COMMITTED} SELECT d_id AS no_d_id, o_id AS no_o_id FROM o")
def tpcc_new_order_open(spark, sf_dir):
    """The rows that NewOrder adds to those not delivered yet."""
    return _committed(spark, sf_dir).select(F.col("d_id").alias("no_d_id"), F.col("o_id").alias("no_o_id"))


@query(f"WITH {_COMMITTED} SELECT * FROM l")
def tpcc_new_order_lines(spark, sf_dir):
    """The rows that NewOrder adds to the lines; the text is the stock row's for the order's district."""
    return _lines(spark, sf_dir)


@query(f"WITH {_COMMITTED}, n AS (SELECT d_id, count(*) AS c FROM o GROUP BY 1) SELECT n_nationkey AS d_id, CAST(3001 + coalesce(c, 0) AS BIGINT) AS d_next_o_id FROM nation LEFT JOIN n ON d_id = n_nationkey")
def tpcc_new_order_districts(spark, sf_dir):
    """Each district's next order number: rolled back orders take none."""
    used = _committed(spark, sf_dir).groupBy("d_id").agg(F.count("*").alias("c"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("d_id")).join(used, "d_id", "left").select("d_id", (F.coalesce("c", F.lit(0)) + 3001).cast("long").alias("d_next_o_id"))


_PAY = f"""{tpcc.NAMED_SQL}, {tpcc.BY_NAME_SQL},
q AS (SELECT o_orderkey, c_nationkey AS d_id, o_totalprice AS amount, o_orderkey * 7919 % 100 < 60 AS by_last, o_orderkey * 104729 % 100 >= 85 AS remote,
 {tpcc.name_sql('(o_orderkey % 40)')} AS c_last, CASE WHEN o_orderkey * 104729 % 100 >= 85 THEN (c_nationkey + 1 + o_orderkey % 24) % 25 ELSE c_nationkey END AS c_d_id, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey),
pay AS (SELECT q.o_orderkey, q.d_id, q.c_d_id, q.by_last, q.remote, q.amount, CASE WHEN q.by_last THEN b.c_custkey ELSE c.c_custkey END AS c_custkey
 FROM q LEFT JOIN by_name b ON q.by_last AND b.d_id = q.c_d_id AND b.c_last = q.c_last
 LEFT JOIN (SELECT d_id, min(c_custkey) AS first, max(c_custkey) AS last FROM named GROUP BY 1) r ON r.d_id = q.c_d_id
 LEFT JOIN customer c ON NOT q.by_last AND c.c_custkey = CASE WHEN NOT q.remote THEN q.o_custkey WHEN q.o_orderkey % 2 = 0 THEN r.first ELSE r.last END)"""


def _payments(spark, sf_dir):
    """Payments at a district: sixty of a hundred name the customer, fifteen are of a customer of another district.

    A customer of another district by number is that district's first or last one. What isn't found has no c_custkey."""
    k = F.col("o_orderkey")
    remote = k * 104729 % 100 >= 85
    rows = tpcc.district_orders(spark, sf_dir).select("o_orderkey", "d_id", F.col("o_totalprice").alias("amount"), (k * 7919 % 100 < 60).alias("by_last"), remote.alias("remote"), keys.last_name(k % 40).alias("c_last"), F.when(remote, (F.col("d_id") + 1 + k % 24) % 25).otherwise(F.col("d_id")).cast("int").alias("c_d_id"), "o_custkey")
    named = tpcc.named_customers(spark, sf_dir)
    at_home = named.withColumnRenamed("d_id", "c_d_id")
    by_name = secondary.lookup_middle(rows.where("by_last"), at_home, ["c_d_id", "c_last"], ["c_first", "c_custkey"]).drop("c_first")
    ends = at_home.groupBy("c_d_id").agg(F.min("c_custkey").alias("first"), F.max("c_custkey").alias("last"))  # a row a district
    asked = rows.where("not by_last").join(ends, "c_d_id", "left")
    asked = asked.withColumn("asked_id", F.when(~F.col("remote"), F.col("o_custkey")).when(k % 2 == 0, F.col("first")).otherwise(F.col("last"))).drop("first", "last")
    by_id = asked.join(named.select(F.col("c_custkey").alias("asked_id"), "c_custkey"), "asked_id", "left").drop("asked_id")
    return by_name.unionByName(by_id).select("o_orderkey", "d_id", "c_d_id", "by_last", "remote", "amount", "c_custkey")


@query(f"WITH {_PAY} SELECT o_orderkey, d_id, c_d_id, by_last, remote, c_custkey, CASE WHEN c_custkey IS NULL THEN 'key_not_found' ELSE 'ok' END AS status FROM pay")
def tpcc_payment_customers(spark, sf_dir):
    """Whom each payment is of, by last name or number, at home or from another district; one whose customer isn't found aborts."""
    found = _payments(spark, sf_dir).drop("amount").withColumn("c_d_id", F.col("c_d_id").cast("long"))
    return found.withColumn("status", F.when(F.col("c_custkey").isNull(), kv.NOT_FOUND).otherwise(kv.OK))


@query(f"""WITH {_PAY}, p AS (SELECT c_custkey, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS paid, count(*) AS n FROM pay WHERE c_custkey IS NOT NULL GROUP BY 1)
SELECT c.c_custkey, round(c_acctbal - coalesce(paid, 0), 2) AS balance, coalesce(paid, 0) AS ytd_payment, coalesce(n, 0) AS payment_cnt FROM customer c LEFT JOIN p ON p.c_custkey = c.c_custkey""")
def tpcc_payment_branches(spark, sf_dir):
    """Customers after all payments of ``tpcc_payment_customers`` that commit."""
    paid = _payments(spark, sf_dir).where("c_custkey is not null").groupBy("c_custkey").agg(keys.money(F.col("amount")).alias("paid"), F.count("*").alias("n"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").join(paid, "c_custkey", "left")
    return rows.select("c_custkey", F.round(F.col("c_acctbal") - F.coalesce("paid", F.lit(0.0)), 2).alias("balance"), F.coalesce("paid", F.lit(0.0)).alias("ytd_payment"), F.coalesce("n", F.lit(0)).alias("payment_cnt"))


@query(f"""WITH {_PAY}, p AS (SELECT d_id, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS ytd, count(*) FILTER (remote) AS n_remote FROM pay WHERE c_custkey IS NOT NULL GROUP BY 1)
SELECT n_nationkey AS d_id, n_regionkey AS w_id, coalesce(ytd, 0) AS ytd, coalesce(n_remote, 0) AS n_remote FROM nation LEFT JOIN p ON d_id = n_nationkey""")
def tpcc_payment_districts(spark, sf_dir):
    """What each district has taken: payments count where they're made, not where the customer is at home."""
    took = _payments(spark, sf_dir).where("c_custkey is not null").groupBy("d_id").agg(keys.money(F.col("amount")).alias("ytd"), F.count_if("remote").alias("n_remote"))
    at = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("d_id"), F.col("n_regionkey").alias("w_id"))
    return at.join(took, "d_id", "left").select("d_id", "w_id", F.coalesce("ytd", F.lit(0.0)).alias("ytd"), F.coalesce("n_remote", F.lit(0)).alias("n_remote"))


@query(f"""WITH {tpcc.OLDEST_SQL} SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'O' THEN 1 + o_orderkey % 10 WHEN o_orderkey IN (SELECT o_orderkey FROM old) THEN 7 END AS o_carrier_id FROM orders""")
def tpcc_delivery_orders(spark, sf_dir):
    """Orders after the delivery: each district's oldest open one has got the carrier; others keep theirs, or have none yet."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "O", F.col("o_orderkey") % 10 + 1).alias("o_carrier_id"))
    given = tpcc.oldest_open(spark, sf_dir).select("o_orderkey", F.lit(7).cast("long").alias("o_carrier_id"), F.lit(0).alias("seq"))
    return kv.update(rows, given, "o_orderkey", "seq", "o_carrier_id")


@query(f"""WITH {tpcc.OLDEST_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linestatus <> 'O' THEN l_shipdate WHEN l_orderkey IN (SELECT o_orderkey FROM old) THEN TIMESTAMP '2000-01-01' END AS ol_delivery_d FROM lineitem""")
def tpcc_delivery_lines(spark, sf_dir):
    """Lines after the delivery: those of the delivered orders have got its date, if they had none."""
    given = tpcc.oldest_open(spark, sf_dir).select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("given"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_shipdate").join(given, "l_orderkey", "left")
    date = F.when(F.col("l_linestatus") != "O", F.col("l_shipdate")).when(F.col("given"), F.lit("2000-01-01 00:00:00").cast("timestamp_ntz").cast(rows.schema["l_shipdate"].dataType))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", date.alias("ol_delivery_d"))


_SIZE = {"items": 200, "customers": 30, "districts": 10, "undelivered_from": 22}


@query(f"""WITH w AS (SELECT count(*) AS n FROM region), p AS (SELECT n * {_SIZE['districts'] * _SIZE['customers']} AS per FROM w)
SELECT name AS container, CAST(rows AS BIGINT) AS n_rows, 0 AS n_bad FROM (
SELECT 'item' AS name, {_SIZE['items']} AS rows UNION ALL SELECT 'warehouse', n FROM w UNION ALL SELECT 'stock', n * {_SIZE['items']} FROM w UNION ALL SELECT 'district', n * {_SIZE['districts']} FROM w
UNION ALL SELECT unnest(['customer', 'customer_by_name', 'history', 'orders', 'orders_by_customer']), per FROM p UNION ALL SELECT 'new_order', n * {_SIZE['districts'] * (_SIZE['customers'] - _SIZE['undelivered_from'] + 1)} FROM w)""")
def tpcc_load_check(spark, sf_dir):
    """Generated tables for as many warehouses as there are regions: rows of each, and rows that break a rule of the workload.

    Rules: sizes of texts, bounds of numbers, zip codes, and that secondary rows lead to their primary."""
    made = generators.order_entry(spark, table(spark, sf_dir, "region").count(), **_SIZE)
    size = lambda x, name: F.length(x).between(*generators.SIZES[name])
    fits = lambda x: F.col(f"{x}.zip").rlike("^[0-9]{4}11111$") & size(f"{x}.street_1", "street") & size(f"{x}.city", "city")
    rules = {
        "item": size("i_name", "item_name") & size("i_data", "data") & F.col("i_price").between(1, 100),
        "warehouse": fits("w_address") & F.col("w_tax").between(0, 0.2),
        "stock": size("s_data", "data") & (F.size("s_dist") == _SIZE["districts"]) & F.col("s_quantity").between(10, 100),
        "district": fits("d_address") & (F.col("d_next_o_id") == _SIZE["customers"] + 1),
        "customer": fits("c_address") & size("c_first", "first") & F.col("c_phone").rlike("^[0-9]{16}$") & F.col("c_credit").isin("GC", "BC"),
        "history": size("h_data", "history_data") & (F.col("h_amount") == 10),
        "orders": F.col("o_ol_cnt").between(5, 15) & (F.col("o_carrier_id").isNull() == (F.col("o_id") >= _SIZE["undelivered_from"])),
        "new_order": F.col("no_o_id") >= _SIZE["undelivered_from"],
    }
    out = None
    for name, rows in made.items():
        if name == "order_line":  # as many as the orders say: their number isn't fixed
            continue
        second = {"customer_by_name": ("customer", ["c_w_id", "c_d_id", "c_id"]), "orders_by_customer": ("orders", ["o_w_id", "o_d_id", "o_id"])}.get(name)
        if second:
            rows = rows.join(made[second[0]].select(*second[1], F.lit(True).alias("there")), second[1], "left")
        bad = F.count_if(~F.coalesce(F.col("there") if second else rules[name], F.lit(False)))
        got = rows.agg(F.lit(name).alias("container"), F.count("*").alias("n_rows"), bad.cast("int").alias("n_bad"))
        out = got if out is None else out.unionByName(got)
    return out


@query(f"WITH o AS (SELECT count(*) * {_SIZE['districts'] * _SIZE['customers']} AS n FROM region) SELECT n AS n_orders, CAST(0 AS BIGINT) AS n_other_count FROM o")
def tpcc_load_lines(spark, sf_dir):
    """Generated orders, and those that haven't one line less than their count, all of known items and five of each."""
    made = generators.order_entry(spark, table(spark, sf_dir, "region").count(), **_SIZE)
    good = F.col("ol_i_id").between(1, _SIZE["items"]) & (F.col("ol_quantity") == 5) & (F.length("ol_dist_info") == 24)
    lines = made["order_line"].groupBy(F.col("ol_w_id").alias("o_w_id"), F.col("ol_d_id").alias("o_d_id"), F.col("ol_o_id").alias("o_id")).agg(F.count_if(good).alias("lines"))
    rows = made["orders"].join(lines, ["o_w_id", "o_d_id", "o_id"], "left")
    return rows.agg(F.count("*").alias("n_orders"), F.count_if(F.coalesce("lines", F.lit(0)) != F.col("o_ol_cnt") - 1).alias("n_other_count"))
