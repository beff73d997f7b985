"""Generated tables: every row depends on its number and a seed alone, so that any retry gives it again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespar.functions import keys


def key_values(spark: SparkSession, n: int, rows_per_part: int, partitions: int | None = None) -> DataFrame:
    """Sequential keys 0..n-1 with values made from them, and the range of ``rows_per_part`` keys that each is in."""
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return rows.select(F.col("id").alias("k"), F.lpad(F.hex(F.col("id") * 48271 % 1000003), 8, "0").alias("v"), F.expr(f"id div {rows_per_part}").alias("part"))


def random_values(spark: SparkSession, n: int, least: int, most: int, seed: int = 0) -> DataFrame:
    """Row numbers with hexadecimal values of ``least`` to ``most`` characters."""
    size = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(most - least + 1)) + least
    text = F.concat(*(F.sha2(F.concat_ws("-", "id", F.lit(seed), F.lit(k)), 256) for k in range(most // 64 + 1)))
    return spark.range(n).select("id", F.substring(text, F.lit(1), size.cast("int")).alias("v"))


def random_key_values(spark: SparkSession, n: int, unique: bool = True, sorted_keys: bool = False, value_size: tuple[int, int] = (50, 100), seed: int = 0) -> DataFrame:
    """(k, v): unique keys 0..n-1 or keys drawn with repetition; in key order or in one that the seed decides."""
    rows = random_values(spark, n, *value_size, seed)
    key = F.col("id") if unique else F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(n))
    rows = rows.select(key.alias("k"), "v", F.xxhash64("id", F.lit(seed + 2)).alias("place"))
    return rows.orderBy("k" if sorted_keys else "place").drop("place")


def permutation(spark: SparkSession, low: int, high: int, seed: int = 0) -> DataFrame:
    """The numbers low..high in an order that the seed decides."""
    return spark.range(low, high + 1).orderBy(F.xxhash64("id", F.lit(seed)), "id").withColumnRenamed("id", "value")


def zipf(uniform: Column, n: int, theta: float, zeta: float) -> Column:
    """A number 0..n-1 of a Zipf distribution with skew 0 <= theta < 1, from a uniform one; zeta: sum of i ** -theta over 1..n."""
    two = 1 + 0.5**theta
    alpha, eta = 1 / (1 - theta), (1 - (2 / n) ** (1 - theta)) / (1 - two / zeta)
    scaled = F.floor(F.pow(eta * uniform - eta + 1, F.lit(alpha)) * n + 1e-9)
    return F.when(uniform * zeta < 1, 0).when(uniform * zeta < two, 1).otherwise(F.least(F.lit(n - 1), scaled)).cast("long")


def zeta(spark: SparkSession, n: int, theta: float) -> float:
    return spark.range(1, n + 1).agg(F.sum(F.pow(F.lit(1.0) / F.col("id"), F.lit(theta)))).first()[0]


def choose(drawn: Column, below: list[tuple[str, Column]], other: str) -> Column:
    """The first name whose bound ``drawn`` is below, else ``other``."""
    (name, bound), *rest = below
    out = F.when(drawn < bound, name)
    for name, bound in rest:
        out = out.when(drawn < bound, name)
    return out.otherwise(other)


def _draw(low: int, high: int, *parts) -> Column:
    return (F.pmod(F.xxhash64(*parts), F.lit(high - low + 1)) + low).cast("long")


# The characters of random texts, and the workload's sizes of texts (least, most).
LETTERS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
SIZES = {"item_name": (14, 24), "data": (26, 50), "street": (10, 20), "city": (10, 20), "state": (2, 2), "place_name": (6, 10), "dist": (24, 24), "first": (8, 16), "phone": (16, 16), "customer_data": (300, 500), "history_data": (12, 24)}
ZIP_END, MARK = "11111", "ORIGINAL"


def text(size: tuple[int, int], *parts: Column, letters: str = LETTERS) -> Column:
    """A random text of ``size`` (least, most) characters, the same for equal ``parts``."""
    n = _draw(*size, *parts, F.lit("n")).cast("int")
    letter = lambda k: F.substring(F.lit(letters), (F.pmod(F.xxhash64(*parts, k), F.lit(len(letters))) + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), n), letter), "")


def data_text(*parts: Column) -> Column:
    """Item or stock data; one in ten has the mark somewhere."""
    plain = text(SIZES["data"], *parts)
    at = F.pmod(F.xxhash64(*parts, F.lit("at")), F.length(plain) - len(MARK) + 1).cast("int") + 1
    return F.when(_draw(0, 9, *parts, F.lit("mark")) == 0, F.overlay(plain, F.lit(MARK), at)).otherwise(plain)


def address(*parts: Column) -> Column:
    """A struct of street_1, street_2, city, state and a zip code of four digits and a fixed end."""
    piece = lambda name, size: text(SIZES[size], *parts, F.lit(name)).alias(name)
    code = F.concat(text((4, 4), *parts, F.lit("zip"), letters=DIGITS), F.lit(ZIP_END))
    return F.struct(piece("street_1", "street"), piece("street_2", "street"), piece("city", "city"), piece("state", "state"), code.alias("zip"))


def order_entry(spark: SparkSession, warehouses: int, items: int = 100_000, customers: int = 3000, districts: int = 10, undelivered_from: int = 2101, seed: int = 0, since: str = "2024-01-01 00:00:00") -> dict[str, DataFrame]:
    """The order-entry workload's eleven tables, two of them secondary: item, warehouse, stock, district, customer, customer_by_name,
    history, orders, orders_by_customer, new_order, order_line.

    A district has as many orders as customers, and each customer one, by a permutation. As in the loader that
    this follows, an order has one line less than ``o_ol_cnt``. Orders from ``undelivered_from`` on aren't delivered."""
    s, when = F.lit(seed), F.lit(since).cast("timestamp_ntz")
    item = spark.range(1, items + 1).select(F.col("id").alias("i_id"), _draw(1, 10000, "id", F.lit("im"), s).alias("i_im_id"), (_draw(100, 10000, "id", F.lit("p"), s) / 100).alias("i_price"), text(SIZES["item_name"], F.col("id"), F.lit("in"), s).alias("i_name"), data_text(F.col("id"), F.lit("i"), s).alias("i_data"))
    warehouse = spark.range(1, warehouses + 1).select(F.col("id").alias("w_id"), (_draw(0, 2000, "id", F.lit("t"), s) / 10000).alias("w_tax"), F.lit(300000.0).alias("w_ytd"), text(SIZES["place_name"], F.col("id"), F.lit("w"), s).alias("w_name"), address(F.col("id"), F.lit("w"), s).alias("w_address"))
    w, i = F.expr(f"id div {items} + 1"), F.col("id") % items + 1
    none = F.lit(0).cast("long")
    dist = F.array(*(text(SIZES["dist"], w, i, F.lit(d), s) for d in range(districts)))
    stock = spark.range(warehouses * items).select(w.alias("s_w_id"), i.alias("s_i_id"), _draw(10, 100, w, i, F.lit("q"), s).alias("s_quantity"), dist.alias("s_dist"), none.alias("s_ytd"), none.alias("s_order_cnt"), none.alias("s_remote_cnt"), data_text(w, i, F.lit("s"), s).alias("s_data"))
    w, d = F.expr(f"id div {districts} + 1"), F.col("id") % districts + 1
    district = spark.range(warehouses * districts).select(w.alias("d_w_id"), d.alias("d_id"), (_draw(0, 2000, w, d, F.lit("t"), s) / 10000).alias("d_tax"), F.lit(30000.0).alias("d_ytd"), F.lit(customers + 1).cast("long").alias("d_next_o_id"), text(SIZES["place_name"], w, d, F.lit("d"), s).alias("d_name"), address(w, d, F.lit("d"), s).alias("d_address"))
    per = districts * customers
    w, d, c = F.expr(f"id div {per} + 1"), F.expr(f"id div {customers} % {districts} + 1"), F.col("id") % customers + 1
    number = F.when(c <= 1000, c - 1).otherwise(keys.nurand(255, 0, 999, _draw(0, 255, w, d, c, F.lit("a"), s), _draw(0, 999, w, d, c, F.lit("b"), s)))
    customer = spark.range(warehouses * per).select(
        w.alias("c_w_id"), d.alias("c_d_id"), c.alias("c_id"), keys.last_name(number).alias("c_last"), F.lit("OE").alias("c_middle"), text(SIZES["first"], w, d, c, F.lit("f"), s).alias("c_first"),
        F.when(_draw(0, 9, w, d, c, F.lit("k"), s) == 0, "BC").otherwise("GC").alias("c_credit"), F.lit(50000.0).alias("c_credit_lim"), (_draw(0, 5000, w, d, c, F.lit("x"), s) / 10000).alias("c_discount"),
        F.lit(-10.0).alias("c_balance"), F.lit(10.0).alias("c_ytd_payment"), F.lit(1).alias("c_payment_cnt"), F.lit(0).alias("c_delivery_cnt"), when.alias("c_since"),
        text(SIZES["phone"], w, d, c, F.lit("ph"), s, letters=DIGITS).alias("c_phone"), text(SIZES["customer_data"], w, d, c, F.lit("cd"), s).alias("c_data"), address(w, d, c, F.lit("c"), s).alias("c_address"),
    )
    history = customer.select(*(F.col(f"c_{x}").alias(f"h_c_{x}") for x in ("w_id", "d_id", "id")), F.col("c_w_id").alias("h_w_id"), F.col("c_d_id").alias("h_d_id"), when.alias("h_date"), F.lit(10.0).alias("h_amount"), text(SIZES["history_data"], F.col("c_w_id"), F.col("c_d_id"), F.col("c_id"), F.lit("h"), s).alias("h_data"))
    by_name = customer.select("c_w_id", "c_d_id", "c_last", "c_id")
    step = next(k for k in range(max(2, customers // 3) | 1, 4 * customers + 9, 2) if all(k % p or customers % p for p in range(2, customers + 1) if customers % p == 0))  # no common factor: a permutation
    orders = spark.range(warehouses * per).select(w.alias("o_w_id"), d.alias("o_d_id"), c.alias("o_id"), ((c * step) % customers + 1).alias("o_c_id"), _draw(5, 15, w, d, c, F.lit("l"), s).alias("o_ol_cnt"), F.when(c < undelivered_from, _draw(1, 10, w, d, c, F.lit("r"), s)).alias("o_carrier_id"), F.lit(True).alias("o_all_local"), when.alias("o_entry_d"))
    by_customer = orders.select("o_w_id", "o_d_id", "o_c_id", "o_id")
    new_order = orders.where(F.col("o_id") >= undelivered_from).select(F.col("o_w_id").alias("no_w_id"), F.col("o_d_id").alias("no_d_id"), F.col("o_id").alias("no_o_id"))
    lines = orders.select("o_w_id", "o_d_id", "o_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("o_ol_cnt") - 1)).alias("ol_number"))
    at = ("o_w_id", "o_d_id", "o_id", "ol_number")
    done = F.col("o_id") < undelivered_from
    order_line = lines.select(
        *(F.col(x).alias(y) for x, y in zip(at, ("ol_w_id", "ol_d_id", "ol_o_id", "ol_number"), strict=True)), _draw(1, items, *at, F.lit("i"), s).alias("ol_i_id"), F.col("o_w_id").alias("ol_supply_w_id"), F.when(done, when).alias("ol_delivery_d"),
        F.lit(5).cast("long").alias("ol_quantity"), F.when(done, 0.0).otherwise(_draw(1, 999999, *at, F.lit("m"), s) / 100).alias("ol_amount"), text(SIZES["dist"], *(F.col(x) for x in at), F.lit("di"), s).alias("ol_dist_info"),
    )
    return {"item": item, "warehouse": warehouse, "stock": stock, "district": district, "customer": customer, "customer_by_name": by_name, "history": history, "orders": orders, "orders_by_customer": by_customer, "new_order": new_order, "order_line": order_line}
