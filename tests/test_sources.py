import pytest
from pyspark.sql import functions as F

from lodespar.plans import registry
from lodespar.sources import catalog, generators
from lodespar.streaming import events


def test_catalog_round_trip(spark, tmp_path):
    made = catalog.Catalog(*catalog.WORKLOAD)
    made.save(spark, str(tmp_path / "c"))
    assert catalog.Catalog.load(spark, str(tmp_path / "c")).list() == list(catalog.WORKLOAD)
    with pytest.raises(catalog.ContainerExists):
        made.create(catalog.TableSpec("orders", ("o_orderkey",)))
    with pytest.raises(catalog.ContainerExists):
        made.drop("orders")
    made.drop("orders_by_customer")
    made.drop("orders")
    with pytest.raises(catalog.ContainerNotFound):
        made["orders"]


def test_three_containers_stay(spark, tmp_path):
    for c in range(3):
        catalog.write_ordered(spark.createDataFrame([(i, bytes([c]) * 4) for i in reversed(range(10))], "k long, v binary"), str(tmp_path / str(c)), "k")
    for c in range(3):
        rows = spark.read.parquet(str(tmp_path / str(c))).orderBy("k").collect()
        assert [r.k for r in rows] == list(range(10)) and {bytes(r.v) for r in rows} == {bytes([c]) * 4}


def test_only_sorted_streams_are_loaded(spark, tmp_path):
    rows = spark.range(1000).select("id", (F.col("id") * 2).alias("k"), F.lit("x").alias("g"))
    catalog.bulk_load(rows, str(tmp_path / "good"), ["g", "k"], ["id"])
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1000
    for k, bad in enumerate((rows.withColumn("k", F.when(F.col("id") == 500, 3).otherwise(F.col("k"))), rows.withColumn("k", F.expr("id div 2")))):
        with pytest.raises(catalog.OutOfOrder):
            catalog.bulk_load(bad, str(tmp_path / f"bad{k}"), ["g", "k"], ["id"])
        assert not (tmp_path / f"bad{k}").exists()
    catalog.bulk_load(bad, str(tmp_path / "repeats"), ["g", "k"], ["id"], unique=False)
    catalog.bulk_load(rows.limit(0), str(tmp_path / "none"), ["k"], ["id"])


def test_bucketed_join_has_no_shuffle(spark, small):
    catalog.write_bucketed(catalog.table(spark, small, "orders").withColumnRenamed("o_orderkey", "k"), "orders_b", 4, "k")
    catalog.write_bucketed(catalog.table(spark, small, "lineitem").withColumnRenamed("l_orderkey", "k"), "lines_b", 4, "k")
    joined = spark.table("orders_b").hint("merge").join(spark.table("lines_b"), "k")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_range_scan_is_pushed_down(spark, small):
    plan = registry.queries()["kv_scan_range"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,1000)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_generators(spark):
    assert sorted(r.value for r in generators.permutation(spark, 5, 40).collect()) == list(range(5, 41))
    rows = generators.random_key_values(spark, 200).collect()
    assert sorted(r.k for r in rows) == list(range(200)) and all(50 <= len(r.v) <= 100 for r in rows)
    assert [r.k for r in generators.random_key_values(spark, 50, sorted_keys=True).collect()] == list(range(50))
    zeta = generators.zeta(spark, 1000, 0.8)
    drawn = spark.range(20_000).select(generators.zipf(F.col("id") / 20_000, 1000, 0.8, zeta).alias("k"))
    top = drawn.groupBy("k").count().orderBy("k").limit(2).collect()
    assert abs(top[0]["count"] / 20_000 - 1 / zeta) < 0.01 and drawn.agg(F.max("k")).first()[0] <= 999


def test_order_entry_tables(spark):
    t = generators.order_entry(spark, 2, items=50, customers=30, districts=3, undelivered_from=22)
    n = {k: v.count() for k, v in t.items()}
    assert n["item"] == 50 and n["stock"] == 100 and n["district"] == 6 and n["customer"] == n["orders"] == 180 and n["new_order"] == 54
    assert n["order_line"] == t["orders"].agg(F.sum(F.col("o_ol_cnt") - 1)).first()[0]
    assert t["orders"].groupBy("o_w_id", "o_d_id").agg(F.countDistinct("o_c_id").alias("c")).where("c <> 30").count() == 0
    assert n["history"] == n["customer_by_name"] == n["orders_by_customer"] == 180
    row = t["customer"].first()
    assert t["customer"].first() == row and len(row.c_address.zip) == 9 and row.c_middle == "OE" and 300 <= len(row.c_data) <= 500
    marked = t["stock"].where(F.contains("s_data", F.lit("ORIGINAL"))).count()
    assert 2 <= marked <= 25 and t["stock"].where("length(s_data) not between 26 and 50").count() == 0


@pytest.mark.parametrize("kind", ["tumbling", "sessions", "deduplicated"])
def test_stream_equals_batch(spark, small, tmp_path, kind):
    stream = getattr(events, kind)(events.read_events(spark, small))
    events.collect(stream, "append", str(tmp_path / "c"), str(tmp_path / "o"))
    rows = spark.read.parquet(str(tmp_path / "o"))
    if kind == "tumbling":
        want = {(str(r.bucket), r.event_type): r.n_events for r in registry.queries()["ev_throughput_window"](spark, small).collect()}
        got = {(str(r.bucket), r.event_type): r.n for r in rows.collect()}
    elif kind == "sessions":
        want = {(r.user_id, str(r.started)): r.n for r in registry.queries()["stream_session"](spark, small).collect()}
        got = {(r.user_id, str(r.started)): r.n for r in rows.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "n").collect()}
    else:
        want = got = {}
        assert rows.count() == rows.select("event_id").distinct().count() == 1000
    assert got.items() <= want.items() and len(got) >= 0.9 * len(want)  # what isn't closed yet is missing


def test_state_and_late_events(spark, small, tmp_path):
    events.collect(events.running_counts(events.read_events(spark, small)), "update", str(tmp_path / "c"), str(tmp_path / "o"))
    got = {r.user_id: r.n for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {r.user_id: r.n for r in registry.queries()["stream_stateful_counter"](spark, small).collect()}
    head = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = [[(1, "2024-01-01 00:10:00"), (2, "2024-01-05 00:10:00")], [(3, "2024-01-01 00:20:00"), (4, "2024-01-09 00:00:00")]]
    for k, part in enumerate(rows):
        spark.createDataFrame([(i, t, 1, "x", 1.0, "") for i, t in part], head.replace("timestamp_ntz", "string")).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events.collect(events.tumbling(events.read_events(spark, str(tmp_path / "in"), "*.parquet", 1)), "append", str(tmp_path / "lc"), str(tmp_path / "lo"))
    assert {str(r.bucket)[:10]: r.n for r in spark.read.parquet(str(tmp_path / "lo")).collect()} == {"2024-01-01": 1, "2024-01-05": 1}  # event 3 came too late
