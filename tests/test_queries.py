"""Every query of the library proper against DuckDB on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from lodespar.plans import registry
from tests.duck import assert_same, connect

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_duckdb(spark, small, con, name):
    assert_same(QUERIES[name](spark, small), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).first().low_stock >= 0


def test_approximate_quantiles_are_near(spark, small):
    exact = {r.event_type: r for r in QUERIES["lat_percentiles"](spark, small).collect()}
    for r in QUERIES["lat_percentiles_approx"](spark, small).collect():
        assert abs(r.p90 - exact[r.event_type].p90) <= 0.05 * abs(exact[r.event_type].p90) + 1


def test_new_order_lines_make_one_text(spark, small, tmp_path):
    """An item goes into the join with its price alone, and any district has its text."""
    for name in ("orders", "lineitem", "supplier", "part"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{small}/{name}.parquet")
    customers = spark.read.parquet(f"{small}/customer.parquet")
    customers.withColumn("c_nationkey", (F.col("c_nationkey") + 30).cast("int")).write.parquet(str(tmp_path / "customer.parquet"))
    rows = QUERIES["tpcc_new_order_lines"](spark, str(tmp_path))
    assert "array(" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert_same(rows, connect(str(tmp_path)), SQL["tpcc_new_order_lines"])
