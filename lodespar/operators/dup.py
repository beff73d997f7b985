"""Tables whose key repeats, and append-only heaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append_suffix(table: DataFrame, *keys: str, order: list[str], name: str = "suffix", coarse: Column | None = None) -> DataFrame:
    """Each row's number among those of its key, from 0, in ``order``.

    A key's rows are sorted together, spilling as needed. With ``coarse``, which must not fall as ``order`` goes on (a day, for
    times), only those equal in it are; what comes before them is counted, by key and ``coarse``, and added."""
    if coarse is None:
        return table.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    rows = table.withColumn("coarse_of_row", coarse)
    at = [*keys, "coarse_of_row"]
    counts = rows.groupBy(*at).agg(F.count("*").alias("rows_of_range"))
    before = F.sum("rows_of_range").over(Window.partitionBy(*keys).orderBy("coarse_of_row")) - F.col("rows_of_range")
    rows = rows.withColumn(name, F.row_number().over(Window.partitionBy(*at).orderBy(*order)) - 1)
    return rows.join(counts.select(*at, before.alias("rows_before")), at).withColumn(name, F.col(name) + F.col("rows_before")).drop("coarse_of_row", "rows_before").select(*table.columns, name)


def scan_key(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(F.col(key) == value)


def scan_range(table: DataFrame, key: str, low, high) -> DataFrame:
    """A scan of a repeating key includes both ends."""
    return table.where(F.col(key).between(low, high))


def cursor_range(table: DataFrame, key: str, low, high) -> DataFrame:
    """A cursor of a repeating key leaves out the upper end."""
    return table.where((F.col(key) >= low) & (F.col(key) < high))


def append(heap: DataFrame, rows: DataFrame) -> DataFrame:
    return heap.unionByName(rows)


def bucket_of(key: Column, buckets: int) -> Column:
    """A bucket that an equal formula in any SQL engine gives."""
    return F.pmod(key * 2654435761 + 12345, F.lit(buckets)).cast("int")


def bucket_stats(table: DataFrame, key: str, buckets: int) -> DataFrame:
    """Rows and distinct keys of each bucket."""
    return table.groupBy(bucket_of(F.col(key), buckets).alias("bucket")).agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"))
