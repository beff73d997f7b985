"""Transactions as batches: operations are folded key by key, and a batch is applied whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodespar.operators.kv import EXISTS, NOT_FOUND, OK


def fold(table: DataFrame, ops: DataFrame, key: str, seq: str = "seq", op: str = "op", value: str = "v", step: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """The table after ``ops`` (seq, op in insert/update/delete/upsert, key, value), and seq, key, op, status of each.

    Each key's operations take effect in sequence order. Whether a key is there changes only with an operation that
    succeeds: insert and upsert leave it there, delete leaves it gone, update leaves it as it is. So it is there before
    an operation if the last earlier one that sets it (any insert, upsert or delete: a failed insert finds the key there,
    a failed delete finds it gone) was not a delete, or, without one, if the table has it.

    A key's operations are put in order within ``step`` numbers of sequence only; what the earlier ranges leave is one row for
    each of them. So a key with a large part of all operations is many tasks' work."""
    sets = F.when(F.col(op).isin("insert", "upsert"), True).when(F.col(op) == "delete", False)
    ranged = ops.withColumn("seq_range", F.floor(F.col(seq) / step))
    left_by = ranged.groupBy(key, "seq_range").agg(F.max_by(sets, F.when(sets.isNotNull(), F.col(seq))).alias("leaves"))
    earlier = Window.partitionBy(key).orderBy("seq_range").rowsBetween(Window.unboundedPreceding, -1)
    left_by = left_by.select(key, "seq_range", F.last("leaves", ignorenulls=True).over(earlier).alias("earlier"))
    within = Window.partitionBy(key, "seq_range").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    marked = ranged.join(left_by, [key, "seq_range"]).withColumn("before", F.coalesce(F.last(sets, ignorenulls=True).over(within), "earlier")).drop("seq_range", "earlier")
    base = table.select(key, F.col(value).alias("old"), F.lit(True).alias("present"))
    marked = marked.join(base, key, "left").withColumn("there", F.coalesce("before", "present", F.lit(False)))
    status = F.when((F.col(op) == "insert") & F.col("there"), EXISTS).when(F.col(op).isin("update", "delete") & ~F.col("there"), NOT_FOUND).otherwise(OK)
    marked = marked.withColumn("status", status)
    net = marked.where(F.col("status") == OK).groupBy(key).agg(F.max_by(op, seq).alias("last_op"), F.max_by(F.col(value), F.col(seq)).alias("new"))
    after = table.select(key, value).join(net, key, "full_outer")
    after = after.where(F.coalesce(F.col("last_op") != "delete", F.lit(True))).select(key, F.when(F.col("last_op").isNotNull(), F.col("new")).otherwise(F.col(value)).alias(value))
    return after, marked.select(seq, key, op, "status")


def transact(table: DataFrame, ops: DataFrame, key: str, txn: str = "txn", aborted: DataFrame | None = None, **names) -> DataFrame:
    """The table after the operations of all transactions but the ``aborted`` ones, of which nothing remains."""
    kept = ops if aborted is None else ops.join(aborted, txn, "left_anti")
    return fold(table, kept, key, **names)[0]


def lock_conflicts(locks: DataFrame, key: str, txn: str = "txn", exclusive: str = "exclusive") -> DataFrame:
    """For each key that at least one transaction locks exclusively and others lock too: how many share it, and the pairs that conflict.

    A pair conflicts if one of the two is exclusive; pairs are counted, not listed. A transaction's strongest mode counts."""
    mode = locks.groupBy(key, txn).agg(F.max(F.col(exclusive).cast("int")).alias("x"))
    by_key = mode.groupBy(key).agg(F.count("*").alias("n_txns"), F.sum("x").cast("long").alias("n_exclusive"))
    n, x = F.col("n_txns"), F.col("n_exclusive")
    pairs = (n * (n - 1) / 2 - (n - x) * (n - x - 1) / 2).cast("long")
    return by_key.where((x > 0) & (n > 1)).withColumn("n_conflicts", pairs)
