"""Key-value operators over whole tables: batches of keys or rows against a table with a unique key.

A batch has a sequence column where its order matters. Instead of an error for a call, each operation gets a
status: ``ok``, ``key_exists`` or ``key_not_found``."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespar.functions.keys import half_open

OK, EXISTS, NOT_FOUND = "ok", "key_exists", "key_not_found"


def get(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The table's row for each of ``keys``, with ``status``."""
    found = table.withColumn("found", F.lit(True))
    return keys.join(found, key, "left").withColumn("status", F.when(F.col("found"), OK).otherwise(NOT_FOUND)).drop("found")


def insert(table: DataFrame, batch: DataFrame, key: str, seq: str) -> tuple[DataFrame, DataFrame]:
    """The table with the batch's new keys, and seq, key, status of each operation. The first of equal keys wins."""
    first = batch.groupBy(key).agg(F.min(seq).alias("first_seq"))
    present = table.select(key).withColumn("present", F.lit(True))
    marked = batch.join(first.join(present, key, "left"), key)
    won = F.col("present").isNull() & (F.col(seq) == F.col("first_seq"))
    status = marked.select(seq, key, F.when(won, OK).otherwise(EXISTS).alias("status"))
    added = marked.where(won).select(*table.columns)
    return table.unionByName(added), status


def last_of(batch: DataFrame, key: str, seq: str, *values: str) -> DataFrame:
    """The values of the operation with the highest sequence number of each key."""
    return batch.groupBy(key).agg(*(F.max_by(v, seq).alias(v) for v in values))


def update(table: DataFrame, batch: DataFrame, key: str, seq: str, *values: str) -> DataFrame:
    """The table with the batch's last values for keys that it has."""
    new = last_of(batch, key, seq, *values).select(key, F.struct(*values).alias("new"))
    joined = table.join(new, key, "left")
    return joined.select(*(F.when(F.col("new").isNotNull(), F.col(f"new.{x}")).otherwise(F.col(x)).alias(x) if x in values else F.col(x) for x in table.columns))


def update_status(table: DataFrame, batch: DataFrame, key: str, seq: str) -> DataFrame:
    present = table.select(key).withColumn("present", F.lit(True))
    return batch.join(present, key, "left").select(seq, key, F.when(F.col("present"), OK).otherwise(NOT_FOUND).alias("status"))


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys, key, "left_anti")


def upsert(table: DataFrame, batch: DataFrame, key: str, seq: str, value: str, old: str | None = None) -> DataFrame:
    """Insert or replace: the last value of each key; with ``old``, a column of that name has the value before."""
    new = last_of(batch, key, seq, value).select(key, F.col(value).alias("new"), F.lit(True).alias("given"))
    joined = table.select(key, value).join(new, key, "full_outer")
    out = [F.col(key), F.when(F.col("given"), F.col("new")).otherwise(F.col(value)).alias(value)]
    return joined.select(*out, *([F.when(F.col("given"), F.col(value)).alias(old)] if old else []))


def upsert_merge(table: DataFrame, batch: DataFrame, key: str, value: str, combine: Callable[[Column], Column], merge: Callable[[Column, Column], Column]) -> DataFrame:
    """Insert or merge with an associative function: ``combine`` aggregates the batch, ``merge(old, new)`` joins it to the table."""
    new = batch.groupBy(key).agg(combine(F.col(value)).alias("new"))
    joined = table.select(key, value).join(new, key, "full_outer")
    both = F.col(value).isNotNull() & F.col("new").isNotNull()
    return joined.select(key, F.when(both, merge(F.col(value), F.col("new"))).otherwise(F.coalesce(value, "new")).alias(value))


def upsert_fold(table: DataFrame, batch: DataFrame, key: str, seq: str, value: str, merge: Callable[[Column, Column], Column], step: int = 100_000) -> DataFrame:
    """Insert or merge with an associative function that needn't commute: operations are folded in sequence order.

    First each key's operations within ``step`` numbers of sequence, then these ranges' results: no array has more than ``step``
    operations, or a result for each range. A function that isn't associative goes through ``fold_in_order``."""

    def fold(rows: DataFrame, at: Column, *by: Column | str) -> DataFrame:
        ops = rows.groupBy(key, *by).agg(F.array_sort(F.collect_list(F.struct(at.alias("s"), F.col(value).alias("v")))).alias("ops"))
        rest = F.slice("ops", 2, F.greatest(F.size("ops") - 1, F.lit(0)))
        return ops.withColumn(value, F.aggregate(rest, F.get("ops", F.lit(0))["v"], lambda a, x: merge(a, x["v"]))).drop("ops")

    ranges = fold(batch.select(key, seq, value), F.col(seq), F.floor(F.col(seq) / step).alias("range"))
    new = fold(ranges, F.col("range")).select(key, F.col(value).alias("new"), F.lit(True).alias("given"))
    joined = table.select(key, value, F.lit(True).alias("had")).join(new, key, "full_outer")
    both = F.col("had") & F.col("given")
    return joined.select(key, F.when(both, merge(F.col(value), F.col("new"))).when(F.col("given"), F.col("new")).otherwise(F.col(value)).alias(value))


def fold_in_order(rows: DataFrame, key: str, order: Sequence[str], start: str, value: str, step: Callable[[int, int], int], name: str = "state") -> DataFrame:
    """For each key, ``step(state, value)`` over its rows in ``order``, from its first row's ``start``; all are longs.

    Rows are sorted within hash partitions of the key, spilling as needed, and stream by: a task holds one state, however many
    rows a key has. For functions that aren't associative."""
    sorted_rows = rows.select(key, *order, start, value).repartition(key).sortWithinPartitions(key, *order).select(key, start, value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, none = None, 0, True
        for batch in batches:
            found = []
            for k, s, v in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if none or k != held:
                    if not none:
                        found.append((held, state))
                    held, state, none = k, s, False
                state = step(state, v)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=[key, name])
        if not none:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (held, state)], names=[key, name])

    return sorted_rows.select(*(F.col(x).cast("long").alias(x) for x in (key, start, value))).mapInArrow(run, f"`{key}` long, `{name}` long")


def scan(table: DataFrame, keys: Sequence[str], where: Column | None = None, low=None, high=None) -> DataFrame:
    """Rows with low <= first key < high that ``where`` holds for, in key order."""
    return table.where(half_open(F.col(keys[0]), low, high) & (F.lit(True) if where is None else where)).orderBy(*keys)


def page(table: DataFrame, keys: Sequence[str], size: int, after: Sequence | None = None) -> DataFrame:
    """The next ``size`` rows in key order after the key ``after``: a cursor that can be resumed.

    The first key's bound reaches the scan, which skips what lies before it; each task keeps ``size`` rows at most."""
    if after is not None:
        table = table.where(F.col(keys[0]) >= after[0]).where(F.struct(*keys) > F.struct(*(F.lit(x).alias(k) for k, x in zip(keys, after, strict=True))))
    return table.orderBy(*keys).limit(size)


def bound(table: DataFrame, probes: DataFrame, key: str, probe: str, strict: bool, width: int = 1000, levels: int = 4) -> DataFrame:
    """For each probe, the least key that is not less than it (``strict``: that is greater); null if none.

    Keys are put in nested ranges of ``width``, ``width`` ** 2 ... wide. The own range's keys answer first, else the least key
    of the later ranges within the next wider one, and so on: each step joins on equal ranges and meets at most
    ``width`` rows of summary a probe. Where all later keys are beyond the widest range, a row for each widest range, with the
    next one's least key, answers: keys may be any longs, and rows of that kind are one for each ``width`` ** ``levels`` of keys."""
    at = lambda x, level: F.floor(F.col(x) / width**level)
    asked = probes.select(probe).where(F.col(probe).isNotNull()).distinct()
    after = (F.col(key) > F.col(probe)) if strict else (F.col(key) >= F.col(probe))
    # what each step finds is below what the next one does, so the least of all is the answer
    found = asked.withColumn("r", at(probe, 1)).join(table.select(key, at(key, 1).alias("r")), "r").where(after).select(probe, F.col(key).alias("bound"))
    least = table.groupBy(at(key, 1).alias("child")).agg(F.min(key).alias("least"))
    for level in range(2, levels + 1):
        own = asked.withColumn("r", at(probe, level)).withColumn("own", at(probe, level - 1))
        inner = least.withColumn("r", F.floor(F.col("child") / width))
        found = found.unionByName(own.join(inner, "r").where("child > own").select(probe, F.col("least").alias("bound")))
        least = inner.groupBy(F.col("r").alias("child")).agg(F.min("least").alias("least"))
    # of the widest ranges, those that have keys and those that have probes: few, so one window may order them
    top = asked.select(at(probe, levels).alias("child"), F.lit(None).cast(least.schema["least"].dataType).alias("least")).distinct().unionByName(least)
    top = top.groupBy("child").agg(F.min("least").alias("least"))
    later = top.select(F.col("child").alias("top"), F.min("least").over(Window.orderBy("child").rowsBetween(1, Window.unboundedFollowing)).alias("bound"))
    found = found.unionByName(asked.withColumn("top", at(probe, levels)).join(later, "top").select(probe, "bound"))
    return asked.join(found.groupBy(probe).agg(F.min("bound").alias("bound")), probe, "left")


def rewrite_same_length(table: DataFrame, batch: DataFrame, key: str, value: str) -> DataFrame:
    """Values are replaced in place only by new ones of the same length; others stay."""
    new = batch.select(key, F.col(value).alias("new"))
    joined = table.join(new, key, "left")
    fits = F.coalesce(F.length("new") == F.length(value), F.lit(False))
    return joined.select(*(F.when(fits, F.col("new")).otherwise(F.col(x)).alias(x) if x == value else F.col(x) for x in table.columns))


def order_faults(stream: DataFrame, *keys: str, by: str, order: Sequence[str]) -> DataFrame:
    """For each value of ``by``: rows, rows whose key is below that of the row before in ``order``, and rows whose key equals it.

    What must be none before rows are loaded as a sorted stream; a unique table must have no equal ones either."""
    near = Window.partitionBy(by).orderBy(*order)
    now, before = F.struct(*keys), F.lag(F.struct(*keys)).over(near)
    marked = stream.select(by, (before > now).alias("below"), (before == now).alias("same"))
    return marked.groupBy(by).agg(F.count("*").alias("n_rows"), F.count_if("below").alias("n_below"), F.count_if("same").alias("n_repeats"))


def stream_faults(stream: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row: n_rows, n_below, n_repeats of the whole ``stream`` in ``order``, as in ``order_faults``.

    The stream is cut into ranges of ``order``; each task streams through its own, and what is left is one row a range."""
    ranged = stream.select(*order, F.struct(*(F.col(x).alias(f"k{n}") for n, x in enumerate(keys))).alias("key")).repartitionByRange(*order)
    ranged = ranged.sortWithinPartitions(*order).select(F.spark_partition_id().cast("long").alias("part"), "key")
    kind = ranged.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = part = None
        n = below = same = 0
        for batch in batches:
            for now in zip(*(x.to_pylist() for x in batch.column("key").flatten()), strict=True):
                if n:
                    below, same = below + (now < last), same + (now == last)
                else:
                    first = now
                last, n = now, n + 1
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
        if n:
            names = [f"k{i}" for i in range(len(keys))]
            ends = [pa.array([dict(zip(names, x, strict=True))], batch.schema.field("key").type) for x in (first, last)]
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (part, n, below, same)), *ends], names=["part", "n", "below", "same", "first", "last"])

    parts = ranged.mapInArrow(run, f"part long, n long, below long, same long, first {kind}, last {kind}")
    before = F.lag("last").over(Window.orderBy("part"))  # one row a range
    joined = parts.select("n", "below", "same", (before > F.col("first")).alias("b"), (before == F.col("first")).alias("s"))
    total = lambda c, more: (F.coalesce(F.sum(c), F.lit(0)) + F.count_if(more)).cast("long")
    return joined.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), total("below", "b").alias("n_below"), total("same", "s").alias("n_repeats"))


def range_stats(table: DataFrame, key: str, size: Column, width: int) -> DataFrame:
    """How evenly rows and their ``size`` spread over key ranges of ``width``: ranges, rows, and the least, mean and greatest rows and bytes of one."""
    by = table.groupBy(F.floor(F.col(key) / width).alias("range")).agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("used"))
    each = [f(x).alias(f"{y}_{z}") for x, z in (("n", "rows"), ("used", "bytes")) for f, y in ((F.min, "min"), (F.max, "max"))]
    return by.agg(F.count("*").alias("n_ranges"), F.sum("n").alias("n_rows"), *each, (F.sum("used") / F.count("*")).alias("mean_bytes"))
