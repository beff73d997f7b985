"""Secondary tables: derived, joined to their primary, looked up by name, checked against their primary and repaired."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def derive(primary: DataFrame, secondary_key: list[str], primary_key: list[str]) -> DataFrame:
    return primary.select(*secondary_key, *primary_key)


def lookup(secondary: DataFrame, primary: DataFrame, primary_key: list[str]) -> DataFrame:
    """Each secondary row with its primary row; Spark broadcasts either side only if it is small."""
    return secondary.join(primary, primary_key)


def middle_row(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Of each group, the row at place ceil(n / 2) in ``order``."""
    w = Window.partitionBy(*group)
    numbered = rows.select(F.struct("*").alias("row"), F.row_number().over(w.orderBy(*order)).alias("place"), F.count("*").over(w).alias("of"))
    return numbered.where(F.col("place") == F.ceil(F.col("of") / 2)).select("row.*")


def lookup_middle(asked: DataFrame, primary: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Each request's (``by`` and any others) middle row, in ``order``, of the primary's rows that equal it in ``by``; none gives nulls.

    A lookup through a secondary key that isn't unique, such as a last name: only names asked for are ordered, each once."""
    wanted = primary.join(asked.select(*by).distinct(), by, "left_semi")
    return asked.join(middle_row(wanted, by, order), by, "left")


def verify(second: DataFrame, primary: DataFrame, key: str, primary_key: str) -> DataFrame:
    """Each entry's state: ``ok``, ``stale`` (the primary row has another key), ``dangling`` (no primary row), ``missing`` (no entry).

    Columns: primary_key, key (as the primary has it), stored (as the secondary has it), state."""
    entries = second.select(primary_key, F.col(key).alias("stored"), F.lit(True).alias("entry"))
    both = entries.join(primary.select(primary_key, key, F.lit(True).alias("there")), primary_key, "full_outer")
    state = F.when(F.col("there").isNull(), "dangling").when(F.col("entry").isNull(), "missing").when(F.col("stored").eqNullSafe(F.col(key)), "ok").otherwise("stale")
    return both.select(primary_key, key, "stored", state.alias("state"))


def repair(checked: DataFrame, key: str, primary_key: str, only: DataFrame | None = None) -> DataFrame:
    """The entries after repair: stale ones renewed, dangling ones gone, missing ones added; ``only``: of these primary keys.

    Columns: primary_key, key, repaired. ``checked`` is what ``verify`` gives."""
    wrong = F.col("state") != "ok"
    if only is not None:
        checked = checked.join(only.select(primary_key).distinct().withColumn("asked", F.lit(True)), primary_key, "left")
        wrong = wrong & F.coalesce("asked", F.lit(False))
    fixed = checked.withColumn("repaired", wrong)
    stays = F.when(F.col("repaired"), F.col("state") != "dangling").otherwise(F.col("state") != "missing")
    return fixed.where(stays).select(primary_key, F.when(F.col("repaired"), F.col(key)).otherwise(F.col("stored")).alias(key), "repaired")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Rows added, removed, changed (another value) and kept between two snapshots."""
    both = before.select(key, F.col(value).alias("a"), F.lit(True).alias("was")).join(after.select(key, F.col(value).alias("b"), F.lit(True).alias("is")), key, "full_outer")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "kept").otherwise("changed")
    return both.groupBy(kind.alias("change")).agg(F.count("*").alias("n_rows"))
