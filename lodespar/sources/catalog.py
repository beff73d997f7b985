"""Declared tables: names, keys and kinds, bound to Parquet folders."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame, SparkSession

from lodespar.operators.kv import stream_faults


class Kind(Enum):
    ORDERED = "ordered"  # range-partitioned and sorted by its key
    HASH = "hash"  # bucketed by its key
    APPEND = "append"  # no order but that of its columns


@dataclass(frozen=True)
class TableSpec:
    name: str
    keys: tuple[str, ...]
    unique: bool = True
    kind: Kind = Kind.ORDERED
    secondary_of: str | None = None


class ContainerExists(ValueError):
    pass


class ContainerNotFound(KeyError):
    pass


class OutOfOrder(ValueError):
    pass


class Catalog:
    """Containers by name. Creating and dropping takes effect at once and isn't part of any batch."""

    def __init__(self, *specs: TableSpec):
        self._specs: dict[str, TableSpec] = {}
        for x in specs:
            self.create(x)

    def create(self, spec: TableSpec) -> None:
        if spec.name in self._specs:
            raise ContainerExists(spec.name)
        if spec.secondary_of and spec.secondary_of not in self._specs:
            raise ContainerNotFound(spec.secondary_of)
        self._specs[spec.name] = spec

    def drop(self, name: str) -> None:
        if name not in self._specs:
            raise ContainerNotFound(name)
        if any(x.secondary_of == name for x in self._specs.values()):
            raise ContainerExists(f"{name} has secondary tables")
        del self._specs[name]

    def __getitem__(self, name: str) -> TableSpec:
        if name not in self._specs:
            raise ContainerNotFound(name)
        return self._specs[name]

    def list(self) -> list[TableSpec]:
        return list(self._specs.values())

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(k, x.name, list(x.keys), x.unique, x.kind.value, x.secondary_of) for k, x in enumerate(self.list())]
        spark.createDataFrame(rows, "id int, name string, keys array<string>, unique boolean, kind string, secondary_of string").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        """The saved containers, in the order of their creation."""
        return cls(*(TableSpec(x.name, tuple(x.keys), x.unique, Kind(x.kind), x.secondary_of) for x in spark.read.parquet(path).orderBy("id").collect()))


#: The tables that the workloads run on.
WORKLOAD = (
    TableSpec("region", ("r_regionkey",)),
    TableSpec("nation", ("n_nationkey",)),
    TableSpec("customer", ("c_custkey",)),
    TableSpec("customer_by_nation", ("c_nationkey", "c_name"), False, Kind.ORDERED, "customer"),
    TableSpec("supplier", ("s_suppkey",)),
    TableSpec("part", ("p_partkey",), True, Kind.HASH),
    TableSpec("orders", ("o_orderkey",)),
    TableSpec("orders_by_customer", ("o_custkey", "o_orderkey"), True, Kind.ORDERED, "orders"),
    TableSpec("lineitem", ("l_orderkey", "l_linenumber"), False),
    TableSpec("events", ("event_id",), True, Kind.APPEND),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_ordered(df: DataFrame, path: str, *keys: str, partitions: int | None = None) -> None:
    """Files that each hold one range of the key, sorted, so that range filters skip files and row groups."""
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def bulk_load(stream: DataFrame, path: str, keys: list[str], order: list[str], unique: bool = True) -> None:
    """Write a ``stream`` that, in ``order``, must already be sorted by its key; OutOfOrder, and nothing is written, if it isn't."""
    found = stream_faults(stream, keys, order).first()
    if found.n_below or (unique and found.n_repeats):
        raise OutOfOrder(f"{found.n_below} keys below the one before, {found.n_repeats} repeated")
    write_ordered(stream, path, *keys)


def write_bucketed(df: DataFrame, name: str, buckets: int, *keys: str) -> None:
    """A saved table bucketed and sorted by its key: joins and groupings on the key need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
