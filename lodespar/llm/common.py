"""What the operators of this subpackage share: the shared folder, checkpoints, and Arrow helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where it is unset and all run in one process (tests), a folder below the temporary one serves; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or f"file://{tempfile.gettempdir()}/checkpoints/{os.getpid()}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor never loses it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each application.

    Where its folder is on PYTHONPATH, workers have it already; else Spark hands an archive of it to all of them."""
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    if context.applicationId in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = Path(tempfile.mkdtemp()) / "lodespar.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted((root / "lodespar").rglob("*.py")):
            z.write(path, path.relative_to(root))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def in_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)``, with this package at hand in the workers; for ``df.transform``."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str):
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def held_out(doc_id: str = "doc_id"):
    """True for the quarter of the documents that no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def unit_hash(*columns):
    """A number in [0, 1) that depends on the row alone: the same after any retry."""
    return (F.xxhash64(*columns).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).cast("double")


def text_hash(text: str, buckets: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % buckets


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]
