"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word pattern of the contracts: runs of anything but U+0020 and U+0009..U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"


def trim() -> None:
    """Gives memory that a worker no longer uses back to the system, where the C library can."""
    pa.set_memory_pool(pa.system_memory_pool())
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; one of this machine's only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="ledgerlens-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, what: str, batch_rows: int = 1000) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it back.

    While it writes, Arrow batches hold at most batch_rows rows, so that rows of long texts stay small.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(batch_rows, int(before)) if int(before) > 0 else batch_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    # later reads need the files: those that nobody drops go with the application
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


#: Tables that written() made and nobody dropped yet.
_WRITTEN: list[str] = []


def drop(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes written tables that nothing reads any more."""
    for path in list(paths):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if path in _WRITTEN:
            _WRITTEN.remove(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that written() returned and nothing reads any more."""
    for t in tables:
        drop(t.sparkSession, [t._written_path])


def since(mark: int) -> list[str]:
    """Paths of the tables written after the first mark of them."""
    return _WRITTEN[mark:]


def without(df: DataFrame, names: Iterable[str]) -> list[Column]:
    """The columns of df whose names (in any case) are not among those that an operator makes."""
    made = {n.lower() for n in names}
    return [df[f"`{c}`"] for c in df.columns if c.lower() not in made]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
