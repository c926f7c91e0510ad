"""Shared helpers: table access and tables written to the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], column: str | int, rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice has at most ``rows`` rows, and ``size`` bytes in ``column`` unless it is one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            stop = min(at + rows, max(at + 1, most), batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop


def numbered_columns(df: DataFrame, *names: str) -> tuple[DataFrame, list[str], list[str]]:
    """``df`` with columns c0, c1... instead of names that Spark may read as paths; the old names; the given ones' new names."""
    old = df.columns
    return df.toDF(*[f"c{k}" for k in range(len(old))]), old, [f"c{old.index(n)}" for n in names]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put before them until no column of ``df`` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts go to Python in batches of 1000 rows, where the session has Spark's default of 10,000: a batch is held by the
    executor's process and by the worker at once.  Results don't depend on it."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only for a local master without that setting."""
    global _LOCAL_DIR
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _LOCAL_DIR is None or not os.path.isdir(_LOCAL_DIR):
        _LOCAL_DIR = tempfile.mkdtemp(prefix="loomgrid-")
    return "file://" + _LOCAL_DIR


_HOLDERS: dict[str, Callable[[], None]] = {}


def claim(name: str, free: Callable[[], None]) -> None:
    """Called by an operator in a worker process before it remembers words: frees what other operators remember there.

    Workers are reused from stage to stage, so without this a pipeline's memory would be the sum of its stages'.
    """
    for other in [k for k in _HOLDERS if k != name]:
        _HOLDERS.pop(other)()
    _give_back()
    _HOLDERS[name] = free


def _give_back() -> None:
    """Hands memory that earlier tasks freed back to the system, where the libraries can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Scratch:
    """Tables written to the shared folder to cut lineage; every executor can read them again."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: list[str] = []

    def save(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        """Write ``df`` and return it as read back."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self._paths.append(path)
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that nothing reads any more."""
        self._delete(df._scratch_path)

    def keep(self, *tables: DataFrame) -> None:
        """Delete all saved tables but these."""
        wanted = {t._scratch_path for t in tables}
        for path in [p for p in self._paths if p not in wanted]:
            self._delete(path)

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self._paths = [p for p in self._paths if p != where]
