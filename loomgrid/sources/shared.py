"""Tables written to the folder that all executors share, to cut lineage so that a lost executor costs a reread only."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only for a local master without that setting."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL or not os.path.isdir(_LOCAL[0]):
        _LOCAL[:] = [tempfile.mkdtemp(prefix="loomgrid-")]
    return "file://" + _LOCAL[0]


class Tables:
    """Written tables of one computation."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self) -> str:
        """A path that nothing was written to."""
        self._n += 1
        return f"{self.root}/{self._n}"

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it as read back."""
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._shared_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that nothing reads any more; others are left alone."""
        if where := getattr(df, "_shared_path", None):
            self._delete(where)

    def close(self) -> None:
        """Delete all tables."""
        self._delete(self.root)

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
