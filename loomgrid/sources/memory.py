"""Tables held by the driver's process, as DataFrames: Arrow, pandas, NumPy, and what can give Arrow (DuckDB, Polars).

They are as large as the process that made them, so they travel as one Arrow table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def from_arrow(spark: SparkSession, rows: pa.Table) -> DataFrame:
    return spark.createDataFrame(rows)


def from_pandas(spark: SparkSession, rows) -> DataFrame:
    return from_arrow(spark, pa.Table.from_pandas(rows, preserve_index=False))


def from_numpy(spark: SparkSession, matrix, names: list[str] | None = None, y=None, weight=None) -> DataFrame:
    """A row a row of the matrix, as doubles named f0, f1... or as given, with ``y`` and ``weight`` where they are."""
    matrix = np.asarray(matrix, dtype=float)
    if matrix.ndim != 2:
        raise ValueError("a matrix has two dimensions")
    names = names or [f"f{k}" for k in range(matrix.shape[1])]
    cols = {n: matrix[:, k] for k, n in enumerate(names)} | {n: np.asarray(v, float) for n, v in (("y", y), ("w", weight)) if v is not None}
    if len({len(v) for v in cols.values()}) > 1:
        raise ValueError("columns differ in length")
    return from_arrow(spark, pa.table({n: pa.array(v) for n, v in cols.items()}))


def from_relation(spark: SparkSession, relation) -> DataFrame:
    """A DuckDB relation, a Polars frame, or anything else with a method that gives an Arrow table."""
    for name in ("to_arrow_table", "to_arrow", "fetch_arrow_table", "arrow"):
        if give := getattr(relation, name, None):
            rows = give()
            return from_arrow(spark, rows.read_all() if isinstance(rows, pa.RecordBatchReader) else rows)
    raise TypeError(f"{type(relation).__name__} gives no Arrow table")
