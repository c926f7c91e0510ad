"""Exact search over vectors: stated queries, in blocks, against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK, SLICE = 1024, 1024


def cosine_top_k(queries: DataFrame, rows: DataFrame, ident: str, vector: str, k: int) -> DataFrame:
    """(id, r_id, cosine): each query's k most similar other rows (ties by id).

    Queries are sent in blocks of BLOCK; each task goes through its rows in slices and keeps its k best a query, so it
    holds BLOCK x SLICE similarities at a time, and what is shuffled are k rows a query and task.
    """
    spark = queries.sparkSession
    schema = f"{ident} long, r_{ident} long, cosine double"
    out = spark.createDataFrame([], schema)
    block: list = []

    def search(block: list) -> DataFrame:
        ids = np.array([r[0] for r in block])
        sent = spark.sparkContext.broadcast((ids, _unit(np.array([r[1] for r in block], dtype=float))))

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            best, near = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            for part in parts:
                part = part[part[vector].notna()]
                for low in range(0, len(part), SLICE):
                    some = part.iloc[low : low + SLICE]
                    own = some[ident].to_numpy(dtype=np.int64)
                    sims = np.round(q @ _unit(np.stack(some[vector].to_numpy()).astype(float)).T, 12)
                    sims[ids[:, None] == own[None]] = -np.inf
                    best, near = _merge(best, near, sims, own, k)
            found = np.isfinite(best)
            at, _ = np.nonzero(found)
            yield pd.DataFrame({ident: ids[at], f"r_{ident}": near[found], "cosine": best[found]})

        return rows.select(ident, vector).mapInPandas(run, schema)

    for row in queries.select(ident, vector).where(F.col(vector).isNotNull()).toLocalIterator():
        block.append(row)
        if len(block) == BLOCK:
            out, block = out.unionByName(search(block)), []
    if block:
        out = out.unionByName(search(block))
    best = W.partitionBy(ident).orderBy(F.desc("cosine"), f"r_{ident}")
    return out.withColumn("__k", F.row_number().over(best)).where(F.col("__k") <= k).drop("__k")


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _merge(best: np.ndarray, near: np.ndarray, sims: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of those held and a slice's, equal ones by id.  Only rows that reach the k-th best of the slice are sorted."""
    if sims.shape[1] > k:
        floor = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
        sims = np.where(sims >= np.maximum(floor, best[:, -1:]), sims, -np.inf)
        keep = np.isfinite(sims).any(0)
        sims, own = sims[:, keep], own[keep]
    both = np.concatenate([best, sims], axis=1)
    ids = np.concatenate([near, np.broadcast_to(own, sims.shape)], axis=1)
    at = np.lexsort((ids, -both), axis=1)[:, :k]
    return np.take_along_axis(both, at, 1), np.take_along_axis(ids, at, 1)
