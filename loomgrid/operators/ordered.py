"""Running sums and row numbers over a whole table without a single-task window.

Values are cut at approximate quantiles into buckets; each bucket is ordered in a task of its own, and starts
from the sums of the buckets before it, which are a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STEP = 32  # edges between two of the first search
ROWS_A_TASK = 500_000


def tasks_of(df: DataFrame) -> int:
    """As many tasks as hold ROWS_A_TASK rows each, and no fewer than there are cores."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK))


def dealt(df: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """``df`` dealt by keys to ``tasks_of`` it: a task's sorts hold as many rows however many there are, where Spark's own
    number of tasks stays or shrinks by the size of compressed blocks."""
    return df.repartition(tasks or tasks_of(df), *keys)

def bucket_of(df: DataFrame, value: str, buckets: int = 64) -> Column:
    """The value's bucket, rising with it; equal values share one.

    The value is worked out once and not once an edge; many edges are searched in two steps."""
    edges = sorted({float(e) for e in df.approxQuantile(value, [i / buckets for i in range(1, buckets)], 0.005)})
    if not edges:
        return F.lit(0)
    every = F.array(*[F.lit(e) for e in edges])
    below = lambda some, v: F.size(F.filter(some, lambda e: e < v))
    if len(edges) <= 2 * STEP:
        return F.transform(F.array(F.col(value)), lambda v: below(every, v))[0]
    coarse = F.array(*[F.lit(e) for e in edges[STEP - 1 :: STEP]])
    first = F.transform(F.array(F.col(value)), lambda v: F.struct(v.alias("v"), (below(coarse, v) * STEP).alias("n")))
    return F.transform(first, lambda c: c["n"] + below(F.slice(every, c["n"] + 1, STEP), c["v"]))[0]


def running(df: DataFrame, value: str, sums: dict[str, Column], ties: tuple[str, ...] = (), descending: bool = False, buckets: int = 64) -> DataFrame:
    """``df`` with inclusive running sums by ``value``, then ``ties``: a column a name."""
    rows = df.withColumn("__b", -bucket_of(df, value, buckets) if descending else bucket_of(df, value, buckets))
    heads = rows.groupBy("__b").agg(*[F.sum(c).alias(f"__{k}") for k, c in sums.items()])
    before = W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)  # a row a bucket
    heads = heads.select(F.col("__b").alias("__c"), *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}") for k in sums])
    order = W.partitionBy("__b").orderBy(F.desc(value) if descending else F.asc(value), *ties).rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(F.broadcast(heads), F.col("__b") == F.col("__c"))
    out = out.withColumns({k: F.sum(c).over(order) + F.col(f"__{k}") for k, c in sums.items()})
    return out.drop("__b", "__c", *[f"__{k}" for k in sums])


def numbered(df: DataFrame, value: str, ties: tuple[str, ...] = (), name: str = "i") -> DataFrame:
    """``df`` with its row number from 0 in the order of ``value``, then ``ties``."""
    return running(df, value, {name: F.lit(1).cast("long")}, ties).withColumn(name, F.col(name) - 1)


def exact_quantile(df: DataFrame, value: str, weight: Column, level: float) -> float | None:
    """The least value at which the running weight reaches ``level`` of all weight; values are grouped, then summed in ranges."""
    rows = df.select(F.col(value).cast("double").alias("v"), weight.cast("double").alias("w")).where("v IS NOT NULL").groupBy("v").agg(F.sum("w").alias("w"))
    all_weight = rows.agg(F.sum("w")).first()[0]
    if all_weight is None:
        return None
    sums = running(rows, "v", {"upto": F.col("w")})
    return sums.agg(F.min(F.when(F.col("upto") >= level * all_weight - 1e-9 * abs(all_weight), F.col("v")))).first()[0]


def by_order(df: DataFrame, value: str, name: str = "i") -> DataFrame:
    """``df``, whose values of any orderable type are distinct, with their place from 0: rows are dealt to tasks by ranges of
    the value, placed there, and start from the counts of the ranges before, a row each."""
    from loomgrid.sources.shared import Tables

    dealt = Tables(df.sparkSession, "order").save(df.repartitionByRange(value).withColumn("__part", F.spark_partition_id()))
    heads = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row a task
    heads = heads.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    here = F.row_number().over(W.partitionBy("__part").orderBy(value)) - 1
    rows = dealt.withColumn("__here", here).join(F.broadcast(heads), F.col("__part") == F.col("__p"))
    return rows.withColumn(name, F.col("__here") + F.col("__start")).drop("__part", "__p", "__here", "__start")
