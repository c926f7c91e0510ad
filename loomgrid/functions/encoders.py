"""Categorical encodings learned by grouped aggregation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import col


def categories(df: DataFrame, name: str, most: int = 10_000) -> list:
    """The sorted categories; an error beyond ``most``, since they come to the driver."""
    found = [r[0] for r in df.select(name).where(F.col(name).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{name} has more than {most} categories")
    return sorted(found)


def one_hot(name: str, values: list) -> dict[str, Column]:
    """One 0/1 column a category; a value not among them has zeros only."""
    return {f"{name}_{v}": F.when(F.col(name) == v, 1.0).otherwise(0.0) for v in values}


def partitions(values: list) -> list[tuple]:
    """Every split of 3 or 4 categories in two, named by its smaller side (of equal sides the one with the first category)."""
    n = len(values)
    out = []
    for size in range(1, n // 2 + 1):
        for part in combinations(values, size):
            if 2 * size < n or values[0] in part:
                out.append(part)
    return out


def partition_indicators(name: str, values: list) -> dict[str, Column]:
    return {f"{name}_in_{'_'.join(map(str, p))}": F.when(F.col(name).isin(list(p)), 1.0).otherwise(0.0) for p in partitions(values)}


def ordinal_map(df: DataFrame, name: str) -> DataFrame:
    """(category, code): the rank in sorted order, of any number of categories."""
    from loomgrid.operators.ordered import by_order

    distinct = df.select(F.col(name).alias("category")).where("category IS NOT NULL").distinct()
    return by_order(distinct, "category", "code").select("category", F.col("code").cast("int").alias("code"))


def lookup(df: DataFrame, mapping: DataFrame, name: str, value: str, unknown) -> DataFrame:
    """``df`` with the mapping's value for the category, or ``unknown``."""
    named = mapping.select(F.col("category").alias("__category"), F.col(value))
    return df.join(named, F.col(name) == F.col("__category"), "left").withColumn(value, F.coalesce(F.col(value), F.lit(unknown))).drop("__category")


def target_means(df: DataFrame, name: str, y: str, weight=1.0, smoothing: float = 10.0) -> DataFrame:
    """(category, target_mean): the weighted mean, smoothed towards the weighted mean of all rows."""
    w = col(weight) if isinstance(weight, str) else F.lit(float(weight))
    rows = df.select(F.col(name).alias("category"), w.alias("w"), (w * F.col(y)).alias("wy"))
    everything = rows.agg((F.sum("wy") / F.sum("w")).alias("g"))
    return rows.groupBy("category").agg(F.sum("w").alias("sw"), F.sum("wy").alias("swy")).crossJoin(F.broadcast(everything)).select("category", ((F.col("swy") + smoothing * F.col("g")) / (F.col("sw") + smoothing)).alias("target_mean"))


def leave_one_out(df: DataFrame, name: str, y: str, weight=1.0, smoothing: float = 10.0) -> DataFrame:
    """``df`` with each row's target mean of the other rows of its category, smoothed as in ``target_means``."""
    w = col(weight) if isinstance(weight, str) else F.lit(float(weight))
    everything = df.agg((F.sum(w * F.col(y)) / F.sum(w)).alias("__g"))
    sums = df.groupBy(F.col(name).alias("__c")).agg(F.sum(w).alias("__sw"), F.sum(w * F.col(y)).alias("__swy"))
    out = df.join(sums, F.col(name).eqNullSafe(F.col("__c"))).crossJoin(F.broadcast(everything))
    value = (F.col("__swy") - w * F.col(y) + smoothing * F.col("__g")) / (F.col("__sw") - w + smoothing)
    return out.withColumn("target_mean", value).drop("__c", "__sw", "__swy", "__g")
