"""Input views of the queries, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.sources.tables import table


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, ts, y, n): events by type and day."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id"), F.to_date("ts").alias("ts")).agg(F.sum("value").alias("y"), F.count(F.lit(1)).alias("n"))


DAILY = "daily AS (SELECT event_type AS series_id, ts::DATE AS ts, sum(value) AS y, count(*) AS n FROM events GROUP BY 1, 2)"


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, ts, y): events by user and day, densified with 0."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("series_id"), F.to_date("ts").alias("ts"))
    hits = e.groupBy("series_id", "ts").agg(F.count(F.lit(1)).alias("c"))
    days = e.select("ts").distinct()  # a row a day
    return e.select("series_id").distinct().crossJoin(F.broadcast(days)).join(hits, ["series_id", "ts"], "left").select("series_id", "ts", F.coalesce("c", F.lit(0)).cast("double").alias("y"))


SPARSE = """sparse AS (
    SELECT i.series_id, d.ts, coalesce(h.c, 0)::DOUBLE AS y
    FROM (SELECT DISTINCT user_id::VARCHAR AS series_id FROM events) i CROSS JOIN (SELECT DISTINCT ts::DATE AS ts FROM events) d
    LEFT JOIN (SELECT user_id::VARCHAR AS series_id, ts::DATE AS ts, count(*) AS c FROM events GROUP BY 1, 2) h
    ON h.series_id = i.series_id AND h.ts = d.ts)"""


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, z, grp): customers on a deterministic lattice."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 97).cast("double").alias("x"), (F.col("c_custkey") * 7 % 89).cast("double").alias("y"), F.col("c_acctbal").alias("z"), F.col("c_nationkey").alias("grp"))


GEO = "geo AS (SELECT c_custkey AS id, (c_custkey % 97)::DOUBLE AS x, (c_custkey * 7 % 89)::DOUBLE AS y, c_acctbal AS z, c_nationkey AS grp FROM customer)"


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, p): a label and a deterministic score in 0..1."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("y"), (F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100.0).alias("p"))


BINARY = "bin AS (SELECT doc_id AS id, toxic AS y, (doc_id * 37 % 101) / 100.0::DOUBLE AS p FROM labels)"


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, id, rel, score): order lines as ranking groups."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("id"), (F.col("l_linenumber") % 4).alias("rel"), F.col("l_extendedprice").alias("score"))


RANKING = "rk AS (SELECT l_orderkey AS grp, l_linenumber AS id, l_linenumber % 4 AS rel, l_extendedprice AS score FROM lineitem)"


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, w): quantities from customers' to suppliers' nations."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    lines = li.select("l_orderkey", "l_suppkey", "l_quantity").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("src", "dst").agg(F.sum("l_quantity").alias("w"))


FLOWS = """flows AS (
    SELECT c_nationkey AS src, s_nationkey AS dst, sum(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
