"""Site-relative line frequency: lines on too large a share of a host's pages are boilerplate.

Lines are counted once a page and host; a line goes if more than one of the host's pages hold it, and they are more
than RATIO of all its pages, at every size of the host.  Counting groups 96-bit line digests, pre-aggregated before
the shuffle, so a host with any share of the rows spreads over all tasks.  What is dropped is a short list a host:
the shares of its lines sum to its mean number of lines a page, so at most that mean / RATIO lines qualify.

Edge cases: a null text stays null, with no lines; lines of ASCII white space only always stay; a null host is the
host ''; a host's only page keeps all its lines; rows that repeat are pages of their own; lines exactly at the ratio
stay; very long texts and lines are whole; an empty table gives no rows; all other columns of the table are kept,
whatever their names: the counts n_lines and n_dropped have underscores before them where a column has their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, unused

RATIO = 0.08
BLANKS = " \t\v\f\r"


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _said(line: Column) -> Column:
    """Whether a line holds more than white space."""
    return F.length(F.btrim(line, F.lit(BLANKS))) > 0


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """(host, pages, boilerplate): the digests of each host's lines beyond the ratio; only hosts that have any."""
    rows = docs.select(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).alias("text"))
    pages = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    line = rows.select("host", F.explode(F.array_distinct(F.filter(_lines(F.col("text")), _said))).alias("line"))
    counts = line.select("host", _key(F.col("line")).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = counts.join(pages, "host").where(F.col("n") > ratio * F.col("pages"))
    return found.groupBy("host").agg(F.first("pages").alias("pages"), F.collect_list("key").alias("boilerplate"))


def drop_boilerplate(docs: DataFrame, scratch: Scratch, host_col: str = "source", text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """``docs`` with the text's other lines only, and n_lines and n_dropped.

    The hosts' lists are written first, so that their size is known when the join is planned: a small table is
    broadcast, a larger one is shuffled with splitting of skewed hosts.
    """
    host, listed, left, n_lines, n_dropped = unused(docs, "host", "boilerplate", "left", "n_lines", "n_dropped")
    lists = scratch.save(boilerplate(docs, host_col, text_col, ratio)).select(F.col("host").alias(host), F.col("boilerplate").alias(listed))
    joined = docs.join(lists, F.coalesce(F.col(host_col).cast("string"), F.lit("")) == F.col(host), "left")
    text = F.col(text_col)
    rest = F.filter(_lines(text), lambda x: ~F.array_contains(F.col(listed), _key(x)) | ~_said(x))
    n = F.when(text.isNull(), 0).otherwise(F.size(_lines(text)))
    joined = joined.withColumn(left, F.when(F.col(listed).isNotNull(), rest))
    return joined.select(
        *[F.when(F.col(left).isNull(), text).otherwise(F.array_join(left, "\n")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        n.cast("long").alias(n_lines), F.when(F.col(left).isNull(), 0).otherwise(n - F.size(left)).cast("long").alias(n_dropped),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs, Scratch(spark, "lines")).select("doc_id", "n_lines", "n_dropped", "text")


def sql(docs: str = "documents") -> str:
    """DuckDB SQL for (doc_id, n_lines, n_dropped, text)."""
    return f"""
WITH pages AS (
    SELECT coalesce(source, '') AS host, count(*) AS pages FROM {docs} GROUP BY 1
), line AS (
    SELECT coalesce(source, '') AS host, unnest(list_distinct(list_filter(string_split(text, chr(10)), lambda x: length(trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) > 0))) AS line FROM {docs}
), found AS (
    SELECT l.host, line FROM line l JOIN pages p ON l.host = p.host GROUP BY l.host, line, p.pages
    HAVING count(*) > 1 AND count(*) > {RATIO} * p.pages
), lists AS (
    SELECT host, list(line) AS boilerplate FROM found GROUP BY host
), cut AS (
    SELECT doc_id, text, string_split(text, chr(10)) AS lines,
        list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(boilerplate, []::VARCHAR[]), x)) AS kept
    FROM {docs} d LEFT JOIN lists b ON coalesce(d.source, '') = b.host
)
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped,
    array_to_string(kept, chr(10)) AS text FROM cut
"""


SQL = sql()
