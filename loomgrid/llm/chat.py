"""Multi-party perspective rotation of dialogues.

For every participant of a dialogue (each distinct role but ``system``) the dialogue is rendered with that
speaker as the assistant, the others as users with their names, and system turns as they are.  A mask span
covers what the assistant says, with its end marker; all else is context.

A dialogue is rendered in blocks of BLOCK turns, counted in its order, so that a dialogue of any length spreads over
tasks; its blocks in order, joined, are the whole rendering, and spans count from their block's start.  Turns are
counted without gathering a dialogue: they are dealt to tasks by ranges of (dialogue, number, role, text), counted in
each task, and start from the counts of the dialogue's earlier tasks, which are a row a dialogue and task.

Edge cases: a null text is empty; turns of a null or empty role are context like system turns; a dialogue
without a participant has no rows; rows that repeat exactly count once; turns that share a number are ordered
by role, then text; turns without a number come before the others; dialogue rows without an id are one dialogue,
whose id is null; an empty table gives no rows; very long texts are whole; extra columns, of any name, are ignored.
Start markers inside a text are broken up by a blank, so that no text can open or close a turn; in a name, the
characters that could do so, and the percent sign, are written as percent codes, so that different names stay different.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, table

START, END = "<|im_start|>", "<|im_end|>"
BLOCK = 64


def _segment(role: Column, name: Column, text: Column) -> tuple[Column, Column]:
    """The head and the body of a rendered turn."""
    label = F.when(role == "user", F.concat(F.lit("user name="), name)).otherwise(role)
    return F.concat(F.lit(START), label, F.lit("\n")), F.concat(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit(END + "\n"))


def _name(role: Column) -> Column:
    for c in "%<\r\n":
        role = F.replace(role, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return role


def counted(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct rows (conv_id, turn, role, text) with their place in the dialogue, from 0."""
    order = ["conv_id", "turn", "role", "text"]
    dealt = scratch.save(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    heads = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a dialogue and task
    heads = scratch.save(heads.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    here = F.row_number().over(W.partitionBy("conv_id", "part").orderBy(*order))
    placed = dealt.withColumn("here", here).join(heads, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    return placed.select(*order, (F.col("start") + F.col("here") - 1).alias("place"))


def rotate(turns: DataFrame, scratch: Scratch, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, perspective, block, n_turns, rendered, mask_spans): spans are ``start:end`` joined by ``;``."""
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).distinct()
    rows = counted(rows, scratch)
    people = rows.where(~F.col("role").isin("system", "")).select(F.col("conv_id").alias("of"), F.col("role").alias("perspective")).distinct()
    seen = rows.join(people, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    said = F.when(F.col("role").isin("system", ""), "system").when(F.col("role") == F.col("perspective"), "assistant").otherwise("user")
    head, body = _segment(said, _name(F.col("role")), F.col("text"))
    seen = seen.select(
        "conv_id", "perspective", F.floor(F.col("place") / BLOCK).alias("block"),
        F.struct("place", (said == "assistant").alias("own"), F.length(head).alias("head"), F.concat(head, body).alias("segment")).alias("at"),
    )
    grouped = seen.groupBy("conv_id", "perspective", "block").agg(F.array_sort(F.collect_list("at")).alias("at"))
    # Spans by a running length over the block's turns.
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["pos"] + F.length(x["segment"])
        span = F.concat_ws(":", (acc["pos"] + x["head"]).cast("string"), (end - 1).cast("string"))
        return F.struct(end.alias("pos"), F.when(x["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return grouped.select(
        "conv_id", "perspective", "block", F.size("at").cast("long").alias("n_turns"),
        F.array_join(F.transform("at", lambda x: x["segment"]), "").alias("rendered"),
        F.array_join(F.aggregate("at", start, step, lambda acc: acc["spans"]), ";").alias("mask_spans"),
    )


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"), Scratch(spark, "chat"))


SQL = f"""
WITH rows AS (
    SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), counted AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM rows
), people AS (
    SELECT DISTINCT conv_id, role AS perspective FROM rows WHERE role NOT IN ('system', '')
), seen AS (
    SELECT r.conv_id, perspective, place // {BLOCK} AS block, place, text,
        CASE WHEN role IN ('system', '') THEN 'system' WHEN role = perspective THEN 'assistant'
             ELSE 'user name=' || replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), chr(13), '%0D'), chr(10), '%0A') END AS label
    FROM counted r JOIN people p ON r.conv_id IS NOT DISTINCT FROM p.conv_id
), made AS (
    SELECT *, '{START}' || label || chr(10) AS head,
        '{START}' || label || chr(10) || replace(text, '<|', '< |') || '{END}' || chr(10) AS segment FROM seen
), placed AS (
    SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, perspective, block ORDER BY place) AS pos FROM made
)
SELECT conv_id, perspective, block, count(*) AS n_turns,
    string_agg(segment, '' ORDER BY place) AS rendered,
    coalesce(string_agg(CASE WHEN label = 'assistant' THEN (pos - length(segment) + length(head))::BIGINT::VARCHAR || ':' || (pos - 1)::BIGINT::VARCHAR END, ';' ORDER BY place), '') AS mask_spans
FROM placed GROUP BY conv_id, perspective, block
"""
