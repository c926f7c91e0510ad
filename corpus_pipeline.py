"""A corpus from raw documents to tokens, in stages that each drop or change rows of ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs.  All but the last keep the columns of ``documents``, and any others, whatever their names.

Edge cases, beyond those that each operator states: a null text is an empty one to every stage, and stays null where its
row stays; an empty table goes through as one; rows without an id stay until they are encoded; rows that repeat are
one row after the near-copy stage; rows that share an id with different texts stay, unless each resembles a row kept;
of documents that tie as near copies the least id stays; very long texts are whole in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgrid.llm import decontam, line_dedup, minhash, sentencepiece_bpe, toxicity
from loomgrid.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (a score of 0.5 or more) go; empty ones are never toxic by themselves."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on too many documents of a source go from their texts; a text may be left blank, and its row stays."""
    return line_dedup.drop_boilerplate(docs, Scratch(spark, "pipeline-lines")).select(*[f"`{c}`" for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, that of the least id; blank texts resemble nothing."""
    return minhash.keep_one(docs, Scratch(spark, "pipeline-minhash"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; without any item all stay."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left; an empty text has its begin and end ids."""
    return sentencepiece_bpe.digest_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate_lines),
    ("minhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: The classifier, the component search and the encoder have no form in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = scratch.save(docs)
    return docs
