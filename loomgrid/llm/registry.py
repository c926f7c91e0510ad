"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, chat, decontam, language, line_dedup, minhash, sentencepiece_bpe, toxicity, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        minhash.op1_minhash, language.op2_language, decontam.op3_decontam, url_filter.op4_url_filter, chat.op5_chat,
        audio.op6_audio, toxicity.op7_toxicity, warc.op8_warc, line_dedup.op9_line_dedup, sentencepiece_bpe.op10_sentencepiece,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": url_filter.SQL, "op5_chat": chat.SQL, "op9_line_dedup": line_dedup.SQL}
