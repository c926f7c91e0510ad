"""Language of web pages by Bayesian fusion of four kinds of evidence.

1. Text: naive Bayes over hashed byte trigrams of the whole visible text, trained on labelled documents.  The
   mean log-likelihood counts for at most WEIGHT trigrams, since neighbouring trigrams aren't independent.
2. Declared markup language (``lang`` of the page's ``html`` element, primary subtag).
3. Address suffix (last label of the host).
4. Host prior, smoothed hierarchically: host towards registered domain (last two labels), domain towards
   suffix, suffix towards all pages, each with STRENGTH pseudo-pages; a page's own count is left out.

How often a language declares a value, or lives under a suffix, and the host counts, are sums of the text
posteriors over all pages, by grouped aggregation.

Joins on a host go by written tables of known size: a row a host, broadcast while it is small, else shuffled with
Spark's splitting of skewed hosts.

Edge cases: null html or url is empty; without text the other evidence decides; an empty table gives no rows;
without any labelled document no language is known and the language is null; rows that repeat are pages of
their own; very long pages are whole, taken in slices of bounded rows and bytes, and read in linear time whatever is
left open in them; extra columns, of any name, are ignored.  Of equally likely languages the alphabetically first wins.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, table

BUCKETS = 1 << 15
SAMPLE = 3000  # labelled documents that the text model is trained on
WEIGHT = 300.0
STRENGTH = 10.0
ALPHA = 0.5
HIDDEN = re.compile(r"<(?:(script|style)\b|(!--))", re.I)
CLOSING = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I), "!--": re.compile("-->"), "": re.compile(">")}
ROOT = re.compile(r"<html\b([^>]*)", re.I)
DECLARED = re.compile(r"\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.I)


def visible(page: str) -> str:
    """The text outside of tags, comments, scripts and styles; what is opened and never closed is a mere tag, or text."""
    out, at, start, never = [], 0, page.find("<"), set()
    while start >= 0 and "" not in never:
        kind = (m[1] or m[2]).lower() if (m := HIDDEN.match(page, start)) else ""
        end = None
        for what, begin in ((kind, m.end() if m else 0), ("", start + 1)):
            if what not in never:
                if end := CLOSING[what].search(page, begin or start + 1):
                    break
                never.add(what)  # nor any further on
        if end is None:
            break
        out.append(page[at:start])
        at = end.end()
        start = page.find("<", at)
    return html.unescape(" ".join([*out, page[at:]]))


def declared(page: str) -> str:
    """The primary subtag that the page's first ``html`` element declares, or nothing."""
    found = DECLARED.search(root[1]) if (root := ROOT.search(page)) else None
    return found[1].lower() if found else ""


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the text, lower-cased, with white space as one blank."""
    raw = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.uint32)
    return ((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and log-likelihoods (BUCKETS, languages) from the ``sample`` labelled documents of least id hash.

    What comes to the driver is a count a language and bucket.
    """
    rows = docs.select(F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    last = [r.h for r in rows.select("h").orderBy("h").limit(sample).collect()]
    if not last:
        return [], np.zeros((BUCKETS, 0))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                by.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))
                by[lang.as_py()] += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        for lang, n in by.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])

    sums = rows.where(F.col("h") <= last[-1]).select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique())
    n = np.zeros((BUCKETS, len(langs)))
    n[sums["bucket"], sums["lang"].map({x: k for k, x in enumerate(langs)})] = sums["n"]
    return langs, np.log((n + ALPHA) / (n.sum(0) + ALPHA * BUCKETS))


def score_text(pages: DataFrame, model: np.ndarray, url_col: str = "url", html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """(page_id, host, domain, suffix, declared, ll array<double>) with the weighted text log-likelihoods."""
    sent = pages.sparkSession.sparkContext.broadcast(model.astype(np.float32))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        for batch in slices(batches, "html"):
            out: list[tuple] = []
            for url, page in zip(batch.column("url"), batch.column("html"), strict=True):
                page = page.as_py() or ""
                _, has, rest = (url.as_py() or "").partition("://")
                host = re.split(r"[/?#]", rest, maxsplit=1)[0].lower() if has else ""
                labels = re.sub(r"^.*@|:\d*$", "", host).rstrip(".").split(".")
                at = trigrams(visible(page))
                ll = np.zeros(weights.shape[1])
                for part in range(0, len(at), 1 << 16):
                    ll += weights[at[part : part + (1 << 16)]].sum(0, dtype=np.float64)
                out.append((host, ".".join(labels[-2:]), labels[-1], declared(page), ll * (min(1.0, WEIGHT / len(at)) if len(at) else 0)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, pa.string()) for c in cols[:4]), pa.array(cols[4], pa.list_(pa.float64()))], ["page_id", "host", "domain", "suffix", "declared", "ll"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, host string, domain string, suffix string, declared string, ll array<double>")


def _softmax(logs: list[Column]) -> list[Column]:
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    powers = [F.exp(x - top) for x in logs]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


def fuse(scored: DataFrame, langs: list[str], scratch: Scratch) -> DataFrame:
    """(page_id, lang, confidence, text_lang, declared, host) from ``score_text``'s rows."""
    n = range(len(langs))
    cols = [f"p{k}" for k in n]
    soft = _softmax([F.col("ll")[k] for k in n])
    rows = scratch.save(scored.select("page_id", "host", "domain", "suffix", "declared", *[F.col("ll")[k].alias(f"l{k}") for k in n], *[soft[k].alias(cols[k]) for k in n]))
    total = lambda df, *by: df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in cols])
    hosts = scratch.save(total(rows, "host", "domain", "suffix"))
    domains, suffixes, everything = total(hosts, "domain", "suffix"), total(hosts, "suffix"), total(hosts)
    said = total(rows, "declared")
    rename = lambda df, to: df.select(*[c for c in df.columns if c not in cols], *[F.col(c).alias(f"{to}{k}") for k, c in enumerate(cols)])
    size = lambda a: sum((F.col(f"{a}{k}") for k in n), F.lit(0.0))
    # Host priors, from all pages down; one row a host.
    level = rename(hosts, "h").join(rename(domains, "d"), ["domain", "suffix"]).join(rename(suffixes, "s"), "suffix").crossJoin(F.broadcast(rename(everything, "g")))
    smoothed = lambda a, k, above: (F.col(f"{a}{k}") + STRENGTH * above) / (size(a) + STRENGTH)
    g = [(F.col(f"g{k}") + 1) / (size("g") + len(langs)) for k in n]
    s = [smoothed("s", k, g[k]) for k in n]
    d = [smoothed("d", k, s[k]) for k in n]
    # P(suffix | language), from the suffix counts.
    like_suffix = [F.log((F.col(f"s{k}") + ALPHA) / (F.col(f"g{k}") + ALPHA * 100)) for k in n]
    level = scratch.save(level.select("host", "domain", "suffix", *[F.col(f"h{k}") for k in n], size("h").alias("h"), *[d[k].alias(f"d{k}") for k in n], *[like_suffix[k].alias(f"u{k}") for k in n]))
    said = rename(said, "c").crossJoin(F.broadcast(rename(everything, "g")))
    said = scratch.save(said.select("declared", *[F.when(F.col("declared") == "", 0.0).otherwise(F.log((F.col(f"c{k}") + ALPHA) / (F.col(f"g{k}") + ALPHA * 100))).alias(f"m{k}") for k in n]))
    joined = rows.join(said, "declared").join(level, ["host", "domain", "suffix"])
    prior = [F.log((F.greatest(F.col(f"h{k}") - F.col(f"p{k}"), F.lit(0.0)) + STRENGTH * F.col(f"d{k}")) / (F.col("h") - 1 + STRENGTH)) for k in n]
    logs = [F.col(f"l{k}") + F.col(f"m{k}") + F.col(f"u{k}") + prior[k] for k in n]
    joined = joined.select("page_id", "host", "declared", *cols, *[x.alias(f"q{k}") for k, x in enumerate(_softmax(logs))])

    def best(c: str) -> Column:
        top = F.greatest(*[F.col(f"{c}{k}") for k in n]) if len(langs) > 1 else F.col(f"{c}0")
        return F.coalesce(*[F.when(F.col(f"{c}{k}") == top, langs[k]) for k in n])

    top = F.greatest(*[F.col(f"q{k}") for k in n]) if len(langs) > 1 else F.col("q0")
    return joined.select("page_id", best("q").alias("lang"), F.round(top, 6).alias("confidence"), best("p").alias("text_lang"), "declared", "host")


def identify(pages: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The language of every page; ``docs`` are labelled texts."""
    langs, model = train(docs)
    scored = score_text(pages, model)
    if not langs:
        null = F.lit(None)
        return scored.select("page_id", null.cast("string").alias("lang"), null.cast("double").alias("confidence"), null.cast("string").alias("text_lang"), "declared", "host")
    return fuse(scored, langs, scratch)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"), Scratch(spark, "language"))
