"""The pipeline's stages, alone and together, against plain versions of them."""

import hashlib
import struct
from collections import Counter

import corpus_pipeline
import pytest

from loomgrid.llm import decontam, line_dedup, toxicity
from loomgrid.llm import sentencepiece_bpe as sp
from tests.llm.test_minhash import brute

FOLDER = "/root/testdata/sf0.001"


def plain_lines(rows):
    total, n = Counter(r[3] or "" for r in rows), Counter()
    for r in rows:
        n.update((r[3] or "", line) for line in {x for x in (r[1] or "").split("\n") if x.strip(line_dedup.BLANKS)})
    bad = {k for k, v in n.items() if v > 1 and v > line_dedup.RATIO * total[k[0]]}
    return [(r[0], None if r[1] is None else "\n".join(x for x in r[1].split("\n") if (r[3] or "", x) not in bad), *r[2:]) for r in rows]


def test_run(spark):
    import pandas as pd
    import sentencepiece

    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    labels = pd.read_parquet(f"{FOLDER}/labels.parquet")
    model = toxicity.train(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.createDataFrame(labels))
    rows = [r for r, s in zip(docs, toxicity._scores(model, [r[1] or "" for r in docs]), strict=True) if s < 0.5]
    rows = plain_lines(rows)
    comp = brute(rows)
    rows = [r for r in rows if comp[r[0]][1] == r[0]]
    items = pd.read_parquet(f"{FOLDER}/benchmark.parquet")
    forms = [decontam.squeeze(t) for t in items["text"]]
    rows = [r for r in rows if not any(f in decontam.squeeze(r[1]) for f in forms)]
    lib = sentencepiece.SentencePieceProcessor(model_file=sp.model_path())
    want = {}
    for r in rows:
        ids = lib.encode(r[1] or "", add_bos=True, add_eos=True)
        want[r[0]] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == want


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES) - 1))
def test_stages_keep_columns_and_odd_rows(spark, at):
    name, stage = corpus_pipeline.STAGES[at]
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "some words here", "en", "s", 1), (3, "some other words", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert stage(spark, docs, FOLDER).columns == docs.columns
    assert stage(spark, docs, FOLDER).count() == (4 if name == "minhash" else 5)
    assert stage(spark, docs.limit(0), FOLDER).count() == 0


CLASHING = ["id", "hash", "host", "boilerplate", "left", "n_lines", "n_dropped", "comp", "node", "key", "row", "score", "predicted", "held_out", "allowed", "item_id", "lost", "__id", "a.b"]


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages_take_columns_of_any_name(spark, at):
    name, stage = corpus_pipeline.STAGES[at]
    rows = [(k, f"some words that {k} says in a line of its own here\nanother line {k}", "en", "s", 1, *range(len(CLASHING))) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` int" for c in CLASHING))
    made = stage(spark, docs, FOLDER)
    assert made.count() == 6
    if name != "sentencepiece":
        assert made.columns == docs.columns
        assert {tuple(r)[5:] for r in made.collect()} == {tuple(range(len(CLASHING)))}


def test_ties_repeats_and_long_texts(spark):
    long = " ".join(f"w{k % 977}x{k % 13}" for k in range(60_000))
    same = "one two three four five six seven eight"
    rows = [(5, long), (4, long + " end"), (9, same), (7, same), (7, same), (8, same.upper()), (7, "a different text under the same id as before"), (None, same), (10, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", 0) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, FOLDER)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert sorted((r.doc_id or 0, len(r.text or "")) for r in docs.collect() if r.doc_id != 7 or r.text != same)[:1] == [(0, len(same))], name
    assert sorted((r.doc_id or 0, (r.text or "")[:9]) for r in docs.collect()) == [(0, same[:9]), (4, long[:9]), (7, "a differe"), (7, same[:9]), (10, "")]
    assert max(len(r.text or "") for r in docs.collect()) == len(long) + 4
    assert corpus_pipeline.STAGES[4][1](spark, docs, FOLDER).count() == 5
