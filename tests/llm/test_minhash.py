"""Near-duplicate components against all pairs of sets."""

import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np

from loomgrid.llm import minhash as M
from loomgrid.llm.common import Scratch
from tests.llm.data import SCHEMA, documents, words


def sets(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    s = {r[0]: sets(r[1]) for r in rows}
    up = {i: i for i in s}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sorted(s), 2):
        n = len(s[a] & s[b])
        if n and 100 * n >= 75 * len(s[a] | s[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s[i]), root(i)) for i in s}


def test_components(spark):
    rows = documents()
    docs = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA + ", key string")
    got = M.near_components(docs, Scratch(spark, "t")).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_hub_is_not_needed_for_a_link(spark):
    """A chain: ends aren't similar to each other, each step is."""
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(6):
        rows.append((k, " ".join([f"z{j}" for j in range(4 * k)] + base[4 * k :]), "en", "s", 0))
    got = M.near_components(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_empty_table(spark):
    assert M.near_components(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).collect() == []


def test_keep_one(spark):
    rows = documents()
    want = brute(rows)
    kept = M.keep_one(spark.createDataFrame(rows + [(None, "no id", "en", "s", 0)], SCHEMA), Scratch(spark, "t")).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(i for i, (_, c) in want.items() if i == c)
    assert sum(r.doc_id is None for r in kept) == 1


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    a, b = np.unique(pool[:3000]), np.unique(pool[1000:])
    share = (M.signature(a) == M.signature(b)).mean()
    assert abs(share - 0.5) < 0.2


def test_pruning_keeps_similar_pairs():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 16, (4000, M.VALUES), dtype=np.uint16)
    b = np.where(rng.random(a.shape) < 0.75, a, a + 1)
    c = np.where(rng.random(a.shape) < 0.4, a, a + 1)
    assert len(M.survives(a, b)) >= 3980
    assert len(M.survives(a, c)) <= 40


X, Y, Z = "a b c d e f g h", "p q r s t u v w", "A b c d e f g  h"


def several_texts(rows):
    """Components where an id stands for all its texts, by brute force."""
    s = {k: sets(t) for k, t in enumerate(t for _, t in rows)}
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        n = len(s[a] & s[b])
        if n and 100 * n >= 75 * len(s[a] | s[b]):
            x, y = sorted((root(rows[a][0]), root(rows[b][0])))
            up[y] = x
    return sorted((i, len(s[k]), root(i)) for k, (i, _) in enumerate(rows))


def test_an_id_with_several_texts(spark):
    """Ids that repeat: links are between ids, and the filter goes by text."""
    rows = [(3, X), (5, X), (5, Y), (7, Y), (8, Z), (9, "one more text that is alone here"), (9, X), (9, ""), (9, ""), (11, None), (4, Y), (4, Y)]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id long, text string, id string, hash string, row string")
    for _ in range(3):
        got = M.near_components(docs, Scratch(spark, "t")).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == several_texts(rows)
        kept = M.keep_one(docs, Scratch(spark, "t"))
        assert kept.columns == docs.columns
        assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(3, X), (4, Y), (9, ""), (9, "one more text that is alone here"), (11, "")]


def test_random_ids_that_clash(spark):
    r = random.Random(4)
    pool = [words(k // 3, 24) for k in range(30)]
    rows = []
    for _ in range(120):
        w = list(r.choice(pool))
        for _ in range(r.randint(0, 2)):
            w[r.randrange(24)] = r.choice("pqrs")
        rows.append((r.randrange(70), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = M.near_components(docs, Scratch(spark, "t")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == several_texts(rows)
    # The filter leaves one row of each component of texts.
    texts = sorted({t for _, t in rows})
    comp = brute([(k, t) for k, t in enumerate(texts)])
    of = {t: comp[k][1] for k, t in enumerate(texts)}
    kept = M.keep_one(docs, Scratch(spark, "t")).collect()
    assert sorted(of[r.text] for r in kept) == sorted(set(of.values()))
    least = {}
    for i, t in rows:
        least[of[t]] = min(i, least.get(of[t], i))
    assert all(r.doc_id == least[of[r.text]] for r in kept)


def test_a_large_bucket_without_links_is_copied_little():
    assert -(-100_000 // M.TILE) < 10


def test_tiles_compare_every_pair(spark, monkeypatch):
    """Without hubs' help and with tiles of two, all similar pairs still meet."""
    rows = [r for r in documents() if r[0] < 130]
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(M, "TILE", 2)
    monkeypatch.setattr(M, "CHUNK", 1)
    got = M.near_components(docs, Scratch(spark, "t")).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: v[1] for k, v in brute(rows).items()}


def test_components_of_links(spark):
    links = [(1, 2), (2, 3), (5, 9), (3, 8), (9, 7), (20, 21)]
    got = defaultdict(set)
    for r in M.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect():
        got[r.comp].add(r.node)
    assert dict(got) == {1: {2, 3, 8}, 5: {7, 9}, 20: {21}}
