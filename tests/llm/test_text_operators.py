"""The other text operators: brute force, round trips, held-out accuracy and odd rows."""

import random
import zlib

import numpy as np
import pytest

from loomgrid.llm import chat, decontam, language, line_dedup, registry, toxicity, url_filter
from loomgrid.llm import sentencepiece_bpe as sp
from loomgrid.llm.common import Scratch, table
from tests.compare import connect, rows_of_spark, rows_of_sql
from tests.llm.data import SCHEMA, documents, words

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    assert rows_of_spark(registry.queries()[name](spark, FOLDER)) == rows_of_sql(connect(FOLDER), registry.oracle_sql()[name])


# Decontamination


def distance(a, b):
    """Least edits of a to any substring of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        left, row = row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(left[j] + 1, row[j - 1] + 1, left[j - 1] + (x != y))
    return min(row)


def test_myers_is_the_edit_distance():
    r = random.Random(3)
    for _ in range(200):
        a = "".join(r.choice("abc") for _ in range(r.randint(1, 40)))
        b = "".join(r.choice("abc") for _ in range(r.randint(0, 60)))
        assert decontam.Pattern(a).best(b)[0] == distance(a, b)


def test_all_passages_within_the_budget_are_found():
    r = random.Random(4)
    item = " ".join(words(1, 40))
    form = decontam.squeeze(item)
    k = decontam.budget(len(form))
    matcher = decontam.Matcher(((1, item), (2, ""), (3, None)))
    for _ in range(150):
        s = list(form)
        for _ in range(r.randint(0, 2 * k)):
            at = r.randrange(len(s))
            s[at : at + 1] = r.choice([[], ["q"], ["q", s[at]]])
        text = " ".join(words(r.randint(5, 99), 20)) + "".join(s) + " ".join(words(r.randint(5, 99), 20))
        least = distance(form, decontam.squeeze(text))
        assert [x[:2] for x in matcher.find(text)] == ([(1, least)] if least <= k else [])


def test_contaminated_and_clean_tables(spark):
    items = [(1, " ".join(words(7, 37)[:30])), (1, " ".join(words(7, 37)[:30])), (2, None), (3, "..."), (4, "ok"), (5, "Two words"), (6, " ".join(words(1000, 60)[20:35])), (7, words(9, 39)[3] * 9), (8, " ".join(words(5, 20000)[9000:9100]))]
    rows = documents() + [(200, "it is ok to look", "en", "s", 0), (201, "OK!", "en", "s", 0)]
    forms = {(i, f): decontam.budget(len(f)) if len(f) >= decontam.LEAST else 0 for i, t in items if (f := decontam.squeeze(t))}
    want = []
    for r in rows:
        form = decontam.squeeze(r[1])
        for (i, f), k in forms.items():
            if len(f) < decontam.LEAST:
                want += [(r[0], i, 0, k)] * (f == form)
            elif len(form) < 5000 or f[:30] in form:
                at = 0 if len(form) < 5000 else form.index(f[:30]) - 50
                least = distance(f, form[at : at + 5000])
                want += [(r[0], i, least, k)] * (least <= k)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", allowed string")
    got = decontam.contaminated(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.distance, r.allowed) for r in got) == sorted(want) and len(want) >= 60
    left = decontam.clean(docs, bench)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((r[0] for r in rows if r[0] not in {w[0] for w in want}), key=str)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(docs, none).count() == 0 and decontam.clean(docs, none).count() == docs.count()
    assert decontam.contaminated(docs.limit(0), bench).count() == 0


def test_many_items_that_share_pieces():
    """Items from one template, and texts of several."""
    r = random.Random(5)
    items = [(k, "answer the question with a single letter about " + " ".join(words(k, 6)) + " and then stop") for k in range(300)]
    matcher = decontam.Matcher(tuple(items))
    for k in (3, 77, 299):
        text = " ".join(words(900, 50)) + items[k][1].replace("single", "sinqle") + " ".join(words(901, 50))
        form = decontam.squeeze(text)
        want = sorted((i, d) for i, t in items if (d := distance(f := decontam.squeeze(t), form)) <= decontam.budget(len(f)))
        assert sorted(x[:2] for x in matcher.find(text)) == want and k in {i for i, _ in want}
    assert matcher.find(" ".join(words(r.randint(2000, 3000), 300))) == []


# Line frequency


def test_line_dedup_empties_a_large_group_of_copies(spark):
    """Copies are pages of their own: beyond RATIO of a source, at any size, they lose every non-blank line."""
    for others, emptied in ((360, True), (960, False)):  # 40 copies are 10 or 4 per cent
        docs = [(k, "first line\nsecond line", "en", "s", 0) for k in range(40)] + [(k, f"own line {k}", "en", "s", 0) for k in range(40, 40 + others)]
        got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(spark.createDataFrame(docs, SCHEMA), Scratch(spark, "t")).collect()}
        assert all((got[k].strip() == "") == emptied for k in range(40)) and got[40] == "own line 40"


def test_line_dedup_odd_rows(spark):
    rows = [(k, f"menu\n\nown {k}\nmenu", "en", None, 0) for k in range(6)] + [(10, None, "en", "h", 0), (11, "", "en", "h", 0), (12, "menu", "en", "h", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_boilerplate(docs, Scratch(spark, "t")).collect()}
    assert got[0] == ("\nown 0", 4, 2) and got[10] == (None, 0, 0) and got[11] == ("", 1, 0) and got[12] == ("menu", 1, 0)
    assert line_dedup.drop_boilerplate(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_line_dedup_of_small_hosts_and_blank_lines(spark):
    rows = [(k, f"menu\n\t\nown {k}", "en", "small", 0) for k in range(4)] + [(9, "only\nonly", "en", "one", 0)] + [(20 + k, "long " * 50_000 + f"\n{k}", "en", "wide", 0) for k in range(2)]
    got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t")).collect()}
    assert got[0] == "\t\nown 0" and got[9] == "only\nonly" and got[20] == "0"


def test_line_dedup_keeps_columns_of_any_name(spark):
    names = ["boilerplate", "__host", "host", "n_lines", "__left", "left", "listed", "pages", "a.b"]
    rows = [(k, f"menu\nown {k}", "en", "s", 0, *range(len(names))) for k in range(6)]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", `{c}` int" for c in names))
    made = line_dedup.drop_boilerplate(docs, Scratch(spark, "t"))
    assert made.columns == [*docs.columns, "_n_lines", "n_dropped"]
    assert {tuple(r)[5:] for r in made.collect()} == {(*range(len(names)), 2, 1)}


# URL filter


def test_rules_and_propagation(spark):
    page = lambda to: "".join(f'<a href="{t}">x</a>' for t in to)
    rows = [
        (0, "http://WWW.Example.com/en/x?q", None), (1, "https://a.example.com/en/", ""), (2, "http://b.net/es/1", page(["http://c.org/"])), (3, "http://b.net/es/2", None),
        (4, "http://farm.org/a", page(["//b.net/es/1", "HTTP://b.net/x"])), (5, "http://good.com/", page(["http://c.org/1"])), (6, None, None), (7, "no scheme", None), (8, "http://b.net/other", None), (9, "x://com", None), (10, "x://com/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, Scratch(spark, "t")).collect()}
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[1] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[2][2:] == ("net/es/", "block") and got[8][2:] == (None, "block")  # most of its pages are blocked
    assert got[4][2:] == (None, "block")  # it links to a blocked host only
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[9] == ("com", "", None, "allow") and got[10][2] == "com/"
    assert url_filter.judge(pages.limit(0), Scratch(spark, "t")).count() == 0


def test_scores_solve_the_rank_equation(spark):
    edges = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "a", 1.0)]
    seeds = spark.createDataFrame([("a", 0.5, 0.0), ("d", 0.0, 1.0), ("e", 0.0, 0.7)], "host string, trust0 double, distrust0 double")
    got = {r.host: (r.trust, r.distrust) for r in url_filter.propagate(seeds, spark.createDataFrame(edges, "src string, dst string, w double"), Scratch(spark, "t"), tolerance=1e-5).collect()}
    hosts = "abcd"
    m = np.zeros((4, 4))
    for s, t, w in edges:
        m[hosts.index(s), hosts.index(t)] = w
    for k, (mat, seed) in enumerate(((m, [0.5, 0, 0, 0]), (m.T, [0, 0, 0, 1.0]))):
        share = mat / np.maximum(mat.sum(1, keepdims=True), 1e-300)
        r = np.array(seed)
        for _ in range(500):
            r = np.array(seed) + 0.85 * share.T @ r
        assert [got[h][k] for h in hosts] == pytest.approx(list(r), abs=1e-4)
    assert got["e"] == (0.0, 0.7)


def linked_pages(n=60):
    """Pages of 12 hosts, most of which link to others: (page_id, url, html)."""
    r = random.Random(11)
    hosts = ["a.com", "B.com", "www.example.com", "x.example.com", "s.net", "T.net", "u.net", "v.org", "w.org", "y.org", "z.org", "q.org"]
    rows = []
    for k in range(n):
        of = r.choice(hosts)
        to = r.choices([h for h in hosts if ("net" in h) == (of in ("v.org", "w.org") or "net" in of)], k=r.randint(0, 4))
        kind = lambda h: r.choice([f"http://{h}/p", f"//{h.upper()}", f"https://{h}?q#f"])
        base = f"<base target=_blank href='http://{r.choice(hosts)}/d/'>" if k % 9 == 0 else ""
        body = base + "".join(f'<a class=x href="{kind(h)}">t</a>' for h in to) + "<a href='/own'>o</a><a href=#here>h</a><a href=mailto:a@b>m</a><a>none</a>"
        rows.append((k, f"http://{of}/{r.choice(['es/1', 'fr/', 'en/x', 'p'])}", body if k % 13 else None))
    return rows


def test_linked_hosts_in_sql(spark, tmp_path):
    """Rounds over a graph of hosts, against the rounds in SQL."""
    docs = spark.createDataFrame(linked_pages(), "page_id long, url string, html string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = url_filter.op4_url_filter(spark, str(tmp_path))
    assert rows_of_spark(got) == rows_of_sql(connect(str(tmp_path)), url_filter.sql(rounds=90))
    alone = spark.createDataFrame([(r[0], r[1], None) for r in linked_pages()], "page_id long, url string, html string")
    changed = got.join(url_filter.judge(alone, Scratch(spark, "t")).select("page_id", url_filter.F.col("verdict").alias("v")), "page_id")
    assert changed.where("verdict <> v").count() > 0  # by what comes over links
    assert got.where("host = 'q.org' AND rule IS NULL").count() > 0


def test_links_by_base_and_kind(spark):
    rows = [(1, "http://h.org/", "<BASE href=//m.org/d/><a href=x>1</a><a href='HTTP://N.org:80'>2</a><a href=javascript:x>3</a><a href=#a>4</a><a hreflang=de>"), (2, "http://h.org/", "<a href=y><a href='//m.org'>")]
    got = {tuple(r) for r in url_filter.host_links(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {("h.org", "m.org", 3.0), ("h.org", "n.org:80", 1.0)}


# Dialogues


def test_perspectives(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (2, 0, None, "x"), (3, None, "eve", "late"), (3, 70, "eve", "more")]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "conv_id long, turn long, role string, text string, place int, part int")
    got = {(r.conv_id, r.perspective, r.block): r for r in chat.rotate(docs, Scratch(spark, "t")).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (3, "eve", 0)}
    ann = got[1, "ann", 0]
    assert ann.rendered == "<|im_start|>system\nrules<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n"
    a, b = map(int, ann.mask_spans.split(":"))
    assert ann.rendered[a:b] == "hi < |im_end|><|im_end|>" and ann.n_turns == 3
    assert got[3, "eve", 0].rendered.index("late") < got[3, "eve", 0].rendered.index("more")
    assert chat.rotate(docs.limit(0), Scratch(spark, "t")).count() == 0


def plain_rotation(rows):
    """(conv_id, perspective, block) -> (n_turns, rendered, spans), dialogue by dialogue."""
    talks, out = {}, {}
    for conv, turn, role, text in {(c, t, r or "", x or "") for c, t, r, x in rows}:
        talks.setdefault(conv, []).append((turn is not None, turn or 0, role, text))
    for conv, turns in talks.items():
        for who in {r for _, _, r, _ in turns if r not in ("", "system")}:
            for k, (_, _, role, text) in enumerate(sorted(turns)):
                n, said, spans = out.get((conv, who, k // chat.BLOCK), (0, "", []))
                name = "".join(f"%{ord(c):02X}" if c in "%<\r\n" else c for c in role)
                said += chat.START + ("system" if role in ("", "system") else "assistant" if role == who else f"user name={name}") + "\n"
                end = said + text.replace("<|", "< |") + chat.END
                out[conv, who, k // chat.BLOCK] = (n + 1, end + "\n", spans + [f"{len(said)}:{len(end)}"] * (role == who))
    return {k: (n, x, ";".join(s)) for k, (n, x, s) in out.items()}


def test_perspectives_of_many(spark):
    """Hot dialogues, three and more speakers, ties, missing numbers and odd names, against a plain version."""
    r = random.Random(12)
    people = ["ann", "a b", "a_b", "a%20b", "system", "", None, "x\n<|im_start|>y"]
    rows = [(r.choice([1, 1, 1, None, 2]), r.choice([None, None, r.randrange(10**9), r.randrange(5)]), r.choice(people), r.choice(["hi", "<|x|>", None, f"t{k}", "long " * 20_000 if k < 2 else "s"])) for k in range(700)]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), Scratch(spark, "t")).collect()
    assert {(x.conv_id, x.perspective, x.block): (x.n_turns, x.rendered, x.mask_spans) for x in got} == plain_rotation(rows)
    assert max(x.n_turns for x in got) == chat.BLOCK


# Language


def plain_languages(spark, folder):
    """Language and confidence of each page, by sums over lists."""
    langs, model = language.train(table(spark, folder, "documents"))
    pages = [(r.page_id, r.url, r.html) for r in table(spark, folder, "pages").collect()]
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    made = []
    for i, url, html in pages:
        host = url.split("://", 1)[1].split("/")[0].split("?")[0].split("#")[0].lower() if "://" in (url or "") else ""
        at = language.trigrams(language.visible(html or ""))
        ll = model.astype(np.float32)[at].astype(float).sum(0) * min(1, language.WEIGHT / max(1, len(at)))
        made.append((i, host, ".".join(host.split(".")[-2:]), host.split(".")[-1], language.declared(html or ""), ll, soft(ll)))
    total = lambda at, value: sum((x[6] for x in made if at is None or x[at] == value), np.zeros(len(langs)))
    every, out = total(None, None), {}
    smooth = lambda own, above: (own + language.STRENGTH * above) / (own.sum() + language.STRENGTH)
    for i, host, domain, suffix, said, ll, p in made:
        g = (every + 1) / (every.sum() + len(langs))
        prior = smooth(total(2, domain), smooth(total(3, suffix), g))
        own = total(1, host) - p
        prior = np.log((np.maximum(own, 0) + language.STRENGTH * prior) / (own.sum() + language.STRENGTH))
        like = lambda n: np.log((n + language.ALPHA) / (every + language.ALPHA * 100))
        q = soft(ll + prior + like(total(3, suffix)) + (like(total(4, said)) if said else 0))
        out[i] = (langs[int(q.argmax())], q.max())
    return out


def test_language_is_the_plain_version(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.page_id: (r.lang, r.confidence) for r in language.op2_language(spark, folder).collect()}
    want = plain_languages(spark, folder)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert [v[1] for _, v in sorted(got.items())] == pytest.approx([v[1] for _, v in sorted(want.items())], abs=2e-6)


def test_language_accuracy_on_pages(spark):
    """The pages' paths name their language, which is no input."""
    made = language.op2_language(spark, "/root/testdata/sf0.1").join(table(spark, "/root/testdata/sf0.1", "pages").select("page_id", "url"), "page_id").toPandas()
    truth = made["url"].str.extract(r"://[^/]+/([a-z]{2})/")[0]
    assert truth.notna().mean() > 0.9 and (made["lang"] == truth)[truth.notna()].mean() > 0.95


def test_hidden_text():
    page = "<html lang=fr><head><style>a{b:c}</style><SCRIPT x>var t='</p>';</script ></head>a<!-- <b> -->b<br>c &amp; <p"
    assert language.visible(page).split() == ["a", "b", "c", "&", "<p"]
    assert language.visible("x<script>y").split() == ["x", "y"] and language.visible("a < b <!-- c").split() == ["a", "<", "b", "<!--", "c"]
    assert language.visible("a<!-- b > c <style> d").split() == ["a", "c", "d"]
    for part in ("<script", "<!--", "<html ", "<style>", "</script", "<"):
        language.visible(part * 300_000)
        language.declared(part * 300_000)


def test_language_odd_rows(spark):
    docs = table(spark, FOLDER, "documents")
    pages = spark.createDataFrame([(1, None, None), (2, "http://x.de/", ""), (3, "http://x.de/", "<script>a")], "page_id long, url string, html string")
    assert language.identify(pages, docs, Scratch(spark, "t")).count() == 3
    assert language.identify(pages.limit(0), docs, Scratch(spark, "t")).count() == 0
    assert {r.lang for r in language.identify(pages, docs.limit(0), Scratch(spark, "t")).collect()} == {None}
    assert language.declared('<HTML class="a" lang = "DE-at">') == "de"


# Toxicity


def test_kernel_by_enumeration():
    from itertools import combinations

    def features(s):
        out = {}
        for at in combinations(range(len(s)), toxicity.ORDER):
            k = tuple(s[i] for i in at)
            out[k] = out.get(k, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    for a, b in (("idiot", "idxiot"), ("banana", "bandana"), ("abc", "xyz")):
        x, y = features(a), features(b)
        dot = sum(v * y.get(k, 0) for k, v in x.items())
        assert toxicity.kernel(a, b) == pytest.approx(dot / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())))
    landmarks = toxicity.Landmarks(["idiot", "bandana"])
    found = landmarks.values(["idxiot", "banana", "zzzz", "ab"])
    assert set(found) == {"idxiot", "banana"}
    assert found["idxiot"][0] == pytest.approx(toxicity.kernel("idxiot", "idiot"), abs=1e-5)


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    labels = table(spark, "/root/testdata/sf0.1", "labels")
    made = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in made["doc_id"])
    y, p = made["toxic"] == 1, made["predicted"] == 1
    assert (p & y).sum() / y.sum() > 0.8 and (p & ~y).sum() / (~y).sum() < 0.02


def fitted(spark, texts, labels):
    return toxicity.train_on(spark.createDataFrame(list(zip(texts, labels, strict=True)), "text string, y int"), Scratch(spark, "t"))


def test_gapped_insults_score_high(spark):
    r = random.Random(5)
    texts = [" ".join(words(k, 40)) + "." for k in range(200)]
    toxic = [f"{t[:60]} {r.choice(['blockhead', 'nitwit'])} {t[60:]}" for t in texts[:60]]
    model = fitted(spark, texts + toxic, [0] * 200 + [1] * 60)
    score = lambda t: toxicity._scores(model, [t])[0]
    assert score("what a b.l-o.c.k.h-e.a.d you are") > 0.5 and score("what a n i t w i t you are") > 0.5
    assert score("what a blockhhead you are") > 0.5 and score("what a blockzhead you are") > 0.5 and score(texts[0]) < 0.5 and score("") < 0.5


@pytest.fixture(scope="module")
def insults(spark):
    texts = [" ".join(words(k, 40)) + "." for k in range(200)]
    said = ["nitwit", "poopoo", "дурак", "βλακας"]
    return fitted(spark, texts + [f"{t[:60]} {said[k % 4]} {t[60:]}" for k, t in enumerate(texts[:80])], [0] * 200 + [1] * 80)


@pytest.mark.parametrize("form", ["n, i, t, w, i, t", "n- i- t- w- i- t", "n. i. t. w. i. t.", "(n) (i) (t) (w) (i) (t)", "n\ni\nt\nw\ni\nt", "N I T W I T", "p o o p o o", "д у р а к", "д, у, р, а, к", "β λ α κ α ς", "n, i, t, w, i, t " + "and so on " * 3000])
def test_spelled_insults_of_any_script_score_high(insults, form):
    model = insults
    rows, _ = toxicity.Matcher(toxicity.Landmarks(model.words)).sentences([f"see the {form} you are"])[0]
    assert rows and max(model.margins(rows)) > 0
    if len(form) < 100:
        assert toxicity._scores(model, [f"see the {form} you are"])[0] > 0.5
    assert toxicity._scores(model, ["a b, c d. e f"])[0] < 0.5


def test_every_letter_is_its_own():
    assert toxicity.kernel("бобик", "чочик") < 0.5 and toxicity.kernel("дурак", "дурак") == pytest.approx(1)
    many = toxicity.Landmarks(["дурак", "idiot", "".join(map(chr, range(0x4E00, 0x4E14))), *("".join(map(chr, range(a, a + 9))) for a in range(0x5000, 0x5100, 9))])
    assert many.place is None  # too many letters for a table of triples
    few = toxicity.Landmarks(["дурак", "idiot"])
    for w in ("дуррак", "idi0t", "чурак", "xyz"):
        a, b = many.values([w]).get(w), few.values([w]).get(w)
        assert (a is None) == (b is None) and (a is None or a[:2] == pytest.approx(b))
    assert few.values(["дуррак"])["дуррак"][0] == pytest.approx(toxicity.kernel("дуррак", "дурак"), abs=1e-5)


def test_toxicity_memory_is_bounded_in_characters(monkeypatch):
    monkeypatch.setattr(toxicity, "REMEMBERED_CHARS", 1000)
    matcher = toxicity.Matcher(toxicity.Landmarks(["nitwit"]))
    for k in range(20):
        matcher.sentences([f"{'x' * 900}{k}"])
    assert len(matcher.cold) <= 2


def test_toxicity_scores_are_the_model_s(spark, insults):
    """The score of a text from its definition, with kernels by enumeration."""
    text = "You nitwitt. A word\nthe д у р а к of all!"
    rows = []
    for strings in (["you", "nitwitt"], ["a", "word"], ["the", "дурак", "of", "all"]):
        row = [max((k if (k := toxicity.kernel(s, w)) >= toxicity.SUPPORT else 0.0) for s in strings if len(s) >= 3) if any(len(s) >= 3 for s in strings) else 0.0 for w in insults.words]
        rows.append(row)
    margins = [np.array(r) @ insults.map @ insults.weights + insults.bias for r in rows if any(r)] + [insults.bias]
    x = np.dot([1, max(margins), np.log1p(sum(m > 0 for m in margins)), np.log1p(30)], insults.logit)
    got = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), insults).first()
    assert got.score == pytest.approx(1 / (1 + np.exp(-x)), abs=1e-5)


def test_toxicity_keeps_known_words_when_its_memory_is_emptied(monkeypatch):
    monkeypatch.setattr(toxicity, "REMEMBERED", 3)
    matcher = toxicity.Matcher(toxicity.Landmarks(["nitwit"]))
    assert len(matcher.sentences(["what a nitwit you are"])[0][0]) == 1
    assert len(matcher.sentences(["this nitwit has new words"])[0][0]) == 1


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    one = spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, one)
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0}
    assert toxicity.keep_clean(docs, model).count() == docs.count()
    assert toxicity.train(docs, one.limit(0)).constant == 0.0
    assert toxicity.score(docs.limit(0), model).count() == 0


# SentencePiece


def test_an_unspaced_text_takes_linear_time(library):
    e, r = sp.encoder(sp.model_path()), random.Random(7)
    text = "".join(r.choice("abcdefghij") for _ in range(400_000))
    assert e.encode(text) == library.encode(text, add_bos=True, add_eos=True)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sp.model_path())


def test_encoding_is_the_library_s(library):
    e, r = sp.encoder(sp.model_path()), random.Random(6)
    letters = "aaaabeth  in▁ \n\té中😀<s></s>\x00́ﬁA0099²..the '"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    texts += ["", " ", "   ", "a" * 5000, " x  y ", "▁", "m².", "the" * 700]
    for t in texts:
        ids = library.encode(t, add_bos=True, add_eos=True)
        assert e.encode(t) == ids
        assert e.both(t)[1].decode() == library.decode(ids) == e.decode(ids)


def test_decoding_any_ids(library):
    e, r = sp.encoder(sp.model_path()), random.Random(8)
    for _ in range(3000):
        ids = [r.choice([0, 1, 2, r.randrange(3, 259), r.randrange(259, 32000)]) for _ in range(r.randint(0, 6))]
        assert e.decode(ids) == library.decode(ids)


def test_documents_are_encoded_whole(spark, library):
    docs = spark.createDataFrame(documents(), SCHEMA)
    got = {r.doc_id: (r.ids, r.decoded) for r in sp.encode_documents(docs).collect()}
    for i, text, *_ in documents():
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        assert got[i] == (ids, library.decode(ids))
    assert sp.digest_documents(docs.limit(0)).count() == 0


# All operators


def test_every_operator_is_registered():
    import __spark_entry__

    names = ["op1_minhash", "op2_language", "op3_decontam", "op4_url_filter", "op5_chat", "op6_audio", "op7_toxicity", "op8_warc", "op9_line_dedup", "op10_sentencepiece", "pipeline"]
    assert set(names) <= set(__spark_entry__.queries())


def test_operators_take_columns_of_any_name(spark):
    """Extra columns with the names of an operator's own."""
    import itertools

    names = ["id", "hash", "row", "key", "sig", "n", "band", "value", "node", "comp", "host", "path", "rule", "trust", "ll", "suffix", "declared", "lang2", "payload", "digest", "refers_to", "media", "feature", "ids", "decoded", "held_out", "score"]
    extra = "".join(f", `{c}` int" for c in names)
    docs = spark.createDataFrame([(k, f"words of text number {k} that stand here", "en", "s", 1, *range(len(names))) for k in range(5)], SCHEMA + extra)
    pages = spark.createDataFrame([(k, f"http://h{k}.com/en/", f"<html lang=en><p>words {k}", *range(len(names))) for k in range(5)], "page_id long, url string, html string" + extra)
    bench = spark.createDataFrame([(1, "words of text number 3 that stand here")], "item_id long, text string")
    from loomgrid.llm import audio, minhash, warc

    scratch = Scratch(spark, "t")
    made = [
        minhash.near_components(docs, scratch), decontam.contaminated(docs, bench).select("doc_id").distinct(), language.identify(pages, docs, scratch), url_filter.judge(pages, scratch),
        audio.digest(audio.audio_tensors(audio.store_media(docs, scratch))), toxicity.score(docs, toxicity.Model()), warc.read_archives(warc.write_archives(pages, scratch)), sp.digest_documents(docs), sp.encode_documents(docs),
    ]
    assert [x.count() for x in made] == [*itertools.repeat(5, 9)]  # any digit is one edit away


def test_very_long_and_repeated_pages(spark):
    long = "<p>" + "les mots de la page " * 100_000
    rows = [(1, "http://a.fr/", long), (1, "http://a.fr/", long), (2, "http://a.fr/", "<a href='http://b.net/es/'>x</a>" * 20_000), (3, "http://b.net/es/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = language.identify(pages, table(spark, FOLDER, "documents"), Scratch(spark, "t")).collect()
    assert sorted(r.page_id for r in found) == [1, 1, 2, 3] and {r.lang for r in found if r.page_id == 1} == {"fr"}
    assert len({(r.lang, r.confidence) for r in found if r.page_id == 1}) == 1
    judged = {(r.page_id, r.verdict) for r in url_filter.judge(pages, Scratch(spark, "t")).collect()}
    assert (3, "block") in judged and len(judged) == 3


def test_equally_likely_languages_go_by_name(spark):
    scored = spark.createDataFrame([(1, "h", "h", "h", "", [0.0, 0.0])], "page_id long, host string, domain string, suffix string, declared string, ll array<double>")
    assert language.fuse(scored, ["de", "en"], Scratch(spark, "t")).first().lang == "de"
