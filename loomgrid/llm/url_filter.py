"""URL rules, and for urls without a rule a verdict by link-graph propagation over hosts.

Trust starts at hosts with pages that a rule allows and follows links; distrust starts at hosts with pages
that a rule blocks and follows links backwards, from the linked host to those that link to it.  Both are
personalised PageRank over 1 - DAMPING: a host's score is its seed plus DAMPING times what its neighbours pass
on, each dividing its score by the weights of its links.  A seed is the share of the host's pages under such a
rule, so a host without neighbours keeps a score in 0..1.  A host is blocked by the method if its distrust is at
least LIMIT and above its trust.

So a score isn't bound to 0..1: it is what a host is itself, plus what reaches it.  LIMIT is half of what a host with
blocked pages only starts with: by its own pages alone a host is blocked if half of them are, and one without such pages
if the blocked hosts that it links to pass it as much.  Many links from trusted hosts raise its trust in the same
unit, so they outweigh it.

Links are the ``href`` values of a page, resolved against its ``base`` element or its own address, counted by pair of
different hosts (links within a host move nothing between hosts), so what is iterated has a row a linked pair of
hosts.  Rounds go on until no score moves by more than TOLERANCE, which they do, as each passes on DAMPING of the rest.

Edge cases: a null url, or one without ``://``, has an empty host and path and takes part as the host '';
null html has no links; of rules of equal length on a url none can differ in host, so no ties arise but
between a rule and its repetition; a host whose distrust equals its trust is allowed; rows that repeat are pages of
their own; very long pages are whole; an empty table gives no rows; extra columns, of any name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

# Fixed values of the rule set: (action, host, path prefix).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
DAMPING, LIMIT, TOLERANCE = 0.85, 0.5, 1e-4
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]*)"
BASE = r"(?i)<base\s[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]*)"
ABSOLUTE = "(?i)^([a-z][a-z0-9+.-]*:)?//"


def _lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where ``://`` is missing."""
    has = F.instr(url, "://") > 0
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, _lower(host)).otherwise(""), F.when(has, path).otherwise("")


def match_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its action; null where none fits."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verb, on, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == on) | F.endswith(host, F.lit("." + on))) & F.startswith(path, F.lit(prefix))
        rule, action = F.when(fits, on + prefix).otherwise(rule), F.when(fits, verb).otherwise(action)
    return rule, action


def _linked(to: Column, own: Column) -> Column:
    """The host of a link: its own if it is absolute, else the page's."""
    return F.when(F.regexp_like(to, F.lit(ABSOLUTE)), split_url(F.concat(F.lit("x:"), F.substring(to, F.instr(to, "//"), F.length(to))))[0]).otherwise(own)


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, w): links between different hosts."""
    page = pages.select(split_url(F.col(url_col))[0].alias("src"), F.col(html_col).alias("html"))
    # A link without a host of its own leaves the page's host only by a base element.
    base = _linked(F.regexp_extract("html", BASE, 1), F.col("src"))
    links = page.select("src", base.alias("base"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("to"))
    links = links.where(F.regexp_like("to", F.lit(ABSOLUTE)) | (F.col("base") != F.col("src")) & ~F.regexp_like("to", F.lit("(?i)^(#|[a-z][a-z0-9+.-]*:)")))
    links = links.select("src", _linked(F.col("to"), F.col("base")).alias("dst"))
    return links.where("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def propagate(seeds: DataFrame, links: DataFrame, scratch: Scratch, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust0, distrust0) and links (src, dst, w).

    Every round is written, so lineage stays short, and joins on hosts; rounds end when no score moves by more
    than the tolerance.
    """
    edges = links.select("src", "dst", "w", F.lit(True).alias("forward")).unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", F.lit(False).alias("forward")))
    out = edges.groupBy("src", "forward").agg(F.sum("w").alias("total"))
    edges = scratch.save(edges.join(out, ["src", "forward"]).select("src", "dst", "forward", (F.col("w") / F.col("total")).alias("share")))
    nodes = seeds.select("host").unionByName(links.select(F.col("src").alias("host"))).unionByName(links.select(F.col("dst").alias("host"))).distinct()
    base = nodes.join(seeds, "host", "left").na.fill(0.0, ["trust0", "distrust0"])
    base = scratch.save(base)
    score = base.select("host", F.col("trust0").alias("trust"), F.col("distrust0").alias("distrust"))
    saved = None
    while True:
        flow = edges.join(score.withColumnRenamed("host", "src"), "src").groupBy(F.col("dst").alias("host")).agg(
            F.sum(F.when(F.col("forward"), F.col("share") * F.col("trust"))).alias("t"), F.sum(F.when(~F.col("forward"), F.col("share") * F.col("distrust"))).alias("d")
        )
        mix = lambda seed, got: F.col(seed) + DAMPING * F.coalesce(got, F.lit(0.0))
        fresh = base.join(flow, "host", "left").select("host", mix("trust0", F.col("t")).alias("trust"), mix("distrust0", F.col("d")).alias("distrust"))
        fresh = scratch.save(fresh)
        old = score.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        moved = fresh.join(old, "host").agg(F.max(F.greatest(F.abs(F.col("trust") - F.col("t0")), F.abs(F.col("distrust") - F.col("d0"))))).first()[0]
        if saved is not None:
            scratch.drop(saved)
        score = saved = fresh
        if (moved or 0.0) <= tolerance:
            return score


def judge(pages: DataFrame, scratch: Scratch, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page."""
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, action = match_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), action.alias("action"))
    share = lambda verb: F.avg(F.when(F.col("action") == verb, 1.0).otherwise(0.0))
    seeds = rows.groupBy("host").agg(share("allow").alias("trust0"), share("block").alias("distrust0"))
    links = scratch.save(host_links(pages, url_col, html_col))
    hosts = scratch.save(propagate(scratch.save(seeds), links, scratch))
    method = F.when((F.col("distrust") >= LIMIT) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return rows.join(hosts, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("action", method).alias("verdict"), F.round("trust", 6).alias("trust"), F.round("distrust", 6).alias("distrust"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), Scratch(spark, "urls")).drop("trust", "distrust")


def sql(pages: str = "pages", rounds: int = 30) -> str:
    """DuckDB SQL for the verdicts, with the rounds written out one by one; on tables without links between hosts one
    round is exact, on others it takes as many as bring DAMPING to that power below what counts."""
    fits = [(f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')", h + p, v) for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    rest = "substr(url, instr(url, '://') + 3)"
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    host_of = lambda x, own: f"CASE WHEN regexp_matches({x}, {quoted(ABSOLUTE)}) THEN {low(f"regexp_extract(substr({x}, instr({x}, '//') + 2), '^([^/?#]*)', 1)")} ELSE {own} END"
    steps = "".join(f"""
, f{k} AS (SELECT dst AS host, sum(CASE WHEN forward THEN share * trust END) AS t, sum(CASE WHEN NOT forward THEN share * distrust END) AS d
    FROM edges JOIN s{k - 1} ON src = host GROUP BY dst)
, s{k} AS MATERIALIZED (SELECT b.host, trust0 + {DAMPING} * coalesce(t, 0) AS trust, distrust0 + {DAMPING} * coalesce(d, 0) AS distrust FROM base b LEFT JOIN f{k} f ON b.host = f.host)""" for k in range(1, rounds + 1))  # fmt: skip
    return f"""
WITH parts AS MATERIALIZED (
    SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN {low(f"regexp_extract({rest}, '^([^/?#]*)', 1)")} ELSE '' END AS host,
        CASE WHEN instr(url, '://') > 0 THEN regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM {pages}
), judged AS MATERIALIZED (
    SELECT page_id, host, path, {case(1)} AS rule, {case(2)} AS action FROM parts
), based AS (
    SELECT host AS src, html, {host_of(f"regexp_extract(html, {quoted(BASE)}, 1)", "host")} AS base FROM parts WHERE html IS NOT NULL
), hrefs AS (
    SELECT src, base, unnest(regexp_extract_all(html, {quoted(HREF)}, 1)) AS t FROM based
), links AS MATERIALIZED (
    SELECT src, dst, count(*)::DOUBLE AS w FROM (
        SELECT src, {host_of("t", "base")} AS dst FROM hrefs WHERE regexp_matches(t, {quoted(ABSOLUTE)}) OR NOT regexp_matches(t, '(?i)^(#|[a-z][a-z0-9+.-]*:)')
    ) WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL
), edges AS MATERIALIZED (
    SELECT src, dst, forward, w / sum(w) OVER (PARTITION BY src, forward) AS share
    FROM (SELECT src, dst, w, true AS forward FROM links UNION ALL SELECT dst, src, w, false FROM links)
), seeds AS (
    SELECT host, avg(CASE WHEN action = 'allow' THEN 1.0 ELSE 0.0 END) AS trust0, avg(CASE WHEN action = 'block' THEN 1.0 ELSE 0.0 END) AS distrust0 FROM judged GROUP BY host
), nodes AS (
    SELECT host FROM seeds UNION SELECT src FROM links UNION SELECT dst FROM links
), base AS MATERIALIZED (
    SELECT n.host, coalesce(trust0, 0) AS trust0, coalesce(distrust0, 0) AS distrust0
    FROM nodes n LEFT JOIN seeds s ON n.host = s.host
), s0 AS (SELECT host, trust0 AS trust, distrust0 AS distrust FROM base){steps}
SELECT page_id, j.host, path, rule, coalesce(action, CASE WHEN distrust >= {LIMIT} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN s{rounds} s ON j.host = s.host
"""


SQL = sql()
