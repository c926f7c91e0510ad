"""Edge tables: normalisation, directional features, walks and link candidates."""

from __future__ import annotations

from math import gcd

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrid.functions.columns import ratio


def normalize(edges: DataFrame, directed: bool = True, relation: str | None = None) -> DataFrame:
    """(src, dst[, relation], w): edges summed; undirected ones once from the lesser to the greater end."""
    by = ["src", "dst", *([relation] if relation else [])]
    if not directed:
        edges = edges.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
    return edges.groupBy(*by).agg(F.sum("w").alias("w"))


def reversed_edges(edges: DataFrame, relation: str, prefix: str = "rev_") -> DataFrame:
    """The edges and their reverses, whose relation has the prefix."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.concat(F.lit(prefix), F.col(relation)).alias(relation), "w")
    return edges.select("src", "dst", relation, "w").unionByName(back)


def indexed(edges: DataFrame) -> DataFrame:
    """(node, index): nodes numbered from 0 in sorted order, without a single-task window."""
    from loomgrid.operators.ordered import numbered

    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return numbered(nodes, "node", (), "index")


def pair_nodes(edges: DataFrame, to_pair: str = "source_to_pair", to_target: str = "pair_to_target", prefix: str = "pair", keep: bool = False) -> DataFrame:
    """(src, dst, relation): every source-target pair as a node between the two; with ``keep`` the edges too."""
    s, t = F.col("src").cast("string"), F.col("dst").cast("string")
    pair = F.concat_ws(":", F.lit(prefix), s, t)
    parts = F.array(F.struct(s.alias("src"), pair.alias("dst"), F.lit(to_pair).alias("relation")), F.struct(pair.alias("src"), t.alias("dst"), F.lit(to_target).alias("relation")))
    out = edges.select("src", "dst").distinct().select(F.explode(parts).alias("x")).select("x.*")
    return out.unionByName(edges.select(s.alias("src"), t.alias("dst"), F.col("relation").cast("string").alias("relation"))) if keep else out


def directional(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, out_w, in_w, imbalance, partners, reciprocity): loops count on both sides.

    imbalance = (out - in) / (out + in) by weight; reciprocity is the share of partners linked both ways.
    """
    e = normalize(edges)
    out = e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"), F.sum("w").alias("out_w"))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"), F.sum("w").alias("in_w"))
    both = e.select(F.col("src").alias("node"), F.col("dst").alias("p")).unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("p"))).where("node <> p")
    pair = both.groupBy("node", "p").agg(F.count(F.lit(1)).alias("c")).groupBy("node").agg(F.count(F.lit(1)).alias("partners"), F.avg((F.col("c") == 2).cast("double")).alias("reciprocity"))
    rows = out.join(into, "node", "full_outer").join(pair, "node", "left").na.fill(0)
    return rows.withColumn("imbalance", ratio(F.col("out_w") - F.col("in_w"), F.col("out_w") + F.col("in_w"), 0.0))


def asymmetry(edges: DataFrame) -> DataFrame:
    """(src, dst, asymmetry) for src < dst: (w there - w back) / (sum)."""
    e = normalize(edges).where("src <> dst")
    there, back = e.where("src < dst"), e.where("src > dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("v"))
    rows = there.join(back, ["src", "dst"], "full_outer").na.fill(0.0, ["w", "v"])
    return rows.select("src", "dst", ((F.col("w") - F.col("v")) / (F.col("w") + F.col("v"))).alias("asymmetry"))


def time_weighted_degree(edges: DataFrame, half_life: float) -> DataFrame:
    """(node, degree): out-weights halved for every half_life before the last timestamp."""
    last = edges.agg(F.max("timestamp").alias("__t"))
    decay = F.pow(F.lit(0.5), (F.col("__t") - F.col("timestamp")) / half_life)
    return edges.crossJoin(F.broadcast(last)).groupBy(F.col("src").alias("node")).agg(F.sum(F.col("w") * decay).alias("degree"))


#: The names of a node's directional features, and the measure that each one is.
DIRECTIONAL = {
    "source_target_embedding": "there", "target_source_embedding": "back", "forward_reverse_similarity_delta": "delta",
    "source_outbound_strength": "out", "target_inbound_strength": "into", "flow_imbalance_ratio": "imbalance", "directed_temporal_drift": "drift",
    "source_target_affinity": "out_share", "target_source_affinity": "in_share", "forward_flow_weight": "out", "reverse_flow_weight": "into",
    "flow_asymmetry": "asymmetry", "source_out_degree_weighted": "out", "target_in_degree_weighted": "into", "od_forward_similarity": "there",
    "od_reverse_similarity": "back", "origin_outbound_strength": "out", "destination_inbound_strength": "into", "forward_flow_volume_30d": "out",
    "reverse_flow_volume_30d": "into", "directional_market_drift": "drift", "directional_acceptance_rate": "out_share", "directional_price_pressure": "imbalance",
}


def _cosine(edges: DataFrame, vectors: DataFrame, own: str, other: str, name: str) -> DataFrame:
    """(node, name): each node's vector against the mean of those at its edges' other ends; an edge that repeats counts again."""
    v = vectors.select("node", F.posexplode("v").alias("k", "x"))
    mean = edges.join(v.withColumnRenamed("node", other), other).groupBy(F.col(own).alias("node"), "k").agg(F.avg("x").alias("m"))
    dot, sizes = F.sum(F.col("x") * F.col("m")), F.sum(F.col("x") * F.col("x")) * F.sum(F.col("m") * F.col("m"))
    return v.join(mean, ["node", "k"]).groupBy("node").agg(ratio(dot, F.sqrt(sizes), 0.0).alias(name))


def directional_features(edges: DataFrame, vectors: DataFrame, prefix: str, only: tuple[str, ...] = ()) -> DataFrame:
    """(node, <prefix>_<name>...): the DIRECTIONAL features, all or those named, of every node of ``vectors`` (node, v array);
    ``edges`` is (src, dst, w, timestamp)."""
    names = [n for n in DIRECTIONAL if not only or n in only]
    if not names:
        raise ValueError("no such feature")
    ends = F.array(F.struct(F.col("src").alias("node"), F.lit(True).alias("out")), F.struct(F.col("dst").alias("node"), F.lit(False).alias("out")))
    flat = edges.select("w", (F.col("w") * F.col("timestamp")).alias("wt"), F.explode(ends).alias("x")).select("w", "wt", "x.*")
    some = lambda out, c: F.sum(F.when(F.col("out") == out, F.col(c)).otherwise(0.0))
    sums = flat.groupBy("node").agg(some(True, "w").alias("out"), some(False, "w").alias("into"), some(True, "wt").alias("ot"), some(False, "wt").alias("it"))
    rows = vectors.select("node").join(sums, "node", "left").join(_cosine(edges, vectors, "src", "dst", "there"), "node", "left").join(_cosine(edges, vectors, "dst", "src", "back"), "node", "left").na.fill(0.0)
    both = F.col("out") + F.col("into")
    rows = rows.withColumns({
        "delta": F.col("there") - F.col("back"), "imbalance": ratio(F.col("out") - F.col("into"), both, 0.0), "asymmetry": ratio(F.abs(F.col("out") - F.col("into")), both, 0.0),
        "out_share": ratio(F.col("out"), both, 0.0), "in_share": ratio(F.col("into"), both, 0.0),
        "drift": F.when((F.col("out") == 0) | (F.col("into") == 0), 0.0).otherwise(F.col("ot") / F.col("out") - F.col("it") / F.col("into")),
    })
    return rows.select("node", *[F.col(DIRECTIONAL[n]).alias(f"{prefix}_{n}") for n in names])


def _draw(seed: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]))


def metapath_walks(starts: DataFrame, edges: DataFrame, relations: list[str], seed: str = "walk") -> DataFrame:
    """(walk, step, node): from each start, one seeded edge of each relation in turn; a walk ends where there is none.

    One join a step; the chosen edge is the one of least seeded hash.
    """
    front = starts.select(F.col("node").alias("walk"), F.col("node"))
    out = front.select("walk", F.lit(0).alias("step"), "node")
    for k, rel in enumerate(relations, 1):
        some = edges.where(F.col("relation") == rel).select(F.col("src").alias("node"), F.col("dst").alias("to"))
        moved = front.join(some, "node").withColumn("__h", _draw(f"{seed}{k}", F.col("walk"), F.col("to")))
        front = moved.groupBy("walk").agg(F.min_by("to", "__h").alias("node"))
        out = out.unionByName(front.select("walk", F.lit(k).alias("step"), "node"))
    return out


def temporal_walks(starts: DataFrame, edges: DataFrame, length: int, gap: float = 0.0, seed: str = "time") -> DataFrame:
    """(walk, step, node, at): every edge is strictly later than the one before plus ``gap``."""
    front = starts.select(F.col("node").alias("walk"), "node", F.lit(None).cast("double").alias("at"))
    out = front.select("walk", F.lit(0).alias("step"), "node", "at")
    some = edges.select(F.col("src").alias("node"), F.col("dst").alias("to"), F.col("timestamp").cast("double").alias("t"))
    for k in range(1, length + 1):
        moved = front.join(some, "node").where(F.col("at").isNull() | (F.col("t") > F.col("at") + gap)).withColumn("__h", _draw(f"{seed}{k}", F.col("walk"), F.col("to"), F.col("t").cast("decimal(38,6)")))
        front = moved.groupBy("walk").agg(F.min_by(F.struct(F.col("to").alias("node"), F.col("t").alias("at")), "__h").alias("n")).select("walk", "n.node", "n.at")
        out = out.unionByName(front.select("walk", F.lit(k).alias("step"), "node", "at"))
    return out


def negative_edges(edges: DataFrame, nodes: DataFrame, per_edge: int, seed: str = "neg") -> DataFrame:
    """(src, target, dst): for each edge src -> target, ``per_edge`` different seeded nodes that src has no edge to, or all
    of them where there are fewer; ``nodes`` is (node, index) numbered from 0.

    A draw is a seeded start and step over the node numbers, a step that shares no factor with their number, so the walk
    meets every node once.  An edge has at most as many candidates in vain as its source has targets, so the first
    per_edge + targets steps hold enough, and nothing of the size nodes x nodes is made but for sources with an edge to
    nearly every node.
    """
    n = nodes.count()
    number = lambda salt: F.conv(F.substring(_draw(f"{seed}{salt}", F.col("src"), F.col("target")), 1, 12), 16, 10).cast("long")
    known = edges.select("src", F.col("dst").alias("target")).distinct()
    rows = known.join(known.groupBy("src").agg(F.count(F.lit(1)).alias("__d")), "src")
    step = next(s for s in range(max(1, int(n * 0.618)), 0, -1) if gcd(s, n) == 1) if n else 1
    start = F.pmod(number("start"), F.lit(max(1, n)))
    rows = rows.withColumn("__k", F.explode(F.sequence(F.lit(0), F.least(F.col("__d") + per_edge, F.lit(n)).cast("int") - 1)))
    rows = rows.withColumn("index", F.pmod(start + F.col("__k").cast("long") * step, F.lit(max(1, n))))
    cand = rows.join(nodes.select("index", F.col("node").alias("dst")), "index")
    free = cand.join(known.select("src", F.col("target").alias("dst")), ["src", "dst"], "left_anti")
    return free.withColumn("__r", F.row_number().over(W.partitionBy("src", "target").orderBy("__k"))).where(F.col("__r") <= per_edge).select("src", "target", "dst")


def diffuse(edges: DataFrame, values: DataFrame, steps: int) -> DataFrame:
    """(node, v) after ``steps`` of row-normalised averaging; nodes without out-edges keep their value."""
    sums = edges.groupBy("src").agg(F.sum("w").alias("__s"))
    share = edges.join(sums, "src").select("src", "dst", (F.col("w") / F.col("__s")).alias("s"))
    for _ in range(steps):
        got = share.join(values.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("s") * F.col("v")).alias("__v"))
        values = values.join(got, "node", "left").select("node", F.coalesce("__v", "v").alias("v"))
    return values


def choice_softmax(df: DataFrame, decision: str, ident: str, utility: str, temperature: float = 1.0) -> DataFrame:
    """(decision, ident, probability, chosen): utilities plus 0.15 of their distance to the decision's mean."""
    w = W.partitionBy(decision)
    u = F.col(utility) + 0.15 * (F.col(utility) - F.avg(utility).over(w))
    rows = df.select(decision, ident, u.alias("u")).withColumn("__e", F.exp((F.col("u") - F.max("u").over(w)) / temperature))
    rows = rows.withColumn("probability", F.col("__e") / F.sum("__e").over(w))
    return rows.select(decision, ident, "probability", (F.row_number().over(w.orderBy(F.desc("u"), ident)) == 1).alias("chosen"))


def constrained_pick(df: DataFrame, decision: str, ident: str, score: str, penalty: str, feasible: Column) -> DataFrame:
    """(decision, ident, fallback): the best score less penalty among feasible rows, or among all without any."""
    rows = df.withColumn("__ok", feasible).withColumn("__any", F.max(feasible).over(W.partitionBy(decision)))
    rows = rows.where(F.col("__ok") | ~F.col("__any")).withColumn("__v", F.col(score) - F.col(penalty))
    return rows.withColumn("__k", F.row_number().over(W.partitionBy(decision).orderBy(F.desc("__v"), ident))).where("__k = 1").select(decision, ident, (~F.col("__any")).alias("fallback"))


def fit_embeddings(df: DataFrame, key: str, y: str, dim: int, strength: float = 10.0, rounds: int = 4, seed: str = "embedding") -> DataFrame:
    """(key, v): a vector an id, so that a common linear head of them gives the id's mean target; each is drawn towards a
    seeded prior vector by ``strength`` rows, and clamped to -1..1.

    Ids are grouped first; head and bias come from sums of dim x dim size, a pass a round.
    """
    draw = lambda k: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("key").cast("string"), F.lit(str(k)))), 1, 12), 16, 10).cast("double") / float(1 << 47) - 1.0
    raw = F.array(*[draw(k) for k in range(dim)])
    rows = df.groupBy(F.col(key).alias("key")).agg(F.avg(F.col(y).cast("double")).alias("m"), F.count(F.lit(1)).cast("double").alias("n")).withColumn("raw", raw)
    size = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.withColumn("prior", F.transform("raw", lambda x: x / size)).drop("raw")
    head = np.zeros(dim)
    head[0] = 1.0
    bias = float(rows.agg(F.sum(F.col("m") * F.col("n")) / F.sum("n")).first()[0] or 0.0)

    def vector(head: np.ndarray, bias: float) -> Column:
        """The prior moved along the head by the id's residual, as ridge regression on one id's rows would."""
        h = F.array(*[F.lit(float(x)) for x in head])
        dot = F.aggregate(F.zip_with("prior", h, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        gain = F.col("n") * (F.col("m") - bias - dot) / (strength + F.col("n") * float(head @ head))
        return F.zip_with("prior", h, lambda a, b: a + gain * b)

    for _ in range(rounds):
        now = rows.withColumn("v", vector(head, bias))
        at = lambda i: F.element_at("v", i + 1)
        sums = [F.sum(F.col("n") * at(i) * at(j)) for i in range(dim) for j in range(i, dim)] + [F.sum(F.col("n") * at(i) * F.col("m")) for i in range(dim)] + [F.sum(F.col("n") * at(i)) for i in range(dim)]
        total = [float(x) for x in now.agg(*[x.alias(f"s{k}") for k, x in enumerate(sums)], F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("nm")).first()]
        gram, it = np.zeros((dim, dim)), iter(total)
        for i in range(dim):
            for j in range(i, dim):
                gram[i, j] = gram[j, i] = next(it)
        xy, x1 = np.array([next(it) for _ in range(dim)]), np.array([next(it) for _ in range(dim)])
        n, nm = next(it), next(it)
        bias = (nm - float(head @ x1)) / n
        head = np.linalg.solve(gram + strength * np.eye(dim), xy - bias * x1 + strength * head)
    return rows.select("key", F.transform(vector(head, bias), lambda x: F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))).alias("v"))


def embedding_lookup(df: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """``df`` with the key's vector, or the mean vector of all; ``table`` is (key, v array)."""
    mean = table.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("x")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("__mean"))
    rows = df.join(table.select(F.col("key").alias("__k"), "v"), F.col(key) == F.col("__k"), "left").crossJoin(F.broadcast(mean))
    return rows.withColumn("known", F.col("__k").isNotNull()).withColumn("v", F.coalesce("v", "__mean")).drop("__k", "__mean")
