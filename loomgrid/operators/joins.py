"""Joins with geometry or fallbacks, as equality joins on derived keys.

Distance joins cut the plane into square cells of the distance's size: rows can only match in the same or a
neighbouring cell, so each left row is repeated for nine cells and the join is on (cell x, cell y).  A crowded
cell is split by Spark's skew handling; no pair outside neighbouring cells is ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrid.functions.geometry import in_polygon, squared_euclidean
from loomgrid.operators.ordered import bucket_of
from loomgrid.sources.shared import Tables


def _cell(v: str, size: float) -> Column:
    return F.floor(F.col(v) / size).cast("long")


def within(left: DataFrame, right: DataFrame, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """Pairs (all of left's columns, right's prefixed r_) at most ``radius`` apart, with ``distance``."""
    a = left.withColumn("__cx", F.explode(F.sequence(_cell(x, radius) - 1, _cell(x, radius) + 1))).withColumn("__cy", F.explode(F.sequence(_cell(y, radius) - 1, _cell(y, radius) + 1)))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], _cell(x, radius).alias("__cx"), _cell(y, radius).alias("__cy"))
    d2 = squared_euclidean(x, y, f"r_{x}", f"r_{y}")
    return a.join(b, ["__cx", "__cy"]).where(d2 <= radius * radius).withColumn("distance", F.sqrt(d2)).drop("__cx", "__cy")


def self_pairs(df: DataFrame, ident: str, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """Pairs with ident < r_ident at most ``radius`` apart.

    Places are paired first, once each, and their rows looked up, so every pair that is made and not kept is one of a kept
    one's other order."""
    spots = df.select(F.col(x).alias("__x"), F.col(y).alias("__y")).distinct()
    near = within(spots, spots, radius, "__x", "__y").withColumnRenamed("distance", "__d")
    other = df.select(*[F.col(c).alias(f"r_{c}") for c in df.columns])
    rows = df.join(near, (F.col(x) == F.col("__x")) & (F.col(y) == F.col("__y"))).drop("__x", "__y")
    out = rows.join(other, (F.col("r___x") == F.col(f"r_{x}")) & (F.col("r___y") == F.col(f"r_{y}")) & (F.col(ident) < F.col(f"r_{ident}")))
    return out.select(*df.columns, *other.columns, F.col("__d").alias("distance"))


def nearest(left: DataFrame, right: DataFrame, ident: str, k: int, radius: float, x: str = "x", y: str = "y", least: int = 0) -> DataFrame:
    """Each left row's k nearest right rows within ``radius`` (ties by id, never itself), ranked from 1; left rows
    with fewer than ``least`` are absent."""
    return nearest_any(left, right, ident, k, x, y, least, radius)


def beyond(df: DataFrame, others: DataFrame, radius: float, ident: str, x: str = "x", y: str = "y") -> DataFrame:
    """Rows farther than ``radius`` from every row of ``others``; places are compared, once each."""
    spots = df.select(x, y).distinct()
    near = within(spots, others.select(x, y).distinct(), radius, x, y).select(F.col(x).alias("__x"), F.col(y).alias("__y")).distinct()
    return df.join(near, (F.col(x) == F.col("__x")) & (F.col(y) == F.col("__y")), "left_anti")


def asof(left: DataFrame, right: DataFrame, key: str, at: str, value: str, ranges: int = 64) -> DataFrame:
    """``left`` with right's latest ``value`` at or before its time.

    Both sides are cut into ranges of time, so that a key with any share of the rows spreads over tasks; the last value of
    each key and range, a row each, is carried into the key's later ranges.
    """
    when = lambda c: F.col(c).cast("timestamp").cast("double")
    marks = right.select(key, at, F.col(value).alias("__v"), F.lit(0).alias("__side"))
    rows = left.withColumn("__side", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    rows = rows.withColumn("__t", when(at) if "time" in str(left.schema[at].dataType).lower() or "date" in str(left.schema[at].dataType).lower() else F.col(at).cast("double"))
    rows = rows.withColumn("__range", bucket_of(rows, "__t", ranges))
    heads = rows.where("__side = 0").groupBy(F.col(key).alias("__k"), F.col("__range").alias("__b")).agg(F.max_by("__v", at).alias("__e"))
    spans = rows.select(F.col(key).alias("__k"), F.col("__range").alias("__b")).distinct().join(heads, ["__k", "__b"], "left")
    before = W.partitionBy("__k").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("__carried", F.last("__e", ignorenulls=True).over(before)).drop("__e")
    w = W.partitionBy(key, "__range").orderBy(at, "__side").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__own", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    rows = rows.join(spans, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__range") == F.col("__b")), "left")
    return rows.withColumn(value, F.coalesce("__own", "__carried")).drop("__v", "__side", "__t", "__range", "__k", "__b", "__own", "__carried")


def nearest_any(left: DataFrame, right: DataFrame, ident: str, k: int, x: str = "x", y: str = "y", least: int = 0, most: float | None = None) -> DataFrame:
    """Each left row's k nearest right rows at any distance (ties by id, never itself), ranked from 1; with ``most`` only
    those as near; left rows with fewer than ``least`` are absent.  ``ident`` is unique on either side.

    Rows of one place share their neighbours but for themselves, so places are searched for k + 1, and of right's rows at
    one place only the k + 1 of least id can be among them: copies of a place make no pairs.

    Rings: a place with k + 1 neighbours within a radius is done, as nothing beyond can be nearer; the others go on with
    twice the radius.  The first radius is one that holds few rows where they stand densest, so no dense place is paired whole.
    """
    tables = Tables(left.sparkSession, "nearest")
    real = lambda df: df.where(~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    few = real(right).where(F.col(ident).isNotNull()).withColumn("__k", F.row_number().over(W.partitionBy(x, y).orderBy(ident))).where(F.col("__k") <= k + 1).drop("__k")
    few, rest = tables.save(few), tables.save(real(left).select(F.col(x).alias("__x"), F.col(y).alias("__y")).distinct())
    box = few.agg(F.min(x), F.max(x), F.min(y), F.max(y), F.count(F.lit(1))).first()
    own = rest.agg(F.min("__x"), F.max("__x"), F.min("__y"), F.max("__y")).first()
    if not box[4] or own[0] is None:
        empty = within(left, right, 1.0, x, y).withColumn("rank", F.lit(1))
        return empty.limit(0)
    width, height = max(box[1], own[1]) - min(box[0], own[0]), max(box[3], own[3]) - min(box[2], own[2])
    reach = ((width * width + height * height) ** 0.5 or 1.0) * 1.001
    cell = reach / 1024
    crowded = few.groupBy(_cell(x, cell), _cell(y, cell)).count().agg(F.max("count")).first()[0]
    radius = min(reach, cell * max(1.0, (4.0 * (k + 1) / crowded) ** 0.5))
    if most is not None:
        reach, radius = min(reach, most), min(radius, most)
    w = W.partitionBy("__x", "__y").orderBy("distance", f"r_{ident}")
    other = few.withColumnsRenamed({x: "__x", y: "__y"})
    found = None
    while True:
        pairs = within(rest, other, radius, "__x", "__y").withColumnsRenamed({"r___x": f"r_{x}", "r___y": f"r_{y}"})
        ring = pairs.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k + 1)
        near = F.struct("__k", "distance", *[F.col(f"r_{c}") for c in right.columns])
        ring = ring.groupBy("__x", "__y").agg(F.array_sort(F.collect_list(near), lambda a, b: a["__k"] - b["__k"]).alias("__near"))
        last = radius >= reach
        ring = tables.save(ring if last else ring.where(F.size("__near") > k))
        found = ring if found is None else found.unionByName(ring)
        if last:
            break
        rest = tables.save(rest.join(ring, ["__x", "__y"], "left_anti"))
        if not rest.take(1):
            break
        radius = min(reach, radius * 2)
    rows = left.join(found, (F.col(x) == F.col("__x")) & (F.col(y) == F.col("__y")))
    rows = rows.withColumn("__near", F.slice(F.filter("__near", lambda c: c[f"r_{ident}"] != F.col(ident)), 1, k)).where(F.size("__near") >= least)
    rows = rows.select(*left.columns, F.posexplode("__near").alias("__at", "__c"))
    return rows.select(*left.columns, *[F.col("__c")[f"r_{c}"].alias(f"r_{c}") for c in right.columns], F.col("__c")["distance"].alias("distance"), (F.col("__at") + 1).alias("rank"))


def interpolate(x: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear through sorted points, flat beyond them."""
    out = F.lit(float(points[-1][1]))
    for (a, u), (b, v) in reversed(list(zip(points, points[1:], strict=False))):
        out = F.when(x <= b, u + (x - a) * ((v - u) / (b - a))).otherwise(out)
    return F.when(x <= points[0][0], float(points[0][1])).otherwise(out)


def with_last_known(left: DataFrame, known: DataFrame, history: DataFrame, keys: list[str], series: str, ts: str, columns: list[str]) -> DataFrame:
    """``left`` with known future covariates by key, else the series' last observed ones."""
    last = history.groupBy(series).agg(*[F.max_by(c, ts).alias(f"__{c}") for c in columns])
    out = left.join(known.select(*keys, *columns), keys, "left").join(last, series, "left")
    return out.withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def spatial_lag(edges: DataFrame, nodes: DataFrame, node: str, values: list[str]) -> DataFrame:
    """(node, lag of each value): sums of w * value over edges (src, dst, w); nodes without edges have 0."""
    ends = nodes.select(F.col(node).alias("dst"), *values)
    lags = edges.join(ends, "dst").groupBy(F.col("src").alias(node)).agg(*[F.sum(F.col("w") * F.col(v)).alias(f"lag_{v}") for v in values])
    return nodes.select(node).join(lags, node, "left").na.fill(0.0, [f"lag_{v}" for v in values])


def in_zones(points: DataFrame, zones: list[tuple[str, list[tuple[float, float]]]], x: str = "x", y: str = "y") -> Column:
    """The first zone whose ring holds the point, tested by bounding box first; null for none."""
    out = F.lit(None).cast("string")
    for name, ring in reversed(zones):
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        box = F.col(x).between(min(xs), max(xs)) & F.col(y).between(min(ys), max(ys))
        out = F.when(box & in_polygon(x, y, ring), name).otherwise(out)
    return out


def _in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a ring of (x, y) structs, by crossings; on a lower or left edge it does."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    edges = F.zip_with(F.slice(closed, F.lit(1), F.size(ring)), F.slice(closed, F.lit(2), F.size(ring)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    crosses = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])
    return F.size(F.filter(edges, crosses)) % 2 == 1


def zone_join(points: DataFrame, zones: DataFrame, ident: str, cell: float, strict: bool = False, x: str = "x", y: str = "y") -> DataFrame:
    """``points`` with the first zone (least ordinal) that holds them; ``zones`` is (zone, ordinal, ring array<struct<x, y>>).

    Zones are entered in every grid cell that their box touches, points in theirs, so a point meets only zones near it.
    Points outside of all zones have null, or with ``strict`` are an error.
    """
    corner = lambda f, c: F.floor(f(F.transform("ring", lambda p: p[c])) / cell).cast("long")
    spread = zones.select("zone", "ordinal", "ring", F.explode(F.sequence(corner(F.array_min, "x"), corner(F.array_max, "x"))).alias("__cx"), corner(F.array_min, "y").alias("__lo"), corner(F.array_max, "y").alias("__hi"))
    spread = spread.select("zone", "ordinal", "ring", "__cx", F.explode(F.sequence("__lo", "__hi")).alias("__cy"))
    placed = points.select(ident, F.col(x).alias("__x"), F.col(y).alias("__y"), _cell(x, cell).alias("__cx"), _cell(y, cell).alias("__cy"))
    hits = placed.join(spread, ["__cx", "__cy"]).where(_in_ring(F.col("ring"), F.col("__x"), F.col("__y")))
    out = points.join(hits.groupBy(ident).agg(F.min_by("zone", "ordinal").alias("zone")), ident, "left")
    if strict and (lost := out.where("zone IS NULL").take(1)):
        raise ValueError(f"a point is in no zone: {lost[0].asDict()}")
    return out


def touching(edges: DataFrame, treated: DataFrame) -> DataFrame:
    """Edges (src, dst, w) with exactly one treated end; ``treated`` has (node)."""
    s = treated.select(F.col("node").alias("src"), F.lit(True).alias("__s"))
    d = treated.select(F.col("node").alias("dst"), F.lit(True).alias("__d"))
    rows = edges.join(s, "src", "left").join(d, "dst", "left")
    return rows.where(F.col("__s").isNull() != F.col("__d").isNull()).drop("__s", "__d")


def closure(parents: DataFrame, node: str, parent: str, rounds: int = 64) -> DataFrame:
    """(node, leaf): every node's descendants without children, by as many joins as the tree is deep.

    A node that is its own ancestor is an error.
    """
    inner = parents.where(F.col(parent).isNotNull()).select(F.col(parent).alias("__p")).distinct()
    leaves = parents.join(inner, F.col(node) == F.col("__p"), "left_anti").select(F.col(node).alias("node"), F.col(node).alias("leaf"))
    up = parents.where(F.col(parent).isNotNull()).select(F.col(node).alias("__n"), F.col(parent).alias("__p"))
    out, front = leaves, leaves
    for _ in range(rounds):
        front = front.join(up, F.col("node") == F.col("__n")).select(F.col("__p").alias("node"), "leaf")
        if not front.take(1):
            return out
        out = out.unionByName(front)
    raise ValueError("the hierarchy has a cycle or is too deep")
