"""Near-duplicate components by MinHash with sequential Bayesian verification.

A document's set is that of its 5-word shingles (words lower-cased A-Z, split at ASCII white space; a shorter
text is one shingle; without words the set is empty and links with nothing).  Two documents are linked if the
Jaccard similarity of their sets is at least 0.75.  The result is the connected component of every document.

1. One pass makes each document's set fingerprint (128 bits), size and signature: 128 minimum values, 16 bits
   of each kept.  Documents of equal fingerprint form a class, which goes on as one node with its least id.
2. A signature has 32 bands of 4 values.  Of a pair at similarity 0.75 the chance to share no band is
   (1 - 0.75**4)**32 = 5e-6.  Within each band bucket every member is compared with the bucket's least node only:
   rows grow with the members, not their pairs.
3. Candidates are compared in batches of 16 values.  After each the pair is dropped if the posterior
   probability of a similarity of 0.75 or more (uniform prior, binomial likelihood) is below MISS.
4. Survivors are verified on their full sets, which are made again for the documents concerned only.
5. Connected components of the verified links.  A bucket whose members are all in one component is done.  The
   others are compared pair by pair inside the tasks, by step 3, in tiles of at most TILE members, a pair in the
   first band that it shares only, and only if its sizes allow the similarity.  A member is copied once for each
   TILE members of its bucket (7 times in a bucket of 100,000), so copies are few until a bucket without links has
   millions of members.  Members with a surviving partner leave the task, meet their full sets, and are verified
   in smaller tiles of CHUNK, from which only links that join components come out.  So every pair that shares a
   band is either known to be connected or has been compared.

Grouping pre-aggregates before each shuffle and hot keys meet only slim rows.

Edge cases: null texts count as empty; rows that repeat a doc_id with the same text are equal rows of the
result, with different texts they share the id's component, as links are between ids; a null doc_id has the null
component; very long texts are whole, and taken in slices of bounded rows and bytes; an empty table gives no rows;
extra columns, of any name, are ignored by the query and kept by the filter.  The filter ``keep_one`` goes by rows:
of texts that are linked the one with the least id stays (of several with that id the one with the least hash), of
equal rows one; a text that resembles no other stays, whatever its id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, claim, numbered_columns, slices, table, unused

WORDS = 5
NUM, DEN = 75, 100  # the similarity, as a fraction
BANDS, ROWS = 32, 4
VALUES = BANDS * ROWS
BATCH = 16
MISS = 1e-4
TILE, CHUNK = 16_384, 512
REMEMBERED = 100_000

# Independent odd multipliers and offsets of the permutations and of the words' places in a shingle.
_RNG = np.random.default_rng(20_240_229)
_MUL = (_RNG.integers(0, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1))[:, None]
_ADD = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint32)[:, None]
_PLACE = _RNG.integers(0, 1 << 64, WORDS, dtype=np.uint64) | np.uint64(1)


class _Words(dict):
    """Word hashes, of a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_WORDS = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    if len(w) < WORDS:  # its length sets it apart from longer texts' shingles
        return _mix((w * _PLACE[: len(w)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(w)))
    n = len(w) - WORDS + 1
    h = w[:n] * _PLACE[0]
    for k in range(1, WORDS):
        h += w[k : k + n] * _PLACE[k]
    return np.unique(_mix(h))


def signature(s: np.ndarray) -> np.ndarray:
    """The low 16 bits of VALUES minimum values of a set; bands are runs of ROWS values."""
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        least = np.minimum(least, (x[None, at : at + 2048] * _MUL + _ADD).min(1))
    least *= np.uint32(0x85EBCA6B)  # spreads what differs over the bits that are kept
    return (least >> np.uint32(16)).astype(np.uint16)


def _key(s: np.ndarray) -> bytes | None:
    """A set's fingerprint; None of the empty one."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("minhash", _WORDS.clear)
    for batch in slices(batches, "text"):
        n, keys, sigs = [], [], []
        for text in batch.column("text"):
            s = shingles(text.as_py())
            n.append(len(s))
            keys.append(_key(s))
            sigs.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "row", "n_shingles", "key", "sig"])


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_shingles, key, sig) from (doc_id, row, text)."""
    return docs.mapInArrow(_sign, "doc_id long, row long, n_shingles long, key binary, sig binary")


def _least_matches() -> list[int]:
    """For each number of batches, the least matches at which a pair isn't dropped: P(s >= 0.75 | m of n) >= MISS."""
    grid = np.linspace(0.0005, 0.9995, 1000)
    out = []
    for n in range(BATCH, VALUES + 1, BATCH):
        for m in range(n + 1):
            like = comb(n, m) * grid**m * (1 - grid) ** (n - m)
            if like[grid >= NUM / DEN].sum() / like.sum() >= MISS:
                break
        out.append(m)
    return out


_LEAST = _least_matches()


def survives(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of the signature matrices a and b are not dropped by any batch."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    for k, least in enumerate(_LEAST):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (a[alive, part] == b[alive, part]).sum(1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
    return alive


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, VALUES)


def _prune(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            part = batch.slice(at, 8192)
            kept = survives(_matrix(part.column("sig_a")), _matrix(part.column("sig_b")))
            yield part.select(["a", "b"]).take(pa.array(kept))


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """((band, value, lo, hi), rows of node, comp, own, size, sig and, if there, set) of rows sorted by the former."""
    held: list[tuple] = []
    at = None
    for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
        names = [c for c in ("node", "comp", "own", "size", "sig", "items") if c in batch.schema.names]
        keys = zip(*[batch.column(k).to_pylist() for k in ("band", "value", "lo", "hi")], strict=True)
        for key, row in zip(keys, zip(*[batch.column(k).to_pylist() for k in names], strict=True), strict=True):
            if key != at:
                if len(held) > 1:
                    yield at, held
                held, at = [], key
            held.append(row)
    if len(held) > 1:
        yield at, held


def _tile_pairs(at: tuple, held: list[tuple]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, others): rows of a tile pair, of different components and like sizes, that survive, and share no earlier band."""
    comps, size = np.array([x[1] for x in held], np.int64), np.array([x[3] for x in held], np.int64)
    own = np.array([x[2] for x in held])
    sigs = np.frombuffer(b"".join(x[4] for x in held), np.uint16).reshape(-1, VALUES)
    bands = sigs.view(np.int64)[:, : at[0]]
    left, right = np.flatnonzero(own == at[2]), np.flatnonzero(own == at[3])
    right = right[np.argsort(size[right], kind="stable")]
    for i in left:
        # |x & y| <= min(|x|, |y|) and |x | y| >= max, so only sizes within the similarity can link.
        lo, hi = np.searchsorted(size[right], (-(-NUM * size[i] // DEN), size[i] * DEN // NUM + 1))
        other = right[lo:hi]
        if at[2] == at[3]:
            other = other[other > i]
        other = other[comps[other] != comps[i]]
        if len(other):
            other = other[survives(np.broadcast_to(sigs[i], (len(other), VALUES)), sigs[other])]
        if len(other) and at[0]:
            other = other[~(bands[other] == bands[i]).any(1)]
        if len(other):
            yield int(i), np.sort(other)


_HOPEFUL = "band int, value long, lo long, hi long, node long, comp long, own long, size long, sig binary"
_HOPEFUL_NAMES = [x.split()[0] for x in _HOPEFUL.split(", ")]
_HOPEFUL_KINDS = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in _HOPEFUL.split(", ")]


def _hopeful(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each tile pair that have a surviving partner in it, in pairs of tiles of CHUNK rows."""
    for at, held in _groups(batches):
        chunk = [(x[2] << 32) + k // CHUNK for k, x in enumerate(held)]
        found: dict[tuple[int, int], set[int]] = {}
        for i, others in _tile_pairs(at, held):
            for j in others.tolist():
                found.setdefault((chunk[i], chunk[j]), set()).update((i, j))
        for (lo, hi), members in found.items():
            rows = [(at[0], at[1], lo, hi, *held[i][:2], chunk[i], *held[i][3:5]) for i in sorted(members)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _HOPEFUL_KINDS, strict=True)], _HOPEFUL_NAMES)


def _settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components, verified on the full sets; in a tile pair fewer than its components."""
    for at, held in _groups(batches):
        up: dict[int, int] = {}

        def root(c: int, up=up) -> int:
            while (d := up.get(c, c)) != c:
                c = d
            return c

        sets = [np.frombuffer(x[5], np.uint64) for x in held]
        out = []
        for i, others in _tile_pairs(at, held):
            for j in others.tolist():
                x, y = root(held[i][1]), root(held[j][1])
                if x != y and linked(sets[i], sets[j]):
                    up[max(x, y)] = min(x, y)
                    out.append(sorted((held[i][0], held[j][0])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("minhash", _WORDS.clear)
    for batch in slices(batches, "text"):
        made = [shingles(x.as_py()) for x in batch.column("text")]
        right = pa.array([_key(s) == k for s, k in zip(made, batch.column("key").to_pylist(), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in made], pa.binary())], ["node", "items"]).filter(right)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets' similarity is at least NUM / DEN."""
    if DEN * min(len(x), len(y)) < NUM * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return DEN * common >= NUM * (len(x) + len(y) - common)


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = zip(batch.column("set_a"), batch.column("set_b"), strict=True)
        keep = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in sets]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp): each linked node's least reachable node, by alternating large-star and small-star rounds."""
    tally = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = scratch.save(links.select(F.col("b").alias("u"), F.col("a").alias("v")).where("u <> v").distinct())  # u > v
    before = tally(edges)
    while True:
        # Large star: every neighbour above a node moves to the node's least neighbour (itself included).
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        # Small star: a node and its lesser neighbours move to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = large.join(least.where("n > 1"), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        fresh = scratch.save(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = tally(fresh)
        scratch.drop(edges)
        edges, done, before = fresh, now == before, now
        if done:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def _bands(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            values = _matrix(part.column("sig")).view(np.int64)
            nodes = np.repeat(part.column("node").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(values))), pa.array(values.reshape(-1))], ["node", "band", "value"])


def _classes(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The rows' ids, row hashes and fingerprints; classes (key, doc_id, row, node); the components (node, comp) that the
    hubs' links make; and the links (a, b) that join further ones."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    signed = scratch.save(sign(rows))
    # One row a class: its least id, and of that one's rows the least hash.  Numbered as written, once.
    named = signed.where("key IS NOT NULL AND doc_id IS NOT NULL")
    classes = named.groupBy("key").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    classes = scratch.save(classes.select("key", "first.doc_id", "first.row", F.monotonically_increasing_id().alias("node")))
    reps = classes.select("node", "key", "doc_id", "row").join(named, ["key", "doc_id", "row"]).select("node", F.col("n_shingles").alias("size"), "sig")
    reps = scratch.save(reps.dropDuplicates(["node"]))
    bands = reps.select("node", "sig").mapInArrow(_bands, "node long, band int, value long")
    hubs = bands.groupBy("band", "value").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = scratch.save(bands.join(hubs, ["band", "value"]))
    stars = members.where("node > hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    left, right = reps.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), reps.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    pairs = scratch.save(stars.join(right, "b").join(left, "a").mapInArrow(_prune, "a long, b long"))
    links = scratch.save(_verified(pairs, classes, rows, scratch))
    comps = components(links, scratch)
    # Buckets with members of several components, compared in tiles.
    named = scratch.save(members.join(comps, "node", "left").select("node", "band", "value", "n", F.coalesce("comp", "node").alias("comp")))
    mixed = named.groupBy("band", "value").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("band", "value")
    rest = named.join(mixed, ["band", "value"])
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    rest = rest.withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("tiles") - 1).cast("long"))))
    rest = rest.select("node", "band", "value", "comp", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    tile = ["band", "value", "lo", "hi"]
    together = lambda df: df.repartition(*tile).sortWithinPartitions(*tile, "node")
    hopeful = scratch.save(together(rest.join(reps, "node")).mapInArrow(_hopeful, _HOPEFUL))
    sets = _sets_of(hopeful.select("node"), classes, rows, scratch)
    more = scratch.save(together(hopeful.join(sets, "node")).mapInArrow(_settle, "a long, b long").distinct())
    return signed, classes, comps, more


def _joined(comps: DataFrame, more: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp, key, doc_id, row) of every class with a link, its component's least node among them."""
    if more.take(1):
        known = comps.select(F.col("comp").alias("a"), F.col("node").alias("b"))
        comps = components(known.unionByName(more), scratch)
    whole = comps.unionByName(comps.select(F.col("comp").alias("node"), "comp").distinct())
    return scratch.save(whole.join(classes, "node"))


def near_components(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    signed, classes, comps, more = _classes(docs, scratch, id_col, text_col)
    # An id with several texts links their classes, and its rows without words take its component.
    ids = signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("key").alias("x"), F.max("key").alias("y"), (F.count(F.lit(1)) > F.count("key")).alias("bare"))
    ids = scratch.save(ids.where("x <> y OR bare AND x IS NOT NULL").select("doc_id", "bare"))
    several = scratch.save(signed.join(ids, "doc_id").join(classes.select("key", "node"), "key").select("doc_id", "node", "key", "bare").distinct())
    same = several.join(several.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("a < node").select("a", F.col("node").alias("b"))
    heads = _joined(comps, more.unionByName(same), classes, scratch)
    least = heads.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    heads = heads.select("key", "comp").join(least, "comp").select("key", "component_id")
    found = scratch.save(classes.select("key", "doc_id").join(heads, "key", "left").select("key", F.coalesce("component_id", "doc_id").alias("component_id")))
    bare = scratch.save(several.where("bare").join(found, "key").groupBy("doc_id").agg(F.min("component_id").alias("other")))
    scratch.keep(signed, found, bare)
    out = signed.select("doc_id", "n_shingles", "key").join(found, "key", "left")
    if bare.take(1):
        out = out.join(bare, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "other"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.select("*", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def _sets_of(nodes: DataFrame, classes: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, items): the full sets of some classes, made again from the texts of their least ids.

    The ids are broadcast where they are counted to be few.
    """
    wanted = scratch.save(classes.join(nodes.distinct(), "node", "left_semi"))
    few = wanted.count() <= 500_000
    return scratch.save(rows.join(F.broadcast(wanted) if few else wanted, ["doc_id", "row"]).select("node", "key", "text").mapInArrow(_sets, "node long, items binary").dropDuplicates(["node"]))


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs that are linked, by the full sets of the documents in them."""
    sets = _sets_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), classes, rows, scratch)
    met = pairs.join(sets.select(F.col("node").alias("b"), F.col("items").alias("set_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("items").alias("set_a")), "a")
    return met.mapInArrow(_verify, "a long, b long")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), Scratch(spark, "minhash"))


def keep_one(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of linked texts, that of its least id; rows without an id stay."""
    docs, names, (id_col, text_col) = numbered_columns(docs, id_col, text_col)
    signed, classes, comps, more = _classes(docs, scratch, id_col, text_col)
    heads = _joined(comps, more, classes, scratch)
    first = heads.groupBy("comp").agg(F.min(F.struct("doc_id", "row", "node")).alias("first"))
    losers = heads.join(first, "comp").where("node <> first.node").select("node", F.lit(True).alias("lost"))
    # All rows of a class that lost go, and of others those beside the class's first.
    judged = classes.join(losers, "node", "left").select("key", F.col("doc_id").alias("d"), F.col("row").alias("r"), "lost")
    gone = signed.where("doc_id IS NOT NULL").select("doc_id", "row", "key").join(judged, "key").where("lost OR doc_id <> d OR row <> r")
    i, h = unused(docs, "id", "hash")
    gone = scratch.save(gone.select(F.col("doc_id").alias(i), F.col("row").alias(h)).distinct())
    again = scratch.save(signed.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(i), F.col("row").alias(h)).count().where("count > 1").select(i, h))
    scratch.keep(gone, again)
    few = lambda df: F.broadcast(df) if df.count() <= 500_000 else df
    own = (F.col(id_col).cast("long") == F.col(i)) & (F.xxhash64(text_col) == F.col(h))
    kept = docs.join(few(gone), own, "left_anti")
    if not again.take(1):
        return kept.toDF(*names)
    once = kept.join(few(again), own, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(few(again), own, "left_anti").unionByName(once).toDF(*names)
