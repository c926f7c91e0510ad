"""Cell ids, postal codes and sparse id sets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col
from .hashing import stable_id

H3_LEVELS, S2_LEVELS = range(16), range(31)


def normalize_cell_id(x, bare_hex: bool) -> Column:
    """Text of a cell id as decimal digits: decimal, 0x hex and, where allowed, bare hex; otherwise null."""
    t = F.lower(F.trim(col(x)))
    out = F.when(t.rlike(r"^[0-9]{1,20}$"), F.regexp_replace(t, "^0+(?=[0-9])", "")).when(t.rlike("^0x[0-9a-f]{1,16}$"), F.conv(F.substring(t, 3, 16), 16, 10))
    return out.when(t.rlike("^[0-9a-f]{1,16}$"), F.conv(t, 16, 10)) if bare_hex else out


def normalize_h3(x) -> Column:
    return normalize_cell_id(x, bare_hex=True)


def normalize_s2(x) -> Column:
    return normalize_cell_id(x, bare_hex=False)


def check_levels(kind: str, level: int, parents: list[int]) -> None:
    """Levels of the kind, with strictly coarser parents."""
    allowed = {"h3": H3_LEVELS, "s2": S2_LEVELS}[kind]
    if level not in allowed or any(p not in allowed or p >= level for p in parents):
        raise ValueError(f"{kind} level {level} with parents {parents}")


def level_is_valid(kind, level) -> Column:
    """Whether a level is one of the kind's (h3 or s2)."""
    k, n = col(kind), col(level)
    return F.coalesce(((k == "h3") & n.between(H3_LEVELS[0], H3_LEVELS[-1])) | ((k == "s2") & n.between(S2_LEVELS[0], S2_LEVELS[-1])), F.lit(False))


def scaffold_parent(cell, level: int, parent: int) -> Column:
    """A synthetic parent id, not a real cell's: top bit, parent level at bit 56, and the cell shifted by 3 bits a level.

    As a signed 64-bit integer, the top bit makes it negative.
    """
    check_levels("h3", level, [parent])
    return F.shiftrightunsigned(col(cell).cast("long"), 3 * (level - parent)).bitwiseOR(F.lit(-(1 << 63) | parent << 56))


def sorted_set(x) -> Column:
    return F.array_sort(F.array_distinct(col(x)))


def _parent_of(level: int, parent: int):
    return lambda cell: scaffold_parent(cell, level, parent)


def with_parents(cells, level: int, parents: list[int]) -> Column:
    """A set of cells with the scaffold parents of each."""
    check_levels("h3", level, parents)
    up = [F.transform(col(cells), _parent_of(level, p)) for p in parents]
    return sorted_set(F.flatten(F.array(col(cells), *up)))


def set_contains(x, item: int) -> Column:
    return F.array_contains(col(x), F.lit(item).cast("long"))


def set_contains_any(x, items: list[int]) -> Column:
    return F.arrays_overlap(col(x), F.array(*[F.lit(i).cast("long") for i in items]))


def zip5(x) -> Column:
    """The first five digits of a postal code with at least five, otherwise null."""
    digits = F.regexp_replace(col(x), "[^0-9]", "")
    return F.when(F.length(digits) >= 5, F.substring(digits, 1, 5))


def zip_sets(origin, destination, prefixes: tuple[int, ...] = (3, 2)) -> dict[str, Column]:
    """Sets of a pair of postal codes: code and prefixes as numbers, and [1] where both are equal."""
    out = {}
    for side, x in (("origin", origin), ("destination", destination)):
        z = zip5(x)
        out[f"{side}_zip5"] = F.when(z.isNotNull(), F.array(z.cast("long"))).otherwise(F.array().cast("array<bigint>"))
        for p in prefixes:
            out[f"{side}_zip{p}"] = F.when(z.isNotNull(), F.array(F.substring(z, 1, p).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    out["zip_match"] = F.when(zip5(origin) == zip5(destination), F.array(F.lit(1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return out


def geo_id(x, namespace: str) -> Column:
    """Integers as they are; other text hashed with its namespace (60 bits)."""
    t = F.trim(col(x).cast("string"))
    return F.when(t.rlike("^[0-9]{1,18}$"), t.cast("long")).otherwise(stable_id(t, namespace))


def route_points(x) -> Column:
    """Points of a JSON route: [[lat, lng], ...], or objects with such pairs under ``coordinates`` in (lng, lat) order."""
    pairs = F.from_json(col(x), "array<array<double>>")
    mapped = F.transform(F.from_json(F.get_json_object(col(x), "$.coordinates"), "array<array<double>>"), lambda p: F.array(p[1], p[0]))
    return F.transform(F.coalesce(mapped, pairs), lambda p: F.struct(p[0].alias("lat"), p[1].alias("lng")))
