"""Stable hashes and seeded draws, the same on every platform: as plain functions for the driver, and as columns."""

from __future__ import annotations

from math import cos, log, pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col

MASK = (1 << 64) - 1


def fnv1a(data: bytes, salt: int = 0) -> int:
    """64-bit FNV-1a, the salt put into the offset."""
    h = 0xCBF29CE484222325 ^ salt
    for b in data:
        h = (h ^ b) * 0x100000001B3 & MASK
    return h


def stable_hex(data: bytes, salts: tuple[int, ...] = (0, 1, 2, 3)) -> str:
    """A 256-bit digest in hex from four salted 64-bit hashes."""
    return "".join(f"{fnv1a(data, s):016x}" for s in salts)


def splitmix64(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def uniform(x: int) -> float:
    """A number strictly between 0 and 1 from 53 of the hash's bits."""
    return ((splitmix64(x) >> 11) + 0.5) / float(1 << 53)


def normal(seed: int, step: int, sample: int) -> float:
    """A seeded draw of the standard normal, by Box and Muller."""
    key = splitmix64(seed) ^ splitmix64((step << 32) ^ sample)
    return sqrt(-2 * log(uniform(key))) * cos(2 * pi * uniform(key ^ 0xA5A5A5A5A5A5A5A5))


def stable_id(x, namespace: str) -> Column:
    """A non-negative 60-bit number from a text and its namespace."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(namespace + ":"), col(x).cast("string"))), 1, 15), 16, 10).cast("long")
