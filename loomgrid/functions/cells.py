"""S2 cell ids of points: the sphere on six faces of a cube, each numbered along a Hilbert curve.

A point's face and coordinates on it are columns of arithmetic; the curve is gone through bit by bit over whole Arrow
batches.  Ids are 64 bits, so as signed numbers those of the last three faces are negative.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col

MAX_LEVEL = 30
#: Fixed values of the curve: a quadrant's (i, j) at each place along it, by orientation, and how a place turns the next.
PLACE_TO_IJ = [[0, 1, 3, 2], [0, 2, 3, 1], [3, 2, 0, 1], [3, 1, 0, 2]]
PLACE_TURNS = [1, 0, 0, 3]


def leaf_ids(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    """The cells of level 30 that hold the points (degrees), as unsigned numbers."""
    phi, theta = np.radians(np.asarray(lat, float)), np.radians(np.asarray(lng, float))
    xyz = np.stack([np.cos(theta) * np.cos(phi), np.sin(theta) * np.cos(phi), np.sin(phi)])
    axis = np.abs(xyz).argmax(0)
    at = np.take_along_axis(xyz, axis[None], 0)[0]
    face = axis + 3 * (at < 0)
    x, y, z = xyz
    # On each face the coordinates turn so that the curve goes on from face to face.
    u = np.choose(face, [y / np.where(x == 0, 1, x), -x / np.where(y == 0, 1, y), -x / np.where(z == 0, 1, z), z / np.where(x == 0, 1, x), z / np.where(y == 0, 1, y), -y / np.where(z == 0, 1, z)])
    v = np.choose(face, [z / np.where(x == 0, 1, x), z / np.where(y == 0, 1, y), -y / np.where(z == 0, 1, z), y / np.where(x == 0, 1, x), -x / np.where(y == 0, 1, y), -x / np.where(z == 0, 1, z)])
    even = lambda w: np.where(w >= 0, 0.5 * np.sqrt(1 + 3 * np.abs(w)), 1 - 0.5 * np.sqrt(1 + 3 * np.abs(w)))
    grid = lambda w: np.clip(np.floor(even(w) * (1 << MAX_LEVEL)), 0, (1 << MAX_LEVEL) - 1).astype(np.int64)
    i, j = grid(u), grid(v)
    place_of = np.argsort(np.array(PLACE_TO_IJ), axis=1)
    turn, way = np.array(PLACE_TURNS), face & 1
    out = face.astype(np.uint64)
    for k in range(MAX_LEVEL - 1, -1, -1):
        place = place_of[way, 2 * (i >> k & 1) + (j >> k & 1)]
        out = out << np.uint64(2) | place.astype(np.uint64)
        way = way ^ turn[place]
    return out << np.uint64(1) | np.uint64(1)


def parents(ids: np.ndarray, level: int) -> np.ndarray:
    """The cells of a level that hold the cells."""
    low = np.uint64(1 << 2 * (MAX_LEVEL - level))
    return ids & ~(low - np.uint64(1)) & ~low | low


def s2_cell(lat, lng, level: int) -> Column:
    """The id of the cell of a level that holds a point; null where a coordinate is missing or out of range."""
    if not 0 <= level <= MAX_LEVEL:
        raise ValueError(f"s2 level {level}")

    @F.pandas_udf("long")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        ok = a.between(-90, 90) & b.between(-180, 180)
        ids = parents(leaf_ids(a.where(ok, 0).to_numpy(), b.where(ok, 0).to_numpy()), level).astype(np.int64)
        return pd.Series(ids).where(ok.to_numpy(), None).astype("Int64")

    return run(col(lat).cast("double"), col(lng).cast("double"))


def s2_parent(cell, level: int) -> Column:
    """The id of the level's cell that holds a cell, by its bits alone."""
    low = 1 << 2 * (MAX_LEVEL - level)
    return col(cell).cast("long").bitwiseAND(F.lit(-low)).bitwiseAND(F.bitwise_not(F.lit(low))).bitwiseOR(F.lit(low))
