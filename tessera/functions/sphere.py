"""Places on the sphere: equal-area pixels in nested order, of numbers in arrays and of columns, and what a cone covers.

The sphere has 12 base pixels, each split into four at every order; a pixel's number at an order is its number at the next one
without the last two bits. So a pixel of order k is a range of keys of order 29, and near places mostly have near keys. The projection
is the public one of equal-area, iso-latitude pixels (Gorski et al. 2005): an equatorial belt up to |z| = 2/3 and two caps.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.layout import DEEPEST

#: The usual column of keys of the deepest order.
KEY = "_healpix_29"
#: Fixed values of the projection: row and place of the lowest corner of each base pixel.
ROWS = (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4)
PLACES = (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7)
#: Steps that part a number's bits by zeros: shift, mask.
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread(v: np.ndarray) -> np.ndarray:
    for shift, mask in _SPREAD:
        v = (v | v << shift) & mask
    return v


def _gather(v: np.ndarray) -> np.ndarray:
    """Every other bit, the inverse of _spread."""
    masks = [m for _, m in _SPREAD][::-1] + [0x00000000FFFFFFFF]
    v = v & masks[0]
    for shift, mask in zip((1, 2, 4, 8, 16), masks[1:], strict=True):
        v = (v | v >> shift) & mask
    return v


def with_unit(df: DataFrame, at: Sequence[str], names: Sequence[str]) -> DataFrame:
    """df with the position of any length in columns `at` as a unit vector; null where a coordinate is null or not finite, or all are zero.

    What is used more than once is a column of its own for a while.
    """
    tops = [f"_{n}" for n in names]
    x = [F.col(f"`{c}`").cast("double") for c in at]
    # Scaled by the largest coordinate first, so that no square is out of range.
    top = F.greatest(*map(F.abs, x))
    fine = x[0].isNotNull() & x[1].isNotNull() & x[2].isNotNull() & (top > 0) & (top < float("inf"))
    df = df.withColumn(tops[0], F.when(fine, top)).withColumns({n: c / F.col(tops[0]) for n, c in zip(names, x, strict=True)})
    a, b, c = map(F.col, names)
    return df.withColumn(tops[1], F.sqrt(a * a + b * b + c * c)).withColumns({n: F.col(n) / F.col(tops[1]) for n in names}).drop(*tops[:2])


def pixel(at: Sequence[str], order: int = DEEPEST) -> Column:
    """Pixel of a position of any length in columns `at`; null where a coordinate is null or not finite, or all are zero.

    Over Arrow batches: in column functions the steps would be written out many times over as soon as a filter on the
    pixel is moved below them (planning took minutes), and numpy does a batch in one go.
    """

    def found(x: pa.Array, y: pa.Array, z: pa.Array) -> pa.Array:
        v = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (x, y, z)], axis=1)
        top = np.abs(v).max(axis=1)
        fine = np.isfinite(top) & (top > 0)
        u = v[fine] / top[fine, None]
        out = np.zeros(len(v), np.int64)
        out[fine] = pixels(u / np.sqrt((u * u).sum(axis=1))[:, None], order)
        return pa.array(out, mask=~fine)

    return F.arrow_udf(found, T.LongType())(*[F.col(f"`{c}`").cast("double") for c in at])


def bounds(pixel: Column, order: int, of: int = DEEPEST) -> tuple[Column, Column]:
    """First and last pixel of a deeper order that are in a pixel."""
    shift = 2 * (of - order)
    return F.shiftleft(pixel, shift), F.shiftleft(pixel + 1, shift) - 1


def parent(key: Column, order: int, of: int = DEEPEST) -> Column:
    """Pixel of the order that a pixel of a deeper one is in."""
    return F.shiftright(key, 2 * (of - order))


def pixels(v: np.ndarray, order: int = DEEPEST) -> np.ndarray:
    """Pixels of unit vectors."""
    n, low = 1 << order, (1 << order) - 1
    x, y, z = v.T
    za, turn = np.abs(z), np.arctan2(y, x) / (math.pi / 2)
    turn = np.where(turn < 0, turn + 4, turn)
    turn[turn >= 4] = 0
    jp, jm = (np.floor(n * (turn + 0.5) + s * z * 0.75 * n).astype(np.int64) for s in (-1, 1))
    p, m = jp >> order, jm >> order
    face = np.where(p == m, p | 4, np.where(p < m, p, m + 8))
    ix, iy = jm & low, low - (jp & low)
    quarter = np.minimum(np.floor(turn).astype(np.int64), 3)
    far = n * np.sqrt(3 * (x * x + y * y) / (1 + za))
    jp, jm = (np.minimum(np.floor(c * far).astype(np.int64), low) for c in (turn - quarter, 1 - (turn - quarter)))
    cap, north = za > 2 / 3, z >= 0
    face = np.where(cap, np.where(north, quarter, quarter + 8), face)
    ix, iy = np.where(cap, np.where(north, low - jm, jp), ix), np.where(cap, np.where(north, low - jp, jm), iy)
    return face << 2 * order | _spread(ix) | _spread(iy) << 1


def centres(pixel: np.ndarray, order: int) -> np.ndarray:
    """Unit vectors of the pixels' middles."""
    n = 1 << order
    pixel = np.asarray(pixel, np.int64)
    face, inside = pixel >> 2 * order, pixel & (n * n - 1)
    ix, iy = _gather(inside), _gather(inside >> 1)
    row = (np.array(ROWS)[face] << order) - ix - iy - 1
    near = np.minimum(np.minimum(row, 4 * n - row), n)
    z = np.where(near < n, 1 - near * (near / (3.0 * n * n)), (2 * n - row) * (2 / (3.0 * n)))
    z = np.where(row > 3 * n, -z, z)
    # Near a pole 1 - z^2 is worked out from the row, not from z.
    flat = np.where(near < n, np.sqrt(near * near / (3.0 * n * n) * (2 - near * near / (3.0 * n * n))), np.sqrt(np.maximum(1 - z * z, 0)))
    place = np.array(PLACES)[face] * near + ix - iy
    phi = math.pi / 4 * np.where(place < 0, place + 8 * near, place) / near
    return np.stack([flat * np.cos(phi), flat * np.sin(phi), z], axis=1)


def reach(order: int) -> float:
    """No place of a pixel of the order is farther from its middle, in radians."""
    n = 1 << order
    # The pixels that reach farthest touch |z| = 2/3: from there to the middle of their upper edge's row.
    side, z = math.pi / (4 * n), 1 - (1 - 1 / n) ** 2 / 3
    a = (math.sqrt(5) / 3 * math.cos(side), math.sqrt(5) / 3 * math.sin(side), 2 / 3)
    b = (math.sqrt(max(0.0, 1 - z * z)), 0.0, z)
    return 2 * math.asin(min(1.0, math.dist(a, b) / 2)) * (1 + 1e-9)


def unit(v: Sequence[float]) -> np.ndarray:
    v = np.asarray(v, float)
    if v.shape != (3,) or not np.isfinite(v).all() or not v.any():
        raise ValueError(f"{v} is no direction of three finite coordinates")
    v = v / np.abs(v).max()
    return v / np.linalg.norm(v)


def apart(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Angles between unit vectors, good at any size."""
    return 2 * np.arcsin(np.minimum(1, np.linalg.norm(v - w, axis=-1) / 2))


def cone(middle: Sequence[float], radius: float, order: int | None = None) -> list[tuple[int, int]]:
    """Ranges of keys (first, last) that hold every place within the radius (radians) of a direction, in order, apart from each other.

    Pixels that are inside are taken whole; those on the edge are split down to the order (by default to an eighth of the
    radius), so the ranges are somewhat more than the cone and never less.
    """
    middle = unit(middle)
    if not radius >= 0:
        raise ValueError(f"a radius of {radius}")
    if order is None:
        order = next((k for k in range(DEEPEST) if reach(k) <= max(radius, 1e-9) / 8), DEEPEST)
    edge, found = np.arange(12), []
    for k in range(order + 1):
        far = apart(centres(edge, k), middle)
        met = far <= radius + reach(k) + 1e-12
        inside = far + reach(k) <= radius
        whole = edge[inside] if k < order else edge[met]
        shift = 2 * (DEEPEST - k)
        found += [(int(p) << shift, (int(p) + 1 << shift) - 1) for p in whole]
        edge = (edge[met & ~inside][:, None] * 4 + np.arange(4)).ravel()
    out: list[list[int]] = []
    for low, high in sorted(found):
        if out and out[-1][1] + 1 >= low:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def covers(v: np.ndarray, radius: float, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, pixel): the pixels of the order that may be within the radius of each unit vector; none that is is left out."""
    row, pixel = np.repeat(np.arange(len(v)), 12), np.tile(np.arange(12), len(v))
    for k in range(order + 1):
        if k:
            row, pixel = np.repeat(row, 4), (pixel[:, None] * 4 + np.arange(4)).ravel()
        met = apart(centres(pixel, k), v[row]) <= radius + reach(k) + 1e-12
        row, pixel = row[met], pixel[met]
    return row, pixel
