"""Searches on the sphere: cones, cross-matches of two tables, tiles of even size.

Positions are three columns of any direction vector. A row whose position is null, not finite or zero is nowhere: it is found by no search and
matches nothing.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import sphere
from tessera.functions.layout import Partition, overlapping

#: Rows of one cell that meet in one task when tables are matched.
CELL = 20_000


def keyed(df: DataFrame, at: Sequence[str], key: str = sphere.KEY, order: int = sphere.DEEPEST) -> DataFrame:
    """df with the pixel of each position; null where there is none."""
    return df.withColumn(key, sphere.pixel(at, order))


def _angle(a: Sequence[Column], b: Sequence[Column]) -> Column:
    chord = F.sqrt(functools.reduce(Column.__add__, [(x - y) * (x - y) for x, y in zip(a, b, strict=True)]))
    return 2 * F.asin(F.least(F.lit(1.0), chord / 2))


def within(ranges: Sequence[tuple[int, int]], key: Column) -> Column:
    """Whether a key is in one of the ranges, as comparisons that files and row groups are pruned by."""
    return functools.reduce(Column.__or__, [key.between(a, b) for a, b in ranges], F.lit(False))


def cone_search(df: DataFrame, middle: Sequence[float], radius: float, at: Sequence[str], key: str | None = sphere.KEY, out: str = "separation") -> DataFrame:
    """Rows of df within the radius (radians, its edge included) of a direction, with the angle to it.

    key: a column that holds the position's pixel of order 29. Ranges of it are compared before any angle is worked out, so a
    parquet scan leaves out row groups by its statistics; None compares angles only.
    """
    middle = sphere.unit(middle)
    near = df if key is None else df.filter(within(sphere.cone(middle, radius), F.col(key)))
    unit = [f"_{out}_u{i}" for i in range(3)]
    angle = _angle(map(F.col, unit), [F.lit(float(c)) for c in middle])
    return sphere.with_unit(near, at, unit).withColumn(out, angle).drop(*unit).filter(F.col(out) <= radius)


def search_catalog(catalog, middle: Sequence[float], radius: float, at: Sequence[str], columns: Sequence[str] | None = None, key: str = sphere.KEY, out: str = "separation") -> DataFrame:
    """cone_search() of a catalog: of its partitions only those that meet the cone are opened, of these only row groups that do.

    key is the catalog's column of pixels of order 29, `columns` what is returned besides the angle.
    """
    chosen = overlapping(catalog.partitions, sphere.cone(middle, radius))
    read = None if columns is None else list(dict.fromkeys([*columns, *at, key]))
    found = cone_search(catalog.read(chosen, read), middle, radius, at, key, out)
    return found if columns is None else found.select(*columns, out)


def cell_order(radius: float) -> int:
    """The deepest order whose pixels reach no less than the radius, so that a cone meets a few of them."""
    return max((k for k in range(sphere.DEEPEST + 1) if sphere.reach(k) >= radius), default=0)


def cross_match(left: DataFrame, right: DataFrame, radius: float, at: Sequence[str], by: tuple[str, str], nearest: int | None = None, cell: int = CELL) -> DataFrame:
    """(left, right, separation[, rank]): structs of the rows of both sides that are within the radius (radians) of each other.

    by: columns that name the rows of the left and of the right; with `nearest`, only so many of the right for each left
    name are kept, by angle, ties by the right's name, rank from 1. Rows on both sides may repeat; each pair of rows counts.

    A row of the right stands in its own pixel only, one of the left in all that its cone meets: every pair meets once, with
    no comparison of all rows. Pixels of over `cell` rows of the right are cut by hash into parts, to each of which the left rows go, so a crowded
    place is spread over tasks.
    """
    order = cell_order(radius)

    def cells(x: pa.Array, y: pa.Array, z: pa.Array) -> pa.Array:
        v = np.stack([c.to_numpy(zero_copy_only=False) for c in (x, y, z)], axis=1)
        rows, met = sphere.covers(v, radius, order)
        ends = np.bincount(rows, minlength=len(v)).cumsum()
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(met[np.argsort(rows, kind="stable")]))

    cover = F.arrow_udf(cells, T.ArrayType(T.LongType()))
    p, q = ([f"_{c}{i}" for i in range(3)] for c in "pq")
    a = sphere.with_unit(left.select(F.struct("*").alias("left"), *[F.col(f"`{c}`").alias(f"_{k}") for k, c in zip("xyz", at, strict=True)]), ["_x", "_y", "_z"], p).filter("_p0 is not null")
    b = sphere.with_unit(right.select(F.struct("*").alias("right"), *[F.col(f"`{c}`").alias(f"_{k}") for k, c in zip("xyz", at, strict=True)]), ["_x", "_y", "_z"], q).filter("_q0 is not null")
    a, b = a.drop("_x", "_y", "_z"), b.withColumn("_cell", sphere.pixel(q, order)).drop("_x", "_y", "_z")
    crowded = b.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > cell).select("_cell", F.ceil(F.col("_n") / cell).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    b = b.join(crowded, "_cell", "left").withColumn("_part", F.pmod(F.xxhash64(f"right.{by[1]}", "_q0", "_q1"), parts).cast("int")).drop("_parts")
    a = a.withColumn("_cell", F.explode(cover(*p))).join(crowded, "_cell", "left")
    a = a.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    angle = _angle(map(F.col, p), map(F.col, q))
    found = a.join(b, ["_cell", "_part"]).withColumn("separation", angle).filter(F.col("separation") <= radius).select("left", "right", "separation")
    if nearest is None:
        return found
    rank = F.row_number().over(Window.partitionBy(f"left.{by[0]}").orderBy("separation", f"right.{by[1]}"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= nearest)


def density(df: DataFrame, order: int, key: str = sphere.KEY) -> DataFrame:
    """(pixel, rows): the sky map of df, pixels of the order that have rows."""
    return df.groupBy(sphere.parent(F.col(key), order).alias("pixel")).agg(F.count(F.lit(1)).alias("rows"))


def tiles(counts: DataFrame, order: int, most: int) -> DataFrame:
    """(order, pixel, rows): the largest pixels of at most `most` rows each that hold all of counts (pixel of the order, rows).

    A pixel with more is split into its four, down to the order of counts, whose pixels are tiles however many rows they have. Counts
    are added up from order to order, so each step has a quarter of the rows of the one before at best.
    """
    levels = {order: counts.select("pixel", "rows")}
    for k in range(order - 1, -1, -1):
        levels[k] = levels[k + 1].groupBy(F.shiftright("pixel", 2).alias("pixel")).agg(F.sum("rows").alias("rows"))
    found = []
    for k, level in levels.items():
        one = level if k == order else level.filter(F.col("rows") <= most)
        if k:  # it stands only where the pixel around it has too many
            full = levels[k - 1].filter(F.col("rows") > most).select(F.col("pixel").alias("_up"))
            one = one.join(full, F.shiftright("pixel", 2) == F.col("_up"), "left_semi")
        found.append(one.select(F.lit(k).alias("order"), "pixel", "rows"))
    return functools.reduce(DataFrame.unionByName, found)


def tile_of(key: Column, found: Sequence[Partition]) -> tuple[Column, Column]:
    """(order, pixel) of the tile that a key is in; null where there is none. `found` is a catalog's index, a row for each file."""
    order = sorted(found, key=lambda p: p.pixel << 2 * (sphere.DEEPEST - p.order))
    depth, pixel = (np.array([p[i] for p in order], np.int64) for i in (0, 1))
    firsts = pixel << 2 * (sphere.DEEPEST - depth)

    def look(key: pa.Array) -> pa.Array:
        known = np.asarray(key.is_valid())
        keys = np.where(known, np.nan_to_num(key.to_numpy(zero_copy_only=False)), -1).astype(np.int64) if key.null_count else key.to_numpy()
        i = np.maximum(np.searchsorted(firsts, keys, "right") - 1, 0)
        inside = known & (keys >> 2 * (sphere.DEEPEST - depth[i]) == pixel[i])
        return pa.StructArray.from_arrays([pa.array(depth[i], pa.int32(), mask=~inside), pa.array(pixel[i], mask=~inside)], names=["order", "pixel"])

    tile = F.arrow_udf(look, T.StructType([T.StructField("order", T.IntegerType()), T.StructField("pixel", T.LongType())]))(key)
    return tile.getField("order"), tile.getField("pixel")
