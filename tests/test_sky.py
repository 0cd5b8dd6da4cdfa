"""Pixels, cones, cross-matches and tiles against plain geometry."""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import sphere
from tessera.functions.layout import Partition, overlapping
from tessera.operators import sky
from tessera.plans import tiling
from tessera.sources import datasource
from tessera.sources.catalog import open_catalog

AT = ["x", "y", "z"]
#: Poles, corners of base pixels, the edge of the caps, and what is nowhere.
PLACES = [(1, 0, 0), (0, 1, 0), (-1, 0, 0), (0, -1, 0), (0, 0, 1), (0, 0, -5), (1, 1, 0), (1, 0, 2 / math.sqrt(5)), (1e-300, 0, 1e-300), (1e200, 1e200, 0), (1e-9, 1e-9, -1), (-0.0, -1e-12, 1)]
NOWHERE = [(0, 0, 0), (None, 1, 1), (float("nan"), 1, 1), (float("inf"), 0, 1)]


def sample(n: int, seed: int = 0) -> np.ndarray:
    """Directions all over, half of them crowded in one place."""
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, 3))
    v[: n // 2] = np.array([0.3, -0.5, 0.8]) + rng.standard_normal((n // 2, 3)) * 0.02
    return v / np.linalg.norm(v, axis=1)[:, None]


def frame(spark, v, start: int = 0):
    return spark.createDataFrame([(start + i, *map(float, p)) for i, p in enumerate(v)], "id long, x double, y double, z double")


@pytest.mark.parametrize("order", [0, 1, 4, 13, 29])
def test_pixels(spark, order):
    """Columns and arrays agree; a pixel's middle is in it, no place is farther from it than told, and orders nest."""
    v = np.concatenate([sample(2000), [sphere.unit(p) for p in PLACES]])
    got = sky.keyed(sky.keyed(frame(spark, v), AT), AT, "p", order)
    low, high = sphere.bounds(F.col("p"), order)
    rows = got.select("id", "p", sphere.parent(F.col(sphere.KEY), order).alias("up"), F.col(sphere.KEY).between(low, high).alias("inside")).orderBy("id").collect()
    p = sphere.pixels(v, order)
    assert [r.p for r in rows] == p.tolist() == [r.up for r in rows] and all(r.inside for r in rows)
    middle = sphere.centres(p, order)
    assert (sphere.apart(middle, v) <= sphere.reach(order)).all() and (sphere.pixels(middle, order) == p).all()


def test_all_pixels_of_an_order():
    """Every pixel of an order has a middle of its own, and all have the same area."""
    for order in range(5):
        every = np.arange(12 << 2 * order)
        assert (sphere.pixels(sphere.centres(every, order), order) == every).all()
    rng = np.random.default_rng(1)
    v = rng.standard_normal((480_000, 3))
    counts = np.bincount(sphere.pixels(v / np.linalg.norm(v, axis=1)[:, None], 1), minlength=48)
    assert (abs(counts - 10_000) < 500).all()


def test_no_place(spark):
    df = spark.createDataFrame([(i, *map(lambda x: None if x is None else float(x), p)) for i, p in enumerate([*NOWHERE, *PLACES])], "id long, x double, y double, z double")
    rows = sky.keyed(df, AT).orderBy("id").collect()
    assert [r._healpix_29 is None for r in rows] == [True] * 4 + [False] * len(PLACES)
    assert sky.cone_search(sky.keyed(df, AT), (0, 0, 1), 4, AT).count() == len(PLACES)
    with pytest.raises(ValueError, match="direction"):
        sphere.cone((0, 0, 0), 1)
    with pytest.raises(ValueError, match="radius"):
        sphere.cone((0, 0, 1), float("nan"))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([0.0, 1e-7, 1e-3, 0.05, 0.7, 2.0, 3.2]))
def test_cones_hold_all_that_is_near(seed, radius):
    """Ranges are in order and apart; every place within the radius is in one."""
    rng = np.random.default_rng(seed)
    middle = sphere.unit(rng.standard_normal(3))
    near = middle + rng.standard_normal((400, 3)) * radius / 3
    v = np.concatenate([[middle], near / np.linalg.norm(near, axis=1)[:, None]])
    ranges = sphere.cone(middle, radius)
    assert all(a <= b for a, b in ranges) and all(b + 1 < c for (_, b), (c, _) in zip(ranges, ranges[1:], strict=False)) and len(ranges) < 400
    keys = sphere.pixels(v[sphere.apart(v, middle) <= radius])
    assert all(any(a <= k <= b for a, b in ranges) for k in keys.tolist())
    rows, met = sphere.covers(v[:5], radius, 3)
    for i in range(5):
        assert set(sphere.pixels(v[sphere.apart(v, v[i]) <= radius], 3)) <= set(met[rows == i])


@pytest.mark.parametrize(("radius", "cell"), [(0.01, 20_000), (0.06, 7), (1.5, 20_000)])
def test_cross_match(spark, radius, cell):
    """All pairs within the radius, each once; crowded cells in parts."""
    a, b = sample(120, 1), sample(150, 2)
    left, right = frame(spark, a), frame(spark, b, 1000)
    angle = sphere.apart(a[:, None], b[None])
    got = sky.cross_match(left, right, radius, AT, ("id", "id"), cell=cell).select("left.id", F.col("right.id").alias("other")).collect()
    want = {(i, 1000 + j) for i, j in zip(*np.nonzero(angle <= radius), strict=True)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    near = sky.cross_match(left, right, radius, AT, ("id", "id"), nearest=2, cell=cell).select("left.id", "rank", F.col("right.id").alias("other")).collect()
    best = {(i, k + 1, 1000 + j) for i in range(len(a)) for k, j in enumerate(sorted(np.flatnonzero(angle[i] <= radius), key=lambda j, i=i: angle[i, j])[:2])}
    assert {tuple(r) for r in near} == best


def test_cross_match_of_odd_rows(spark):
    """What is nowhere matches nothing, ties go by name, rows that repeat are rows of their own."""
    kind = "id long, x double, y double, z double, left string"
    a = spark.createDataFrame([(1, 1.0, 0.0, 0.0, "a"), (2, 0.0, 0.0, 0.0, "b"), (3, None, 1.0, 0.0, "c"), (4, 0.0, 0.0, 1.0, "d"), (4, 0.0, 0.0, 1.0, "d")], kind)
    b = spark.createDataFrame([(9, 5.0, 0.0, 0.0, None), (7, 2.0, 0.0, 0.0, None), (8, None, None, None, None), (6, 0.0, 0.0, 0.5, None)], kind)
    got = sky.cross_match(a, b, 0.1, AT, ("id", "id")).selectExpr("left.id", "right.id AS other", "separation").collect()
    assert sorted(map(tuple, got)) == [(1, 7, 0.0), (1, 9, 0.0), (4, 6, 0.0), (4, 6, 0.0)]
    assert [r.other for r in sky.cross_match(a, b, 0.1, AT, ("id", "id"), nearest=1).selectExpr("left.id", "right.id AS other").filter("id = 1").collect()] == [7]
    assert sky.cross_match(a.limit(0), b, 0.1, AT, ("id", "id")).count() == 0 == sky.cross_match(a, b.limit(0), 0.1, AT, ("id", "id")).count()


def plain_tiles(keys: np.ndarray, deepest: int, most: int) -> dict[tuple, int]:
    found, open_ = {}, [(0, p) for p in range(12)]
    while open_:
        k, p = open_.pop()
        n = int((keys >> 2 * (29 - k) == p).sum())
        if n and (n <= most or k == deepest):
            found[k, p] = n
        elif n:
            open_ += [(k + 1, 4 * p + i) for i in range(4)]
    return found


@pytest.mark.parametrize(("deepest", "most"), [(6, 30), (2, 5), (0, 1), (5, 10_000)])
def test_tiles(spark, deepest, most):
    v = sample(400, 3)
    rows = sky.keyed(frame(spark, v), AT)
    got = {(r.order, r.pixel): r.rows for r in sky.tiles(sky.density(rows, deepest), deepest, most).collect()}
    assert got == plain_tiles(sphere.pixels(v), deepest, most)
    order, pixel = sky.tile_of(F.col(sphere.KEY), [Partition(*p) for p in got])
    dealt = rows.groupBy(order.alias("o"), pixel.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert {(r.o, r.p): r.n for r in dealt} == got
    assert [tuple(r) for r in spark.createDataFrame([(None,), (-1,)], "k long").select(*sky.tile_of(F.col("k"), [Partition(0, 3)])).collect()] == [(None, None)] * 2


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    v = sample(600, 4)
    catalog = tiling.build_catalog(frame(spark, v).repartition(5), tmp_path_factory.mktemp("sky") / "cat", AT, most=60, deepest=7, row_group_size=16)
    return catalog, v


def test_built_catalog(spark, made):
    catalog, v = made
    keys = sphere.pixels(v)
    want = plain_tiles(keys, 7, 60)
    assert {tuple(p) for p in catalog.partitions} == set(want) and len({p.order for p in catalog.partitions}) > 1
    assert catalog.properties["hats_skymap_order"] == "7" and catalog.properties["hats_nrows"] == "600"
    for p in catalog.partitions:
        file = pq.ParquetFile(catalog.path(p))
        own = file.read(columns=[sphere.KEY])[sphere.KEY].to_pylist()
        assert own == sorted(own) and len(own) == want[tuple(p)] and {k >> 2 * (29 - p.order) for k in own} == {p.pixel}
        assert [file.metadata.row_group(g).num_rows for g in range(file.num_row_groups)][:-1] == [16] * (file.num_row_groups - 1) or len(own) <= 16
    assert sum(r.rows for r in tiling.sky_map(catalog).collect()) == 600
    assert sorted(r.id for r in catalog.read().collect()) == list(range(600))
    assert not [p for p in catalog.fs.get_file_info(__import__("pyarrow").fs.FileSelector(catalog.root)) if "_temporary" in p.path]
    with pytest.raises(ValueError, match="2 rows have no position"):
        tiling.build_catalog(spark.createDataFrame([(1, 1.0, 0.0, 0.0), (2, None, 0.0, 0.0), (3, 0.0, 0.0, 0.0)], "id long, x double, y double, z double"), f"{catalog.root}-no", AT)
    with pytest.raises(ValueError, match="no rows"):
        tiling.build_catalog(frame(spark, v[:0]), f"{catalog.root}-none", AT)
    with pytest.raises(Exception, match="already"):
        tiling.build_catalog(frame(spark, v), catalog.root, AT, most=60, deepest=7)


@pytest.mark.parametrize(("middle", "radius"), [((0.3, -0.5, 0.8), 0.02), ((0, 0, 1), 0.4), ((1, 1, 1), 1e-5), ((0, 1, 0), 3.2)])
def test_search_of_a_catalog(spark, made, middle, radius):
    """Files and row groups are left out before any angle is worked out, and nothing else is."""
    catalog, v = made
    found = sky.search_catalog(catalog, middle, radius, AT, ["id"])
    far = sphere.apart(v, sphere.unit(middle))
    assert {r.id: round(r.separation, 12) for r in found.collect()} == {i: round(float(far[i]), 12) for i in np.flatnonzero(far <= radius)}
    opened = overlapping(catalog.partitions, sphere.cone(middle, radius))
    assert len(found.inputFiles()) == len(opened) if opened else True
    if 0 < radius < 3:
        assert len(opened) < len(catalog.partitions)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not opened or "GreaterThanOrEqual(_healpix_29" in plan.replace(" ", "") or "PushedFilters: [Or(" in plan or "PushedFilters: [IsNotNull(_healpix_29)" in plan


def test_reading_by_options(spark, made):
    """The source opens the files and row groups that it is asked for, and gives these rows, whatever queries the DataFrame saw before."""
    catalog, v = made
    df = datasource.scan(spark, catalog.url, places=True)
    assert df.columns == ["id", *AT, "_healpix_29", "_order", "_pixel", "_row"]
    p = catalog.partitions[3]
    assert df.filter((F.col("_order") == p.order) & (F.col("_pixel") == p.pixel)).count() == pq.read_metadata(catalog.path(p)).num_rows and df.count() == 600
    one = datasource.scan(spark, catalog.url, ["id"], partitions=[p], places=True)
    assert sorted(r._row for r in one.collect()) == list(range(pq.read_metadata(catalog.path(p)).num_rows)) and one.rdd.getNumPartitions() == 1
    keys = np.sort(sphere.pixels(v))
    ranges = [tuple(map(int, keys[[100, 130]])), tuple(map(int, keys[[400, 401]]))]
    some = datasource.scan(spark, catalog.url, ["id"], within=ranges, places=True)
    assert some.columns == ["id", "_order", "_pixel", "_row"] and some.rdd.getNumPartitions() < len(catalog.partitions)
    of = dict(zip(range(600), sphere.pixels(v).tolist(), strict=True))
    assert sorted(of[r.id] for r in some.collect()) == [*keys[100:131].tolist(), *keys[400:402].tolist()]
    placed = {(r._order, r._pixel, r._row): r.id for r in df.collect()}
    assert all(placed[r._order, r._pixel, r._row] == r.id for r in some.collect())
    assert datasource.scan(spark, catalog.url, within=[]).count() == 0 == datasource.scan(spark, catalog.url, partitions=[]).count()
    with pytest.raises(ValueError, match="errors"):
        datasource.scan(spark, catalog.url, errors="none")


def test_a_damaged_file_is_a_row(spark, made, tmp_path):
    catalog, v = made
    copy = tiling.build_catalog(frame(spark, v), tmp_path / "copy", AT, most=200, deepest=7)
    path = tmp_path / "copy/dataset" / copy.partitions[1].file
    n = pq.read_metadata(path).num_rows
    held = path.read_bytes()
    path.write_bytes(held[:60] + bytes(200) + held[260:])
    df = datasource.scan(spark, str(tmp_path / "copy"), places=True, errors="column")
    bad = df.filter("_error is not null").collect()
    assert [(r._order, r._pixel) for r in bad] == [tuple(copy.partitions[1])] and df.count() == 600 - n + 1
    with pytest.raises(Exception, match="rror"):
        spark.read.format("tessera").load(str(tmp_path / "copy")).collect()


def test_nothing_appears_before_the_commit(spark, tmp_path):
    """A task that fails twice, or two tasks with rows of one partition, leave nothing; what is there stays as it was."""
    datasource.register(spark)
    rows = spark.range(60).select("id", F.lit(1).alias("_order"), (F.col("id") % 3).alias("_pixel"))
    write = lambda df, mode="append": df.write.format("tessera").mode(mode).option("path", str(tmp_path / "c")).save()
    bad = datasource.clustered(rows.withColumn("id", F.when((F.col("id") == 50), F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id"))), "id")
    with pytest.raises(Exception, match="broken"):
        write(bad)
    left = [p for p in (tmp_path / "c").rglob("*") if p.is_file()]
    assert left == []
    with pytest.raises(Exception, match="several tasks"):
        write(rows.repartition(4))
    assert [p for p in (tmp_path / "c").rglob("*") if p.is_file()] == []
    write(datasource.clustered(rows, "id"))
    assert {tuple(p) for p in open_catalog(spark, tmp_path / "c").partitions} == {(1, 0), (1, 1), (1, 2)}
    with pytest.raises(Exception, match="already"):
        write(datasource.clustered(rows.filter("_pixel = 1"), "id"))
    assert open_catalog(spark, tmp_path / "c").read().count() == 60
    write(datasource.clustered(rows.filter("_pixel = 1"), "id"), "overwrite")
    assert open_catalog(spark, tmp_path / "c").read().count() == 20 and len(open_catalog(spark, tmp_path / "c").partitions) == 1
    assert json.dumps(open_catalog(spark, tmp_path / "c").properties).count("hats_nrows") == 1
