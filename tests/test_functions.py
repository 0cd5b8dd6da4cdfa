from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import bands, layout, properties, shapes
from tessera.functions.layout import Partition

NESTED = [([[1, 2], [3, 4]], True), (None, False), ([[1, 2], [3]], False), ([[5, 6]], True), ([None, [1]], False), ([None, None], False), ([], False), ([[], []], False), ([[1, None]], True)]


def test_regular_and_shape(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(NESTED)], "i int, x array<array<int>>")
    got = {r.i: (r.ok, r.s) for r in df.select("i", shapes.regular(F.col("x"), 2).alias("ok"), shapes.shape(F.col("x"), 2).alias("s")).collect()}
    assert [got[i][0] for i in range(len(NESTED))] == [ok for _, ok in NESTED]
    assert got[0][1] == [2, 2] and got[3][1] == [1, 2] and got[1][1] is None


def test_finite_is_judged_in_single_precision(spark):
    df = spark.createDataFrame([(1.5,), (1e300,), (float("nan"),), (None,), (float("-inf"),)], "x double")
    assert [r[0] for r in df.select(shapes.finite(F.col("x"))).collect()] == [True, False, False, False, False]


@pytest.mark.parametrize(("kind", "null_masks"), [("boolean", False), ("int", True)])
def test_null_in_a_mask(spark, kind, null_masks):
    one = F.from_json(F.lit("[1, null, 0]"), "array<int>").cast(f"array<{kind}>")
    ones = F.array(*[F.lit(1.0)] * 3)
    got = spark.range(1).select(shapes.spectrum_mask(ones, ones, one, kind == "boolean")).first()[0]
    assert got == [True, null_masks, False]


def test_spectrum_mask_without_a_mask(spark):
    flux, ivar = F.array(*map(F.lit, (1.0, float("nan"), 1.0, 1.0))), F.array(*map(F.lit, (1.0, 1.0, 0.0, float("inf"))))
    assert spark.range(1).select(shapes.spectrum_mask(flux, ivar)).first()[0] == [False, True, True, True]


@pytest.mark.parametrize(("label", "band"), [("des-g", "DES-G"), ("g", "DES-G"), ("des_r", "DES-R"), ("HSC-Y", "HSC-Y")])
def test_bands(spark, label, band):
    assert bands.normalize(label, "DES") == band
    assert spark.range(1).select(bands.normalized(F.lit(label), "DES")).first()[0] == band


def test_unknown_band():
    with pytest.raises(ValueError, match="jwst"):
        bands.normalize("jwst-f200w", "DES")


@pytest.mark.parametrize(("text", "key"), [("Norder=4/Npix=1005", (4, 1005)), ("4/1005", (4, 1005)), ("/a1/dataset/Norder=6/Dir=10000/Npix=15000.parquet", (6, 15000)), ("Npix=7", None), ("1 2 3", None)])
def test_parse(spark, text, key):
    got = spark.range(1).select(layout.parsed(F.lit(text))).first()[0]
    assert (got and tuple(got)) == key
    if key:
        assert layout.named(text) == Partition(*key)
    else:
        with pytest.raises(ValueError):
            layout.named(text)


@given(st.integers(0, 29), st.integers(0, 10**9))
def test_path_round_trip(order, pixel):
    p = Partition(order, pixel)
    assert layout.named(p.file) == p == layout.named(str(p))
    folder = layout.values(order, pixel)[1]
    assert folder % 10_000 == 0 <= pixel - folder < 10_000 and f"/Dir={folder}/" in p.file


def test_properties(spark):
    text = "#title\n! x\n\n a = 1 \nb=2=3\nnothing\na=4\n"
    assert properties.read(text) == {"a": "4", "b": "2=3"}
    assert properties.write({"a": 1, "b": None, "c": "x"}, "T") == "#T\na=1\nc=x\n"
    got = spark.createDataFrame([(text,)], "t string").select(F.inline(properties.pairs(F.col("t")))).collect()
    assert [tuple(r) for r in got] == [("a", "1"), ("b", "2=3"), ("a", "4")]
