from __future__ import annotations

import numpy as np
import pytest

from tessera import Modality, Spec, Tokenizer

SCALAR = Modality("S", "scalar", "tok_s", 1)
IMAGE = Modality("I", "image", "tok_i", 5, prefix="DES")
SPECTRUM = Modality("P", "spectrum", "tok_p", 3)
NEST = "array<array<array<double>>>"


def both(spark, rows, kind, spec, **more):
    """The column form and the batch form, which must agree."""
    df = spark.createDataFrame(rows, f"i int, x {kind}")
    got = [sorted(Tokenizer([spec], batches=b, batch_rows=n, **more).transform(df, "column").select("i", spec.output, "_error").collect()) for b, n in ((False, 64), (True, 64), (True, 2))]
    assert [[r[:2] for r in g] for g in got[1:2]] == [[r[:2] for r in got[0]]] or any(r[2] for r in got[0])
    return got


def test_scalars(spark):
    values = [1.5, 2.0005, -3.25, float("nan"), float("inf"), 1e300, None, 0.0]
    one, two, three = both(spark, list(enumerate(values)), "double", Spec(SCALAR, "x"))
    assert one == two == three
    assert [r[1] for r in one] == [1500, int(np.rint(np.float32(2.0005).astype(float) * 1000)), 3250, None, None, None, None, 0]


def test_images(spark):
    ok = [[[1.0, 2.0], [3.0, float("nan")]], [[float("inf"), 1.0], [1.0, 1.0]]]
    rows = [(0, (["des-g", "r"], ok)), (1, None), (2, (["des-g"], ok)), (3, (["des-g", "r"], [[[1.0]], [[1.0, 2.0]]])), (4, (["des-g", "r"], None)), (5, (None, ok)), (6, (["des-g", "r"], [[[1.0]], [[2.0]]])), (7, (["des-g", "r"], [None, [[1.0, 2.0], [1.0, 2.0]]]))]
    one, two, three = both(spark, rows, f"struct<band:array<string>,flux:{NEST}>", Spec(IMAGE, "x"), min_side=2)
    assert one == two == three
    base = 9000 % 4000
    assert one[0][1].token == [base + i for i in range(5)] and all(r[1] is None and r[2] is None for r in one[1:])


@pytest.mark.parametrize("label", ["jwst-f200w", None])
def test_unknown_or_null_band_is_an_error(spark, label):
    rows = [(0, (["des-g"], [[[1.0, 2.0], [3.0, 4.0]]])), (1, ([label], [[[1.0, 2.0], [3.0, 4.0]]]))]
    one, two, _ = both(spark, rows, f"struct<band:array<string>,flux:{NEST}>", Spec(IMAGE, "x"), min_side=2)
    assert one[0][2] is None and one[1][2] and one[1][1] is None and two[1][2]
    with pytest.raises(Exception, match="band"):
        df = spark.createDataFrame(rows, f"i int, x struct<band:array<string>,flux:{NEST}>")
        Tokenizer([Spec(IMAGE, "x")], min_side=2).transform(df).collect()


def test_spectra(spark):
    ones = [1.0, 1.0]
    rows = [(0, ([1.0, 2.0], ones, ones)), (1, None), (2, ([1.0, float("nan")], ones, ones)), (3, ([], [], [])), (4, ([-4.0], [1.0], [1.0])), (5, (None, ones, ones))]
    one, two, three = both(spark, rows, "struct<flux:array<double>,ivar:array<double>,lambda:array<double>>", Spec(SPECTRUM, "x"))
    assert one == two == three
    assert [r[1] and r[1].token[0] for r in one] == [3000, None, 1000, None, 0, None]
    one, two, _ = both(spark, [(0, ([1.0, 2.0], [1.0], ones))], "struct<flux:array<double>,ivar:array<double>,lambda:array<double>>", Spec(SPECTRUM, "x"))
    assert "differ in length" in one[0][2] and "differ in length" in two[0][2]


def test_int32_and_order_of_columns(spark):
    df = spark.createDataFrame([(1, 2.0, "a")], "i int, x double, s string")
    out = Tokenizer([Spec(SCALAR, "x", "t", True)], number="int32").transform(df)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema.fields] == [("i", "int"), ("s", "string"), ("t", "int")]


def test_codec_with_a_wrong_number_of_tokens(spark):
    class Wrong:
        def validate(self):
            return None

        def encode(self, batch):
            return [[0, 0]] * len(batch.flux)

    df = spark.createDataFrame([(1, 2.0)], "i int, x double")
    assert "tokens" in Tokenizer([Spec(SCALAR, "x")], Wrong()).transform(df, "column").first()["_error"]


@pytest.mark.parametrize("n", [2, 100, 4096, 5000])
def test_any_number_of_tokens(spark, n):
    """Tokens begin anew after the last code, in both forms."""
    many = Modality("P", "spectrum", "tok_p", n)
    ones = [1.0]
    one, two, _ = both(spark, [(0, ([3.999], ones, ones)), (1, ([0.0], ones, ones)), (2, ([3.95], ones, ones))], "struct<flux:array<double>,ivar:array<double>,lambda:array<double>>", Spec(many, "x"))
    assert one == two and [r[1].token for r in one] == [[(b + i) % 4096 for i in range(n)] for b in (3999, 0, 3950)]


def test_frames_of_different_batch_rows(spark):
    """A codec is given no more rows than its own frame says, whatever another frame has set since."""

    class Most:
        def validate(self):
            return None

        def encode(self, batch):
            return [[len(batch.flux)]] * len(batch.flux)

    df = spark.range(1000).selectExpr("id", "double(id) x").coalesce(1)
    small, large = (Tokenizer([Spec(SCALAR, "x")], Most(), batch_rows=n).transform(df) for n in (7, 500))
    assert large.agg({"tok_s": "max"}).first()[0] <= 500 and small.agg({"tok_s": "max"}).first()[0] <= 7


def test_needs_a_spec():
    with pytest.raises(ValueError):
        Tokenizer([])
