"""SQL functions against the columns of the API, views with the API's plans, token columns as rows against plain loops."""

from __future__ import annotations

import re

import catalogs
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import bands, layout, shapes, sphere
from tessera.operators.rows import ExplodeTokens, codes, explode_tokens, is_token
from tessera.operators.tokenizer import Tokenizer
from tessera.plans import specs, sql
from tessera.sources.catalog import open_catalog

TOKENS = [(1, [5, 6], 7, "x"), (1, [5, 6], 7, "x"), (2, [], None, None), (3, None, 4, ""), (None, [None, 9], 0, "y")]
SCHEMA = "id int, many struct<token: array<int>>, one long, note string"


@pytest.fixture(scope="module")
def session(spark):
    assert sql.register(spark) == sql.register(spark) == [*sql.FUNCTIONS, "explode_tokens"]
    return spark


@pytest.fixture(scope="module")
def tokens(session):
    df = session.createDataFrame([(i, None if t is None else (t,), o, n) for i, t, o, n in TOKENS], SCHEMA)
    df.createOrReplaceTempView("some_tokens")
    return df


def plan(df) -> str:
    """The optimized plan without the numbers of its columns."""
    return re.sub(r"#\d+L?|_\d+\b", "", df._jdf.queryExecution().optimizedPlan().toString())


def wanted(names, keep=("id", "note")) -> list[tuple]:
    out = []
    for i, many, one, note in TOKENS:
        for n in names:
            value = {"many": many, "one": None if one is None else [one]}[n]
            out += [(*[{"id": i, "note": note}[k] for k in keep], n, p, c) for p, c in enumerate(value or [])]
    return sorted(out, key=repr)


NAMED = ["Norder=4/Dir=0/Npix=119.parquet", "a/b/Norder=6/Dir=10000/Npix=15000.parquet", "4/119", "x 5 y 7 z", "Npix=3", "", None]
NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize(
    ("text", "column", "kind", "values"),
    [
        ("partition_of(x)", lambda: layout.parsed(F.col("x")), "string", NAMED),
        ("partition_file(5, x)", lambda: layout.file(F.lit(5), F.col("x")), "bigint", [0, 9999, 10000, 15000, 123456789012, None]),
        ("partition_label(5, x)", lambda: layout.label(F.lit(5), F.col("x")), "bigint", [0, 15000, None]),
        ("band_of(x, 'DES')", lambda: bands.normalized(F.col("x"), "DES"), "string", ["g", "des_g", "DES-R", "hsc-y", "", None]),
        ("zero_unless_finite(x)", lambda: shapes.zero_unless_finite(F.col("x")), "array<float>", [[1.0, NAN, INF, -INF, None], [], None]),
        ("spectrum_ignored(x, x)", lambda: shapes.spectrum_mask(F.col("x"), F.col("x")), "array<float>", [[1.0, NAN, INF, -INF, None, 0.0, -2.0], [], None]),
        ("pixel_parent(x, 29, 5)", lambda: sphere.parent(F.col("x"), 5), "bigint", [0, 1 << 40, (1 << 61) - 1, None]),
        ("pixel_first(x, 5)", lambda: sphere.bounds(F.col("x"), 5)[0], "bigint", [0, 7, 12287, None]),
    ],
)
def test_functions_are_the_columns(session, text, column, kind, values):
    df = session.createDataFrame([(v,) for v in values], f"x {kind}")
    assert [repr(r) for r in df.select(F.expr(text).alias("y")).collect()] == [repr(r) for r in df.select(column().alias("y")).collect()]
    assert "UDF" not in plan(df.selectExpr(f"{text} AS y")) and "sql_function" not in plan(df.selectExpr(f"{text} AS y")).lower()


def test_views_have_the_plans_of_the_api(session, tmp_path):
    root = catalogs.make(tmp_path / "in")
    assert sql.attach(session, "sky", root, ["ebv", "image"]) == ["sky", "sky_partitions", "sky_tokens"]
    catalog = open_catalog(session, root)
    own = Tokenizer(specs.resolve(catalog.schema, ["ebv", "image"], catalog.name)).transform(catalog.read(keys=True))
    text = "SELECT object_id, tok_ebv FROM sky_tokens WHERE flux_g > 1.5"
    assert plan(session.sql(text)) == plan(own.filter("flux_g > 1.5").select("object_id", "tok_ebv"))
    physical = session.sql(text)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(flux_g,1.5)" in physical and "z_spec" not in physical and "spectrum" not in physical
    assert session.sql("SELECT count(*) FROM sky_tokens WHERE tok_image IS NULL").first()[0] == 3
    assert session.sql("SELECT p.file, count(*) AS n FROM sky_partitions p JOIN sky s ON s._order = p.order AND s._pixel = p.pixel GROUP BY 1").count() == 3
    # Anew without tokens: none are left over; a wrong request leaves all views as they were.
    assert sql.attach(session, "sky", catalog) == ["sky", "sky_partitions"] and not session.catalog.tableExists("sky_tokens")
    with pytest.raises((KeyError, ValueError)):
        sql.attach(session, "sky", root, "ebv = Nope")
    with pytest.raises(ValueError, match="no name"):
        sql.attach(session, "sky; x", root)
    assert session.sql("SELECT count(*) FROM sky").first()[0] == 22


def test_explode(session, tokens):
    got = lambda text: sorted(map(tuple, session.sql(text).collect()), key=repr)
    assert got("SELECT * FROM explode_tokens(TABLE(some_tokens), 'many', 'ONE')") == wanted(["many", "one"])
    assert got("SELECT note, column, position, code FROM explode_tokens(TABLE(SELECT note, one FROM some_tokens), 'one')") == wanted(["one"], ["note"])
    assert got("SELECT t.id, e.* FROM some_tokens t, LATERAL explode_tokens(many => t.many, one => t.one) e") == wanted(["many", "one"], ["id"])
    assert sorted(map(tuple, explode_tokens(tokens.asTable(), F.lit("many")).filter("code > 5").collect()), key=repr) != []
    assert got("SELECT * FROM explode_tokens(TABLE(SELECT * FROM some_tokens WHERE id > 9), 'many')") == []
    assert session.sql("SELECT * FROM explode_tokens(TABLE(some_tokens), 'many')").dtypes == [("id", "int"), ("one", "bigint"), ("note", "string"), ("column", "string"), ("position", "int"), ("code", "bigint")]


@pytest.mark.parametrize(
    ("call", "why"),
    [
        ("TABLE(some_tokens), 'note'", "no token columns: note"),
        ("TABLE(some_tokens), 'none'", "0 columns 'none'"),
        ("TABLE(some_tokens)", "names of its token columns"),
        ("", "needs a table"),
        ("a => 'x'", "no token columns: a"),
        ("TABLE(SELECT one, 1 AS Code FROM some_tokens), 'one'", "rename Code"),
    ],
)
def test_explode_says_why(session, tokens, call, why):
    with pytest.raises(Exception, match=why):
        session.sql(f"SELECT * FROM explode_tokens({call})")


def test_token_types():
    yes, no = ["int", "bigint", "array<int>", "struct<token: array<bigint>>"], ["double", "string", "array<string>", "array<array<int>>", "struct<token: int>", "struct<token: array<int>, x: int>", "struct<token: array<array<int>>>"]
    kinds = lambda names: [T.StructType.fromDDL(f"x {n}")["x"].dataType for n in names]
    assert [is_token(k) for k in kinds(yes + no)] == [True] * len(yes) + [False] * len(no)
    assert list(codes(None)) == [] and list(codes(0)) == [(0, 0)] and list(codes([None, 3])) == [(0, None), (1, 3)]
    assert list(ExplodeTokens.places(T.StructType.fromDDL("a int, A int, b int"), ["A", "B", "b"])) == [1, 2]
