"""Queries in SQL text on the driver's tables: partitions made of orders, vectors as spectra, a small catalog of them as views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.tokenizer import ERROR, Tokenizer
from tessera.plans import sql
from tessera.plans.registry import Modality
from tessera.plans.shared import folder, table
from tessera.plans.specs import Spec
from tessera.sources import sink

FEW = Modality("VectorFew", "spectrum", "tok_few", 16)


def _views(spark: SparkSession, sf: str, *names: str) -> None:
    sql.register(spark)
    for name in names:
        table(spark, sf, name).createOrReplaceTempView(name)


def _spectra(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    spectrum = F.struct(e.alias("flux"), e.alias("ivar"), F.transform(e, lambda x, i: i.cast("float")).alias("wavelength"))
    return table(spark, sf, "embeddings").select("vec_id", "label", spectrum.alias("spectrum"))


def sql_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Names of partitions, and partitions of these names, in SQL."""
    _views(spark, sf, "orders")
    return spark.sql("""
        WITH p AS (SELECT DISTINCT CAST(o_orderkey % 3 + 4 AS INT) AS norder, o_custkey AS npix FROM orders)
        SELECT norder, npix, partition_file(norder, npix) AS file, partition_label(norder, npix) AS label, partition_of(partition_label(norder, npix)).pixel AS back,
          pixel_parent(npix, norder, norder - 2) AS parent, pixel_first(npix % 3072, norder) AS first FROM p""")


def sql_bands(spark: SparkSession, sf: str) -> DataFrame:
    _views(spark, sf, "events")
    return spark.sql("SELECT band_of(event_type, 'HSC') AS band, count(*) AS n FROM events GROUP BY 1")


def sql_spectra(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of each vector that a spectrum's mask leaves out, and the finite flux of the rest."""
    _views(spark, sf, "embeddings")
    return spark.sql("""
        SELECT vec_id, CAST(size(filter(ignored, m -> m)) AS BIGINT) AS n_ignored, aggregate(zip_with(flux, ignored, (f, m) -> IF(m, 0D, CAST(f AS DOUBLE))), 0D, (a, v) -> a + v) AS flux
        FROM (SELECT vec_id, zero_unless_finite(embedding) AS flux, spectrum_ignored(embedding, embedding) AS ignored FROM embeddings)""")


def explode_table(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of two token columns as rows, the other columns of the table beside them."""
    sql.register(spark)
    plain = Spec(Modality("VectorId", "scalar", "tok_id", 1), "vec_id", drop_source=False)
    Tokenizer([Spec(FEW, "spectrum"), plain]).transform(_spectra(spark, sf)).createOrReplaceTempView("vector_tokens")
    return spark.sql("SELECT * FROM explode_tokens(TABLE(vector_tokens), 'tok_few', 'TOK_ID')")


def explode_lateral(spark: SparkSession, sf: str) -> DataFrame:
    """The same beside each row, from where SQL goes on: how often each code is used in each label."""
    sql.register(spark)
    Tokenizer([Spec(FEW, "spectrum")]).transform(_spectra(spark, sf)).createOrReplaceTempView("vector_tokens_lateral")
    return spark.sql("""
        SELECT t.label, e.column, e.code, count(*) AS n, min(e.position) AS first_position
        FROM vector_tokens_lateral t, LATERAL explode_tokens(few => t.tok_few) e GROUP BY ALL""")


def sql_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog of vectors as views: its partitions beside the tokens of their rows, half of which are read."""
    rows = _spectra(spark, sf).drop("label").withColumns({"_order": F.lit(5), "_pixel": F.col("vec_id") % 4, "_row": F.col("vec_id"), ERROR: F.lit(None).cast("string")})
    url = f"{folder(spark)}/vectors_desi"
    sink.write_partitions(rows, url).collect()
    sink.finalize(url, spark=spark)
    sql.register(spark)
    sql.attach(spark, "vectors_desi", url, "spectrum")
    return spark.sql("""
        SELECT p.pixel, p.file, count(*) AS rows, sum(t.tok_spectrum_desi.token[0]) AS first_tokens
        FROM vectors_desi_partitions p JOIN vectors_desi_tokens t ON t._order = p.order AND t._pixel = p.pixel WHERE t.vec_id % 8 < 4 GROUP BY 1, 2""")


_BASE = "(round_even(abs(list_sum(list_transform(embedding, lambda x: x::DOUBLE))) * 1000, 0) % 4000)::BIGINT"
_CODES = f"SELECT vec_id, label, i::INT AS position, ({_BASE} + i) % 4096 AS code FROM embeddings, generate_series(0, 15) g(i)"
_IGNORED = "NOT isfinite(x) OR x <= 0"

QUERIES = {f.__name__: f for f in (sql_partitions, sql_bands, sql_spectra, explode_table, explode_lateral, sql_catalog)}

ORACLE_SQL = {
    "sql_partitions": """SELECT DISTINCT (o_orderkey % 3 + 4)::INT AS norder, o_custkey AS npix, 'Norder=' || (o_orderkey % 3 + 4) || '/Dir=' || (o_custkey // 10000 * 10000) || '/Npix=' || o_custkey || '.parquet' AS file,
        'Norder=' || (o_orderkey % 3 + 4) || '/Npix=' || o_custkey AS label, o_custkey AS back, o_custkey // 16 AS parent, (o_custkey % 3072 * 4 ** (29 - (o_orderkey % 3 + 4)))::BIGINT AS first FROM orders""",
    "sql_bands": "SELECT CASE WHEN contains(b, '-') THEN b ELSE 'HSC-' || b END AS band, count(*) AS n FROM (SELECT replace(upper(event_type), '_', '-') AS b FROM events) GROUP BY 1",
    "sql_spectra": f"SELECT vec_id, len(list_filter(embedding, lambda x: {_IGNORED})) AS n_ignored, coalesce(list_sum(list_transform(embedding, lambda x: CASE WHEN {_IGNORED} THEN 0::DOUBLE ELSE x::DOUBLE END)), 0) AS flux FROM embeddings",
    "explode_table": f"SELECT vec_id, label, 'tok_few' AS \"column\", position, code FROM ({_CODES}) UNION ALL SELECT vec_id, label, 'tok_id', 0, (round_even(abs(vec_id::FLOAT::DOUBLE) * 1000, 0) % 4000)::BIGINT FROM embeddings",
    "explode_lateral": f"SELECT label, 'few' AS \"column\", code, count(*) AS n, min(position) AS first_position FROM ({_CODES}) GROUP BY 1, 2, 3",
    "sql_catalog": f"""SELECT vec_id % 4 AS pixel, 'Norder=5/Dir=0/Npix=' || (vec_id % 4) || '.parquet' AS file, count(*) AS "rows", sum({_BASE} % 4096)::BIGINT AS first_tokens FROM embeddings WHERE vec_id % 8 < 4 GROUP BY 1, 2""",
}
