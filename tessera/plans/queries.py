"""One query for each operator of the engine on the driver's tables, and DuckDB SQL for those that SQL can express.

The tables hold no images or spectra, so vectors of 64 numbers stand in for spectra and for blocks of
4 x 4 x 4, lines of words for ragged lists, and numbers of sales for scalars.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import bands, layout, properties, shapes
from tessera.operators import selection, statistics
from tessera.operators.tokenizer import ERROR, Tokenizer
from tessera.plans import bookkeeping, history, job, sky_queries, specs, sql_queries, stream_queries
from tessera.plans.registry import Modality
from tessera.plans.shared import folder, table
from tessera.plans.specs import Spec
from tessera.sources import joined, sink
from tessera.sources.catalog import normalized, open_catalog
from tessera.streaming import tokens

PRICE = Modality("Price", "scalar", "tok_price", 1, "l_extendedprice")
VALUE = Modality("Value", "scalar", "tok_value", 1, "value")
TOTAL = Modality("Total", "scalar", "tok_total", 1, "o_totalprice")
ONE = Modality("VectorOne", "spectrum", "tok_vector", 1)
MANY = Modality("VectorMany", "spectrum", "tok_vector", 16)
BLOCK = Modality("Block", "image", "tok_block", 8, prefix="DES")


def _spectra(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as spectra; ivar is the vector itself, so its negative parts are masked."""
    e = F.col("embedding")
    spectrum = F.struct(e.alias("flux"), e.alias("ivar"), F.transform(e, lambda x, i: i.cast("float")).alias("wavelength"))
    return table(spark, sf, "embeddings").select("vec_id", spectrum.alias("spectrum"))


def _cube(e: Column, side: int) -> Column:
    """64 numbers as bands x side x side."""
    per = side * side
    band = lambda b: F.array(*[F.slice(e, b * per + r * side + 1, side) for r in range(side)])
    return F.array(*[band(b) for b in range(64 // per)])


def _images(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as four bands of 4 x 4; every fifth has a label too few, every seventh is null."""
    names = F.when(F.col("vec_id") % 5 == 0, F.array(*map(F.lit, ("des-g", "des-r", "des-i")))).otherwise(F.array(*map(F.lit, ("des-g", "des_r", "I", "z"))))
    image = F.when(F.col("vec_id") % 7 != 0, F.struct(names.alias("band"), _cube(F.col("embedding"), 4).alias("flux")))
    return table(spark, sf, "embeddings").select("vec_id", image.alias("image"))


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as lines of words."""
    return table(spark, sf, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.split(x, " ")).alias("x"))


def _keys(spark: SparkSession, sf: str) -> DataFrame:
    """Partitions made of orders: order 4 to 6, pixel the customer."""
    return table(spark, sf, "orders").select((F.col("o_orderkey") % 3 + 4).cast("int").alias("order"), F.col("o_custkey").alias("pixel")).distinct()


KEYS = "SELECT DISTINCT (o_orderkey % 3 + 4)::INT AS \"order\", o_custkey AS pixel FROM orders"


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    """Sales as rows of partitions by supplier."""
    return table(spark, sf, "lineitem").select((F.col("l_suppkey") % 3 + 4).cast("int").alias("order"), F.col("l_suppkey").alias("pixel"), "l_orderkey", "l_linenumber")


ROWS = "SELECT (l_suppkey % 3 + 4)::INT AS \"order\", l_suppkey AS pixel, l_orderkey, l_linenumber FROM lineitem"


def _counted(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf).groupBy("order", "pixel").agg(F.count(F.lit(1)).alias("rows"))


def _odd_values(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id") % 10
    odd = F.when(i == 1, float("nan")).when(i == 3, 1e300).when(i == 5, float("-inf")).when(i == 7, F.lit(None)).otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_id", odd.alias("value"))


def scalar_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return Tokenizer([Spec(PRICE, "l_extendedprice", drop_source=True)]).transform(rows)


def scalar_invalid_null(spark: SparkSession, sf: str) -> DataFrame:
    return Tokenizer([Spec(VALUE, "value", drop_source=True)]).transform(_odd_values(spark, sf))


def vector_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return Tokenizer([Spec(ONE, "spectrum")]).transform(_spectra(spark, sf))


def vector_tokens_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The same through Arrow batches, as any model's codec runs."""
    return Tokenizer([Spec(ONE, "spectrum")], batches=True, batch_rows=512).transform(_spectra(spark, sf))


def token_explode(spark: SparkSession, sf: str) -> DataFrame:
    tokens = Tokenizer([Spec(MANY, "spectrum")]).transform(_spectra(spark, sf))
    return tokens.select("vec_id", F.posexplode("tok_vector.token").alias("pos", "token"))


def token_struct(spark: SparkSession, sf: str) -> DataFrame:
    tokens = Tokenizer([Spec(BLOCK, "image")], min_side=4).transform(_images(spark, sf))
    return tokens.select("vec_id", F.col("tok_block").isNull().alias("is_null"), F.array_join("tok_block.token", ",").alias("tokens"))


def image_tokens(spark: SparkSession, sf: str) -> DataFrame:
    tokens = Tokenizer([Spec(BLOCK, "image")], min_side=4).transform(_images(spark, sf))
    return tokens.select("vec_id", F.get("tok_block.token", F.lit(0)).alias("first"), F.size("tok_block.token").cast("long").alias("n"))


def image_min_size(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of 4 x 4 or 8 x 8, of which only those of at least 5 x 5 have tokens."""
    e = F.col("embedding")
    flux = F.when(F.col("vec_id") % 3 == 0, _cube(e, 8)).otherwise(_cube(e, 4))
    names = F.slice(F.array(*map(F.lit, ("des-g", "des-r", "des-i", "des-z"))), 1, F.size(flux))
    rows = table(spark, sf, "embeddings").select("vec_id", F.struct(names.alias("bands"), flux.alias("flux")).alias("image"))
    return Tokenizer([Spec(BLOCK, "image")], min_side=5).transform(rows).select("vec_id", F.col("tok_block").isNotNull().alias("has_tokens"))


def label_count_null(spark: SparkSession, sf: str) -> DataFrame:
    tokens = Tokenizer([Spec(BLOCK, "image")], min_side=4).transform(_images(spark, sf))
    return tokens.groupBy((F.col("vec_id") % 5).alias("r")).agg(F.count("tok_block").alias("with_tokens"), F.count(F.lit(1)).alias("n"))


def nan_to_num(spark: SparkSession, sf: str) -> DataFrame:
    rows = _odd_values(spark, sf).withColumn("values", F.array("value", F.lit(2.5), F.lit(float("inf"))))
    clean = F.transform(shapes.zero_unless_finite(F.col("values")), lambda v: v.cast("double"))
    return rows.select("event_id", *[F.get(clean, F.lit(i)).alias(f"v{i}") for i in range(3)])


def nested_shape(spark: SparkSession, sf: str) -> DataFrame:
    dims = shapes.shape(F.col("x"), 2)
    return _lists(spark, sf).select("doc_id", *[F.get(dims, F.lit(i)).cast("long").alias(f"d{i}") for i in range(2)])


def ragged_flag(spark: SparkSession, sf: str) -> DataFrame:
    return _lists(spark, sf).select("doc_id", shapes.regular(F.col("x"), 2).alias("regular"))


def shape_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each dense shape; a group's rows are counted, not gathered."""
    dims = shapes.shape(F.col("x"), 2)
    dense = _lists(spark, sf).filter(shapes.regular(F.col("x"), 2)).select(*[F.get(dims, F.lit(i)).cast("long").alias(f"d{i}") for i in range(2)])
    return dense.groupBy("d0", "d1").agg(F.count(F.lit(1)).alias("n"))


def spectrum_mask(spark: SparkSession, sf: str) -> DataFrame:
    mask = shapes.spectrum_mask(F.col("spectrum.flux"), F.col("spectrum.ivar"))
    return _spectra(spark, sf).select("vec_id", F.size(F.filter(mask, lambda m: m)).cast("long").alias("masked"))


def band_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", bands.normalized(F.col("event_type"), "DES").alias("band"))


def unknown_band_error(spark: SparkSession, sf: str) -> DataFrame:
    """Images of a band that no survey has are errors, not null tokens."""
    names = F.array(F.lit("des-g"), F.lit("r"), F.lit("des-z"), F.when(F.col("vec_id") % 11 == 0, F.lit("jwst-f200w")).otherwise(F.lit("des-i")))
    rows = table(spark, sf, "embeddings").select("vec_id", F.struct(names.alias("band"), _cube(F.col("embedding"), 4).alias("flux")).alias("image"))
    return Tokenizer([Spec(BLOCK, "image")], min_side=4).transform(rows, errors="column").select("vec_id", F.col(ERROR).isNotNull().alias("failed"), F.col("tok_block").isNotNull().alias("has_tokens"))


def drop_source(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return Tokenizer([Spec(TOTAL, "o_totalprice", "total", True)]).transform(rows)


def token_int32(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return Tokenizer([Spec(TOTAL, "o_totalprice")], number="int32").transform(rows)


def output_schema(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "orders").schema
    made = specs.output_schema(schema, [Spec(TOTAL, "o_totalprice", drop_source=True)])
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(made.fields)], "position int, name string, type string")


def partition_relpath(spark: SparkSession, sf: str) -> DataFrame:
    k = _keys(spark, sf).withColumn("pixel", F.col("pixel") * 97)
    return k.select("order", "pixel", layout.values(F.col("order"), F.col("pixel"))[1].alias("directory"), layout.file(F.col("order"), F.col("pixel")).alias("path"), layout.label(F.col("order"), F.col("pixel")).alias("label"))


def partition_parse(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("pixel") % 3 == 0, layout.file(F.col("order"), F.col("pixel"))).when(F.col("pixel") % 3 == 1, F.concat_ws("/", "order", "pixel")).otherwise(F.concat(F.lit("Npix="), "pixel"))
    k = _keys(spark, sf).withColumn("text", text)
    found = layout.parsed(F.col("text"))
    return k.select("text", found["order"].alias("order"), found["pixel"].alias("pixel"))


def partition_select(spark: SparkSession, sf: str) -> DataFrame:
    k = _keys(spark, sf)
    return selection.select(k, k.filter("pixel % 2 = 0"), first=50)


def partition_missing(spark: SparkSession, sf: str) -> DataFrame:
    k = _keys(spark, sf)
    return selection.missing(k.filter("pixel % 2 = 0"), k)


def shard_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, [selection.shard(_keys(spark, sf), r, 3).withColumn("rank", F.lit(r)) for r in range(3)])


def resume_todo(spark: SparkSession, sf: str) -> DataFrame:
    k = _keys(spark, sf)
    return selection.todo(k, k.filter("pixel % 3 = 0"))


def overwrite_todo(spark: SparkSession, sf: str) -> DataFrame:
    k = _keys(spark, sf)
    return selection.todo(k, k.filter("pixel % 3 = 0"), overwrite=True)


def take_rows_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return selection.take_rows(_counted(spark, sf), 10_000)


def row_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf).withColumn("place", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    grouped = selection.row_groups(rows, "place", 100, 64)
    return grouped.groupBy("order", "pixel", "row_group").agg(F.count(F.lit(1)).alias("rows"))


def finalize_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _counted(spark, sf).agg(F.count(F.lit(1)).alias("partitions"), F.sum("rows").alias("rows"), F.max("order").alias("max_order"))


def orders_present(spark: SparkSession, sf: str) -> DataFrame:
    return _keys(spark, sf).groupBy("order").agg(F.count(F.lit(1)).alias("partitions"))


def _status(spark: SparkSession, sf: str) -> DataFrame:
    """A run over vectors dealt to 20 partitions, of which two have images of an unknown band."""
    odd = F.when(F.col("vec_id").isin(45, 107), F.lit("mystery-q")).otherwise(F.lit("des-i"))
    names = F.array(F.lit("des-g"), F.lit("des-r"), F.lit("des-z"), odd)
    rows = table(spark, sf, "embeddings").select("vec_id", F.struct(names.alias("band"), _cube(F.col("embedding"), 4).alias("flux")).alias("image"))
    made = Tokenizer([Spec(BLOCK, "image")], min_side=4).transform(rows, errors="column")
    by = made.groupBy(F.lit(5).alias("order"), (F.col("vec_id") % 20).alias("pixel")).agg(F.count(F.lit(1)).alias("rows"), F.max(ERROR).alias("error"))
    return by.withColumn("state", F.when(F.col("pixel") % 4 == 0, "skipped").when(F.col("error").isNotNull(), "failed").otherwise("done"))


STATUS = "SELECT vec_id % 20 AS pixel, count(*) AS \"rows\", CASE WHEN vec_id % 20 % 4 = 0 THEN 'skipped' WHEN bool_or(vec_id IN (45, 107)) THEN 'failed' ELSE 'done' END AS state FROM embeddings GROUP BY 1"


def failed_partitions(spark: SparkSession, sf: str) -> DataFrame:
    return selection.by_state(_status(spark, sf), "failed").drop("error")


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return selection.summary(_status(spark, sf))


def join_back(spark: SparkSession, sf: str) -> DataFrame:
    tokens = vector_tokens(spark, sf)
    return tokens.join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("tok_vector").alias("tokens"))


def properties_parse(spark: SparkSession, sf: str) -> DataFrame:
    """The queries of URLs as properties lines."""
    text = F.concat(F.lit("#title\n"), F.translate(F.regexp_extract("url", r"\?([^#]*)", 1), "&", "\n"))
    return table(spark, sf, "pages").select("page_id", F.inline(properties.pairs(text)))


def _schema(spark: SparkSession, sf: str) -> T.StructType:
    image, spectrum = _images(spark, sf).schema["image"], _spectra(spark, sf).schema["spectrum"]
    return T.StructType([T.StructField("object_id", T.LongType()), image, spectrum, T.StructField("EBV", T.FloatType()), T.StructField("flux_g", T.DoubleType()), T.StructField("z_spec", T.FloatType())])


def detect_specs(spark: SparkSession, sf: str) -> DataFrame:
    found = specs.detect(_schema(spark, sf), "survey_desi_decals")
    return spark.createDataFrame([(s.column, s.modality.name, s.output, s.drops, s.modality.num_tokens) for s in found], "column string, modality string, token_column string, drops boolean, num_tokens int")


def _source(spark: SparkSession, sf: str, bad: bool = False) -> str:
    """A small catalog of vectors in four partitions; bad: with images, of an unknown band in the third."""
    rows = _spectra(spark, sf).withColumns({"ebv": F.lit(0.05), "_order": F.lit(5), "_pixel": F.col("vec_id") % 4, "_row": F.col("vec_id"), ERROR: F.lit(None).cast("string")})
    if bad:
        names = F.array(F.lit("des-g"), F.when(F.col("vec_id") % 4 == 2, "mystery-q").otherwise("des-r"))
        rows = rows.withColumn("image", F.struct(names.alias("band"), F.array_repeat(F.array_repeat(F.array_repeat(F.lit(0.5).cast("float"), 96), 96), 2).alias("flux")))
    url = f"{folder(spark)}/source_desi"
    sink.write_partitions(rows, url).collect()
    sink.finalize(url, spark=spark)
    return url


def _made(spark: SparkSession, sf: str):
    source = _source(spark, sf)
    summary = job.tokenize_catalog(spark, source, f"{source}-tokens")
    return summary, open_catalog(spark, f"{source}-tokens")


def _told(report: job.Report) -> DataFrame:
    return report.status.select("pixel", "state", "rows")


def first_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of the first rows of the first partition, and of another one."""
    catalog = open_catalog(spark, _source(spark, sf))
    return catalog.sample(8).select("vec_id").union(catalog.read_partition(catalog.partitions[2], ["vec_id"], most=3))


def limited_run(spark: SparkSession, sf: str) -> DataFrame:
    """A run of a row and a half partition, and the one after it, which leaves the shortened partition as it is."""
    source = _source(spark, sf)
    n = table(spark, sf, "embeddings").filter("vec_id % 4 = 0").count()
    runs = [job.tokenize_catalog(spark, source, f"{source}-tokens", "ebv", max_rows=m) for m in (n + n // 2, None)]
    return functools.reduce(DataFrame.union, [_told(r).withColumn("run", F.lit(i)) for i, r in enumerate(runs)])


def sharded_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Three shares of one catalog, each its own run."""
    source = _source(spark, sf)
    runs = [job.tokenize_catalog(spark, source, f"{source}-tokens", "ebv", rank=r, world_size=3) for r in range(3)]
    return functools.reduce(DataFrame.union, [_told(r).withColumn("rank", F.lit(i)) for i, r in enumerate(runs)])


def failed_run(spark: SparkSession, sf: str) -> DataFrame:
    """One partition's images are of an unknown band: it fails, the others are made."""
    source = _source(spark, sf, bad=True)
    return _told(job.tokenize_catalog(spark, source, f"{source}-tokens", ["image=LegacySurveyImage"], batch_size=16))


def damaged_run(spark: SparkSession, sf: str) -> DataFrame:
    """One partition's file is overwritten in its middle: it fails by the rows that can't be read, the others are made."""
    source = _source(spark, sf)
    catalog = open_catalog(spark, source)
    path = catalog.path(catalog.partitions[2])
    with catalog.fs.open_input_file(path) as f:
        held = f.read()
    with catalog.fs.open_output_stream(path) as f:
        f.write(held[:40] + bytes(1000) + held[1040:])
    return _told(job.tokenize_catalog(spark, catalog, f"{source}-tokens"))


def provenance(spark: SparkSession, sf: str) -> DataFrame:
    """What a run says of itself: columns, modalities and settings, also in the card."""
    _, made = _made(spark, sf)
    with made.fs.open_input_stream(f"{made.root}/{sink.PROVENANCE}") as f:
        told = json.loads(f.read())
    with made.fs.open_input_stream(f"{made.root}/{sink.CARD}") as f:
        card = f.read().decode()
    rows = [(m["column"], m["modality"], m["token_column"], m["drop_source"], m["token_column"] in card) for m in told["modalities"]]
    return spark.createDataFrame(rows, "column string, modality string, token_column string, drop_source boolean, in_card boolean").withColumn("token_dtype", F.lit(told["token_dtype"]))


def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """What a run counts on the way: rows, rows that can't be tokenized, nulls of each token column."""
    report = job.tokenize_catalog(spark, source := _source(spark, sf, bad=True), f"{source}-tokens", ["image=LegacySurveyImage", "spectrum=DESISpectrum"], batch_size=16)
    return spark.createDataFrame(sorted(report.metrics.items()), "name string, value long")


def positional_join(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a catalog beside their tokens, file by file; both sides say whose row it is."""
    source = _source(spark, sf)
    job.tokenize_catalog(spark, source, f"{source}-tokens", "spectrum")
    both = joined.beside(open_catalog(spark, source), open_catalog(spark, f"{source}-tokens"), ["vec_id", "spectrum"], ["tok_spectrum_desi"], check=["vec_id"])
    return both.select("vec_id", F.get("spectrum.flux", F.lit(0)).alias("flux"), F.get("tok_spectrum_desi.token", F.lit(0)).alias("token"), F.size("tok_spectrum_desi.token").alias("tokens"))


def token_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Use of codes by partition, from two parts of other rows that are merged."""
    made = Tokenizer([Spec(MANY, "spectrum")]).transform(_spectra(spark, sf)).withColumns({"_order": F.lit(5), "_pixel": F.col("vec_id") % 4})
    parts = [statistics.part(made.filter(F.col("vec_id") % 2 == i), ["tok_vector"], ("_order", "_pixel")) for i in (0, 1)]
    told = statistics.summary(statistics.merge(*parts), 4096)
    return told.select("pixel", "rows", "nulls", "tokens", "codes", F.round("entropy", 6).alias("entropy"), "top", "top_n", "used")


def catalog_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Counts kept beside a catalog that grows: half of its partitions, then all; each is counted once."""
    source, told = _source(spark, sf), []
    for most in (2, None):
        job.tokenize_catalog(spark, source, f"{source}-tokens", "spectrum", max_partitions=most, finalize=True)
        catalog = open_catalog(spark, f"{source}-tokens")
        told.append((len(catalog.partitions), bookkeeping.record(catalog, ["tok_spectrum_desi"])))
    out = bookkeeping.token_statistics(catalog, ["tok_spectrum_desi"]).select("rows", "nulls", "tokens", "codes", F.round("entropy", 6).alias("entropy"), "top", "top_n")
    return out.withColumn("counted", F.lit(",".join(f"{b} of {a}" for a, b in told)))


def _mixed_runs(spark: SparkSession, sf: str) -> str:
    """A catalog of tokens of three runs: two partitions, then the second anew with other settings, then the rest with one more column."""
    source = _source(spark, sf)
    parts = open_catalog(spark, source).partitions
    out = f"{source}-tokens"
    job.tokenize_catalog(spark, source, out, "ebv", partitions=parts[:2], finalize=False)
    job.tokenize_catalog(spark, source, out, "ebv", partitions=parts[1:2], overwrite=True, token_dtype="int32", finalize=False)
    job.tokenize_catalog(spark, source, out, ["ebv", "spectrum"], partitions=parts[2:], overwrite=True, finalize=False)
    return out


def partition_makers(spark: SparkSession, sf: str) -> DataFrame:
    """Which run made each partition's token columns, from what the runs wrote of themselves."""
    made = history.makers(spark, _mixed_runs(spark, sf))
    place = F.dense_rank().over(Window.orderBy("run"))
    return made.select("order", "pixel", place.alias("run"), "codec", "token_dtype", F.col("column").alias("source_column"), "modality", "token_column")


def maker_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Where the partitions of that catalog don't agree."""
    return history.conflicts(spark, _mixed_runs(spark, sf)).select("token_column", "what", "value", "partitions", "example.pixel")


def stream_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog's files as a stream, stopped after some of them and taken up again from its checkpoint."""
    url = _source(spark, sf)
    catalog = open_catalog(spark, url)
    tokenizer = Tokenizer(specs.resolve(catalog.schema, "ebv"))
    for most in (1, 64):
        query = tokens.tokenize_stream(catalog, tokenizer, f"{url}-stream", f"{url}-checkpoint", files_at_once=most, **({"once": True} if most == 1 else {"availableNow": True}))
        query.awaitTermination()
    return spark.read.parquet(f"{url}-stream").select("vec_id", "tok_ebv")


def normalize_source(spark: SparkSession, sf: str) -> DataFrame:
    """What the sources of the documents would name: datasets of a hub, stores, paths. There are a few hundred names at most."""
    names = [tuple(r) for r in table(spark, sf, "documents").select("source", "lang").distinct().collect()]
    forms = ("{0}/{1}", "{0}/{1}/x", "s3://{0}/{1}", "{0}", "{0}/{1} x")
    return spark.createDataFrame([(a, b, i, normalized(form.format(a, b))) for a, b in names for i, form in enumerate(forms)], "source string, lang string, form int, url string")


def spec_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of users as specs, on a table that has a number for each source of the documents: a pair, a modality whatever its case, what there is not."""
    sources = [r[0] for r in table(spark, sf, "documents").select("source").distinct().collect()]
    schema, rows = T.StructType([T.StructField(x, T.DoubleType()) for x in sources]), []
    for x in sources:
        for i, text in enumerate((f"{x} = legacysurveyebv", f"{x}=Z", x, f"{x}=Nope", f"{x} = desispectrum ")):
            try:
                spec = specs.parse(text, schema, "survey_desi_decals")
                rows.append((x, i, spec.modality.name, spec.output))
            except (ValueError, KeyError) as e:
                rows.append((x, i, None, type(e).__name__))
    return spark.createDataFrame(rows, "source string, form int, modality string, output string")


def end_to_end_catalog(spark: SparkSession, sf: str) -> DataFrame:
    _, made = _made(spark, sf)
    rows = made.read(keys=True)
    return rows.groupBy(F.col("_order").alias("order"), F.col("_pixel").alias("pixel")).agg(F.count(F.lit(1)).alias("rows"), F.sum("tok_ebv").alias("ebv_tokens"), F.sum(F.get("tok_spectrum_desi.token", F.lit(0))).alias("first_tokens"))


def finalize_files(spark: SparkSession, sf: str) -> DataFrame:
    summary, made = _made(spark, sf)
    told = {"partitions": len(made.partitions), "hats_nrows": int(made.properties["hats_nrows"]), "hats_order": int(made.properties["hats_order"]), "finalized": int(summary.finalized), "done": summary.counts["done"]}
    return spark.createDataFrame(sorted(told.items()), "name string, value long")


_CLEAN = "list_transform(embedding, lambda x: x::DOUBLE)"
_BASE = "(round_even(abs(list_sum({0})) * 1000, 0) % 4000)::BIGINT"
_VECTOR = _BASE.format(_CLEAN)
_SCALAR = "(round_even(abs({0}::FLOAT::DOUBLE) * 1000, 0) % 4000)::BIGINT"
_USES = """SELECT pixel, sum(k)::BIGINT AS tokens, count(*) AS codes, round(greatest(log2(sum(k)) - sum(k * log2(k)) / sum(k), 0), 6) AS entropy, arg_min(code, -k * 100000 + code) AS top, max(k) AS top_n
  FROM (SELECT pixel, code, count(*) AS k FROM ({0}) GROUP BY 1, 2) GROUP BY 1"""
_FIRST = f"CASE WHEN vec_id % 7 <> 0 AND vec_id % 5 <> 0 THEN {_VECTOR} END"
_LINES = "SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: len(string_split(x, ' '))) AS s FROM documents"
_PARTS = "SELECT vec_id % 4 AS pixel, count(*) AS n FROM embeddings GROUP BY 1"
_ODD = "SELECT event_id, CASE event_id % 10 WHEN 1 THEN 'nan'::DOUBLE WHEN 3 THEN 1e300 WHEN 5 THEN '-inf'::DOUBLE WHEN 7 THEN NULL ELSE value END AS value FROM events"
_OK = "isfinite(try_cast(value AS FLOAT))"

QUERIES = {
    f.__name__: f
    for f in (
        scalar_tokens, scalar_invalid_null, vector_tokens, vector_tokens_batches, token_explode, token_struct, image_tokens, image_min_size, label_count_null,
        nan_to_num, nested_shape, ragged_flag, shape_groups, spectrum_mask, band_normalize, unknown_band_error, drop_source, token_int32, output_schema,
        partition_relpath, partition_parse, partition_select, partition_missing, shard_round_robin, resume_todo, overwrite_todo, take_rows_prefix, row_groups,
        finalize_summary, orders_present, failed_partitions, run_summary, join_back, properties_parse, detect_specs, end_to_end_catalog, finalize_files,
        first_rows, limited_run, sharded_runs, failed_run, damaged_run, run_metrics, positional_join, token_statistics, catalog_statistics, partition_makers, maker_conflicts, provenance, stream_tokens, normalize_source, spec_texts,
    )
}

ORACLE_SQL = {
    "scalar_tokens": f"SELECT l_orderkey, l_linenumber, {_SCALAR.format('l_extendedprice')} AS tok_price FROM lineitem",
    "scalar_invalid_null": f"SELECT event_id, CASE WHEN coalesce({_OK}, FALSE) THEN (round_even(abs(try_cast(value AS FLOAT)::DOUBLE) * 1000, 0) % 4000)::BIGINT END AS tok_value FROM ({_ODD})",
    "vector_tokens": f"SELECT vec_id, {_VECTOR} AS tok_vector FROM embeddings",
    "vector_tokens_batches": f"SELECT vec_id, {_VECTOR} AS tok_vector FROM embeddings",
    "token_explode": f"SELECT vec_id, i::INT AS pos, ({_VECTOR} + i) % 4096 AS token FROM embeddings, generate_series(0, 15) g(i)",
    "token_struct": f"SELECT vec_id, b IS NULL AS is_null, CASE WHEN b IS NOT NULL THEN array_to_string([(b + i) % 4096 FOR i IN range(8)], ',') END AS tokens FROM (SELECT vec_id, {_FIRST} AS b FROM embeddings)",
    "image_tokens": f"SELECT vec_id, b % 4096 AS first, CASE WHEN b IS NOT NULL THEN 8 END::BIGINT AS n FROM (SELECT vec_id, {_FIRST} AS b FROM embeddings)",
    "image_min_size": "SELECT vec_id, vec_id % 3 = 0 AS has_tokens FROM embeddings",
    "label_count_null": "SELECT vec_id % 5 AS r, count(*) FILTER (vec_id % 7 <> 0 AND vec_id % 5 <> 0) AS with_tokens, count(*) AS n FROM embeddings GROUP BY 1",
    "nan_to_num": f"SELECT event_id, CASE WHEN coalesce({_OK}, FALSE) THEN try_cast(value AS FLOAT)::DOUBLE ELSE 0 END AS v0, 2.5::DOUBLE AS v1, 0::DOUBLE AS v2 FROM ({_ODD})",
    "nested_shape": f"SELECT doc_id, len(s) AS d0, list_max(s) AS d1 FROM ({_LINES})",
    "ragged_flag": f"SELECT doc_id, list_min(s) = list_max(s) AND list_min(s) > 0 AS regular FROM ({_LINES})",
    "shape_groups": f"SELECT len(s) AS d0, list_max(s) AS d1, count(*) AS n FROM ({_LINES}) WHERE list_min(s) = list_max(s) AND list_min(s) > 0 GROUP BY 1, 2",
    "spectrum_mask": "SELECT vec_id, len(list_filter(embedding, lambda x: NOT isfinite(x) OR x <= 0)) AS masked FROM embeddings",
    "band_normalize": "SELECT event_id, CASE WHEN contains(b, '-') THEN b ELSE 'DES-' || b END AS band FROM (SELECT event_id, replace(upper(event_type), '_', '-') AS b FROM events)",
    "unknown_band_error": "SELECT vec_id, vec_id % 11 = 0 AS failed, vec_id % 11 <> 0 AS has_tokens FROM embeddings",
    "drop_source": f"SELECT o_orderkey, o_orderpriority, {_SCALAR.format('o_totalprice')} AS total FROM orders",
    "token_int32": f"SELECT o_orderkey, o_totalprice, {_SCALAR.format('o_totalprice')}::INT AS tok_total FROM orders",
    "output_schema": "SELECT * FROM (VALUES (0, 'o_orderkey', 'bigint'), (1, 'o_custkey', 'bigint'), (2, 'o_orderstatus', 'string'), (3, 'o_orderdate', 'timestamp_ntz'), (4, 'o_orderpriority', 'string'), (5, 'tok_total', 'bigint')) t(position, name, type)",
    "partition_relpath": f"SELECT \"order\", pixel, pixel // 10000 * 10000 AS directory, 'Norder=' || \"order\" || '/Dir=' || (pixel // 10000 * 10000) || '/Npix=' || pixel || '.parquet' AS path, 'Norder=' || \"order\" || '/Npix=' || pixel AS label FROM (SELECT \"order\", pixel * 97 AS pixel FROM ({KEYS}))",
    "partition_parse": f"SELECT CASE pixel % 3 WHEN 0 THEN 'Norder=' || \"order\" || '/Dir=' || (pixel // 10000 * 10000) || '/Npix=' || pixel || '.parquet' WHEN 1 THEN \"order\" || '/' || pixel ELSE 'Npix=' || pixel END AS text, CASE WHEN pixel % 3 < 2 THEN \"order\" END AS \"order\", CASE WHEN pixel % 3 < 2 THEN pixel END AS pixel FROM ({KEYS})",
    "partition_select": f"SELECT * FROM ({KEYS}) WHERE pixel % 2 = 0 ORDER BY 1, 2 LIMIT 50",
    "partition_missing": f"SELECT * FROM ({KEYS}) EXCEPT SELECT * FROM ({KEYS}) WHERE pixel % 2 = 0",
    "shard_round_robin": f"SELECT *, ((row_number() OVER (ORDER BY \"order\", pixel) - 1) % 3)::INT AS rank FROM ({KEYS})",
    "resume_todo": f"SELECT * FROM ({KEYS}) k ANTI JOIN (SELECT * FROM ({KEYS}) WHERE pixel % 3 = 0) d USING (\"order\", pixel)",
    "overwrite_todo": KEYS,
    "take_rows_prefix": f"SELECT \"order\", pixel, \"rows\", least(\"rows\", 10000 - before)::BIGINT AS take FROM (SELECT *, coalesce(sum(\"rows\") OVER (ORDER BY \"order\", pixel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT \"order\", pixel, count(*) AS \"rows\" FROM ({ROWS}) GROUP BY 1, 2)) WHERE before < 10000",
    "row_groups": f"SELECT \"order\", pixel, g AS row_group, count(*) AS \"rows\" FROM (SELECT *, (row_number() OVER (PARTITION BY \"order\", pixel ORDER BY l_orderkey, l_linenumber) - 1) // 128 AS g FROM ({ROWS})) GROUP BY 1, 2, 3",
    "finalize_summary": f"SELECT count(DISTINCT (\"order\", pixel)) AS partitions, count(*) AS \"rows\", max(\"order\") AS max_order FROM ({ROWS})",
    "orders_present": f"SELECT \"order\", count(*) AS partitions FROM ({KEYS}) GROUP BY 1",
    "failed_partitions": f"SELECT 'Norder=5/Npix=' || pixel AS label, \"rows\" FROM ({STATUS}) WHERE state = 'failed'",
    "run_summary": f"SELECT count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'skipped') AS skipped, count(*) FILTER (state = 'failed') AS failed, coalesce(sum(\"rows\") FILTER (state = 'done'), 0)::BIGINT AS \"rows\" FROM ({STATUS})",
    "join_back": f"SELECT label, count(*) AS n, sum({_VECTOR})::BIGINT AS tokens FROM embeddings GROUP BY 1",
    "properties_parse": "SELECT page_id, trim(split_part(p, '=', 1)) AS key, trim(regexp_replace(p, '^[^=]*=', '')) AS value FROM (SELECT page_id, unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) AS p FROM pages) WHERE contains(p, '=')",
    "detect_specs": "SELECT * FROM (VALUES ('image', 'LegacySurveyImage', 'tok_image', TRUE, 576), ('spectrum', 'DESISpectrum', 'tok_spectrum_desi', TRUE, 273), ('EBV', 'LegacySurveyEBV', 'tok_ebv', FALSE, 1), ('flux_g', 'LegacySurveyFluxG', 'tok_flux_g', FALSE, 1)) t(\"column\", modality, token_column, drops, num_tokens)",
    "end_to_end_catalog": f"SELECT 5 AS \"order\", vec_id % 4 AS pixel, count(*) AS \"rows\", sum(50)::BIGINT AS ebv_tokens, sum({_VECTOR} % 4096)::BIGINT AS first_tokens FROM embeddings GROUP BY 2",
    "finalize_files": "SELECT name, value::BIGINT AS value FROM (SELECT 'partitions' AS name, count(DISTINCT vec_id % 4) AS value FROM embeddings UNION ALL SELECT 'hats_nrows', count(*) FROM embeddings UNION ALL SELECT 'hats_order', 5 UNION ALL SELECT 'finalized', 1 UNION ALL SELECT 'done', count(DISTINCT vec_id % 4) FROM embeddings)",
    "first_rows": "SELECT * FROM (SELECT vec_id FROM embeddings WHERE vec_id % 4 = 0 ORDER BY 1 LIMIT 8) UNION ALL SELECT * FROM (SELECT vec_id FROM embeddings WHERE vec_id % 4 = 2 ORDER BY 1 LIMIT 3)",
    "limited_run": f"WITH p AS ({_PARTS}), n AS (SELECT n + n // 2 AS most FROM p WHERE pixel = 0), t AS (SELECT pixel, n, least(n, greatest(most - coalesce(sum(n) OVER (ORDER BY pixel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0))::BIGINT AS take FROM p, n) SELECT pixel, 'done' AS state, take AS \"rows\", 0 AS run FROM t WHERE take > 0 UNION ALL SELECT pixel, CASE WHEN take > 0 THEN 'skipped' ELSE 'done' END, CASE WHEN take > 0 THEN 0 ELSE n END, 1 FROM t",
    "sharded_runs": f"SELECT pixel, 'done' AS state, n AS \"rows\", (pixel % 3)::INT AS rank FROM ({_PARTS})",
    "failed_run": f"SELECT pixel, CASE pixel WHEN 2 THEN 'failed' ELSE 'done' END AS state, CASE pixel WHEN 2 THEN 0 ELSE n END AS \"rows\" FROM ({_PARTS})",
    "damaged_run": f"SELECT pixel, CASE pixel WHEN 2 THEN 'failed' ELSE 'done' END AS state, CASE pixel WHEN 2 THEN 0 ELSE n END AS \"rows\" FROM ({_PARTS})",
    "run_metrics": "SELECT unnest(['rows', 'errors', 'nulls of tok_image', 'nulls of tok_spectrum_desi']) AS name, unnest([count(*), count(*) FILTER (vec_id % 4 = 2), count(*) FILTER (vec_id % 4 = 2), 0]) AS value FROM embeddings",
    "positional_join": f"SELECT vec_id, embedding[1] AS flux, {_VECTOR} % 4096 AS token, 273 AS tokens FROM embeddings",
    "token_statistics": f"SELECT pixel, n AS \"rows\", 0::BIGINT AS nulls, tokens, codes, entropy, top, top_n, codes / 4096 AS used FROM ({_USES.format(f'SELECT vec_id % 4 AS pixel, ({_VECTOR} + i) % 4096 AS code FROM embeddings, generate_series(0, 15) g(i)')}) JOIN ({_PARTS}) USING (pixel)",
    "catalog_statistics": f"SELECT (SELECT count(*) FROM embeddings) AS \"rows\", 0::BIGINT AS nulls, tokens, codes, entropy, top, top_n, '2 of 2,2 of 4' AS counted FROM ({_USES.format(f'SELECT 0 AS pixel, ({_VECTOR} + i) % 4096 AS code FROM embeddings, generate_series(0, 272) g(i)')})",
    "partition_makers": f"SELECT 5 AS \"order\", pixel, least(pixel + 1, 3)::INT AS run, 'HashQuantizer' AS codec, CASE pixel WHEN 1 THEN 'int32' ELSE 'int64' END AS token_dtype, c.* FROM ({_PARTS}), (VALUES ('ebv', 'LegacySurveyEBV', 'tok_ebv'), ('spectrum', 'DESISpectrum', 'tok_spectrum_desi')) c(source_column, modality, token_column) WHERE source_column = 'ebv' OR pixel >= 2",
    "maker_conflicts": f"SELECT * FROM (SELECT 'tok_ebv' AS token_column, 'token_dtype' AS what, CASE pixel WHEN 1 THEN 'int32' ELSE 'int64' END AS value, count(*) AS partitions, min(pixel) AS pixel FROM ({_PARTS}) GROUP BY 3) UNION ALL SELECT 'tok_spectrum_desi', 'present', 'yes', count(*), min(pixel) FROM ({_PARTS}) WHERE pixel >= 2",
    "provenance": "SELECT *, 'int64' AS token_dtype FROM (VALUES ('spectrum', 'DESISpectrum', 'tok_spectrum_desi', TRUE, TRUE), ('ebv', 'LegacySurveyEBV', 'tok_ebv', FALSE, TRUE)) t(\"column\", modality, token_column, drop_source, in_card)",
    "stream_tokens": "SELECT vec_id, 50::BIGINT AS tok_ebv FROM embeddings",
    "normalize_source": "SELECT source, lang, form, CASE form WHEN 0 THEN 'hf://datasets/' || source || '/' || lang WHEN 1 THEN source || '/' || lang || '/x' WHEN 2 THEN 's3://' || source || '/' || lang WHEN 3 THEN source ELSE source || '/' || lang || ' x' END AS url FROM (SELECT DISTINCT source, lang FROM documents), (SELECT unnest(range(5))::INT AS form)",
    "spec_texts": "SELECT source, form, CASE form WHEN 0 THEN 'LegacySurveyEBV' WHEN 1 THEN 'Z' WHEN 4 THEN 'DESISpectrum' END AS modality, CASE form WHEN 0 THEN 'tok_ebv' WHEN 1 THEN 'tok_z' WHEN 2 THEN 'ValueError' WHEN 3 THEN 'KeyError' ELSE 'tok_spectrum_desi' END AS output FROM (SELECT DISTINCT source FROM documents), (SELECT unnest(range(5))::INT AS form)",
}

QUERIES |= sky_queries.QUERIES | sql_queries.QUERIES | stream_queries.QUERIES
ORACLE_SQL |= sky_queries.ORACLE_SQL | sql_queries.ORACLE_SQL | stream_queries.ORACLE_SQL
