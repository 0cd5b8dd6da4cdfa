"""What the runs that made a catalog tell of themselves, as rows: which partitions were made by which codec, modalities and settings."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.catalog import filesystem

#: Folder of a file for each run, beside the data.
RUNS = "runs"


def runs(spark: SparkSession, url: str) -> DataFrame:
    """(run, created, codec, token_dtype, source, told) of every run of a catalog, in the order of their names; told is all that the run wrote, as a variant.

    A file that isn't JSON is a run with nothing told. A catalog without such files has no runs.
    """
    fs, root = filesystem(url)
    kind = "run string, text string"
    if fs.get_file_info(f"{root}/{RUNS}").type != pafs.FileType.Directory:
        files = spark.createDataFrame([], kind)
    else:
        at = f"file://{root}/{RUNS}" if "://" not in url else f"{url.rstrip('/')}/{RUNS}"
        files = spark.read.option("wholetext", "true").text(f"{at}/*.json").select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("run"), F.col("value").alias("text"))
    told = files.withColumn("told", F.try_parse_json("text"))
    of = lambda path: F.try_variant_get("told", f"$.{path}", "string").alias(path)
    return told.select("run", of("created"), of("codec"), of("token_dtype"), of("source"), "told")


def makers(spark: SparkSession, url: str) -> DataFrame:
    """(order, pixel, run, codec, token_dtype, column, modality, token_column) of each partition and token column: the last run that made the partition's file."""
    made = runs(spark, url)
    listed = F.variant_get("told", "$.done", "array<struct<order:int,pixel:bigint>>")
    columns = F.variant_get("told", "$.modalities", "array<struct<column:string,modality:string,token_column:string>>")
    each = made.filter("told is not null").select("run", "codec", "token_dtype", columns.alias("modalities"), F.explode(listed).alias("p"))
    last = F.row_number().over(Window.partitionBy("p.order", "p.pixel").orderBy(F.col("run").desc()))
    newest = each.withColumn("_age", last).filter("_age = 1").withColumn("m", F.explode("modalities"))
    return newest.select("p.order", "p.pixel", "run", "codec", "token_dtype", "m.column", "m.modality", "m.token_column")


def conflicts(spark: SparkSession, url: str) -> DataFrame:
    """(token_column, what, value, partitions, example): where partitions of one catalog differ in what made a column.

    what is codec, token_dtype, column or modality; also a column that only some partitions have (what 'present', value of those that have it).
    No rows: all partitions are of one make.
    """
    found = makers(spark, url)
    facts = F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("value")) for c in ("codec", "token_dtype", "column", "modality")])).alias("f")
    by = found.select("token_column", "order", "pixel", facts).groupBy("token_column", "f.what", "f.value").agg(F.count(F.lit(1)).alias("partitions"), F.min(F.struct("order", "pixel")).alias("example"))
    several = by.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("token_column", "what"))).filter("_n > 1").drop("_n")
    all_ = found.select("order", "pixel").distinct().agg(F.count(F.lit(1)).alias("_all"))
    some = found.groupBy("token_column").agg(F.count(F.lit(1)).alias("partitions"), F.min(F.struct("order", "pixel")).alias("example"))
    # One row beside each column of the catalog: the number of all partitions.
    partly = some.join(F.broadcast(all_), F.col("partitions") < F.col("_all")).select("token_column", F.lit("present").alias("what"), F.lit("yes").alias("value"), "partitions", "example")
    return several.unionByName(partly)
