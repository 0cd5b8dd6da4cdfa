"""Statistics of a catalog's tokens, kept beside it partition by partition as the catalog grows."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.layout import DATASET, Partition
from tessera.operators import statistics
from tessera.sources.catalog import Catalog

FOLDER = "statistics.parquet"


def stamps(catalog: Catalog) -> dict[Partition, str]:
    """What tells whether a partition's file is still the one that was counted: its size and time."""
    files = catalog.fs.get_file_info([catalog.path(p) for p in catalog.partitions])
    return {p: f"{f.size}-{f.mtime_ns}" for p, f in zip(catalog.partitions, files, strict=True) if f.type == pafs.FileType.File}


def _at(catalog: Catalog) -> str:
    return catalog.uri(catalog.partitions[0]).rsplit(f"/{DATASET}/", 1)[0] + f"/{FOLDER}"


def known(catalog: Catalog) -> DataFrame:
    """The counts that are stored of the partitions' files as they are now."""
    spark = catalog.spark
    now = spark.createDataFrame([(*p, s) for p, s in stamps(catalog).items()], "order int, pixel long, stamp string")
    stored = f"{catalog.root}/{FOLDER}"
    if catalog.fs.get_file_info(stored).type != pafs.FileType.Directory:
        return spark.createDataFrame([], f"{statistics.SCHEMA}, stamp string")
    return spark.read.schema(f"{statistics.SCHEMA}, stamp string").parquet(_at(catalog)).join(now, ["order", "pixel", "stamp"], "left_semi")


def record(catalog: Catalog, columns: Sequence[str]) -> int:
    """Count the codes of partitions whose counts are not stored yet or are of another file, and store them; how many these were.

    Only the files of these partitions and only the token columns are read. Counts of a run that failed were not
    committed; those of files that have been replaced since stay but no longer count.
    """
    have = known(catalog).select("order", "pixel").distinct()
    now = stamps(catalog)
    index = catalog.spark.createDataFrame([(*p, s) for p, s in now.items()], "order int, pixel long, stamp string")
    left = [Partition(r["order"], r["pixel"]) for r in index.join(have, ["order", "pixel"], "left_anti").select("order", "pixel").collect()]
    if left:
        counts = statistics.part(catalog.read(left, columns, keys=True), columns, ("_order", "_pixel"))
        counts.join(index, ["order", "pixel"]).select("order", "pixel", "column", "what", "code", "n", "stamp").write.mode("append").parquet(_at(catalog))
    return len(left)


def token_statistics(catalog: Catalog, columns: Sequence[str], codebook: int | None = None, by_partition: bool = False) -> DataFrame:
    """statistics.summary() of a catalog's token columns, of all of it or by partition; what isn't counted yet is counted first."""
    record(catalog, columns)
    counts = known(catalog).filter(F.col("column").isin(list(columns))).drop("stamp")
    return statistics.summary(counts if by_partition else statistics.whole(counts), codebook)
