"""Catalogs of any table with positions: tiles of even size, keys, sky map."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import sphere
from tessera.functions.layout import Partition
from tessera.operators import sky
from tessera.sources import datasource, sink
from tessera.sources.catalog import Catalog, filesystem, open_catalog

MAP = "skymap.parquet"


def build_catalog(df: DataFrame, output: str | os.PathLike, at: Sequence[str], most: int = 1_000_000, deepest: int = 10, row_group_size: int = 1024, key: str = sphere.KEY) -> Catalog:
    """df as a catalog: files of at most `most` rows (more only in pixels of the deepest order), sorted by the key.

    at: columns of the position, in any length. Each row gets the pixel of order 29 as its key and stands in the smallest
    order of tile that is not too full: crowded places have small tiles. The sky map (rows by pixel of the deepest order) is
    counted first, as it tells the tiles, and stands beside the data. Rows without a position are a ValueError, as they belong
    to no tile; so is a table without rows, and an output that has partitions already. The files appear with the commit of the write, or
    not at all. The list of tiles, a row for each file as in the catalog's index, goes to the tasks; rows are shuffled once.
    """
    spark, output = df.sparkSession, os.fspath(output)
    if not 0 <= deepest <= 12:
        raise ValueError(f"tiles of order {deepest}; a sky map has up to order 12")
    datasource.register(spark)
    rows = sky.keyed(df, at, key)
    fs, root = filesystem(output)
    fs.create_dir(root, recursive=True)
    where = f"file://{root}/{MAP}" if "://" not in output else f"{output.rstrip('/')}/{MAP}"
    sky.density(rows, deepest, key).write.mode("overwrite").parquet(where)
    counts = spark.read.parquet(where)
    if lost := counts.filter("pixel is null").select("rows").first():
        raise ValueError(f"{lost[0]} rows have no position")
    found = [Partition(r["order"], r["pixel"]) for r in sky.tiles(counts, deepest, most).select("order", "pixel").toLocalIterator()]
    if not found:
        raise ValueError("there are no rows")
    order, pixel = sky.tile_of(F.col(key), found)
    dealt = datasource.clustered(rows.withColumns({datasource.ORDER: order, datasource.PIXEL: pixel}), key)
    dealt.write.format(datasource.NAME).mode("append").option("path", output).option("row_group_size", row_group_size).option("key", key).save()
    sink.add_properties(output, {"hats_skymap_order": deepest, "hats_max_rows": most, "hats_col_healpix": key})
    return open_catalog(spark, output)


def sky_map(catalog: Catalog) -> DataFrame:
    """(pixel, rows) of a catalog that build_catalog() made, at the order in its properties."""
    return catalog.spark.read.parquet(f"{catalog.uri(catalog.partitions[0]).rsplit('/dataset/', 1)[0]}/{MAP}")
