"""Which partitions and rows a run takes: DataFrames with columns order and pixel.

The list of partitions is a catalog's index (a row for each file), not its data: what is ordered as a
whole here is that list alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import layout

KEY = ["order", "pixel"]


def select(partitions: DataFrame, wanted: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """The wanted partitions, of these the first in order."""
    out = partitions if wanted is None else partitions.join(wanted.select(*KEY).distinct(), KEY, "left_semi")
    return out if first is None else out.orderBy(*KEY).limit(first)


def missing(partitions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted partitions that there are not."""
    return wanted.select(*KEY).distinct().join(partitions, KEY, "left_anti")


def shard(partitions: DataFrame, rank: int, of: int) -> DataFrame:
    """Every of-th partition in order from rank on."""
    if not 0 <= rank < of:
        raise ValueError(f"rank {rank} is outside 0 to {of - 1}")
    place = F.row_number().over(Window.orderBy(*KEY)) - 1
    return partitions.withColumn("_place", place).filter(F.col("_place") % of == rank).drop("_place")


def todo(partitions: DataFrame, done: DataFrame, overwrite: bool = False) -> DataFrame:
    """Partitions still to be made."""
    return partitions if overwrite else partitions.join(done.select(*KEY).distinct(), KEY, "left_anti")


def take_rows(counted: DataFrame, most: int | None) -> DataFrame:
    """counted (order, pixel, rows) with `take`: an exact prefix of `most` rows in order of partitions.

    A partition after the last row is left out; None takes all.
    """
    if most is None:
        return counted.withColumn("take", F.col("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy(*KEY).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.withColumn("_before", before).filter(F.col("_before") < most).withColumn("take", F.least(F.col("rows"), most - F.col("_before")).cast("long")).drop("_before")


def summary(status: DataFrame) -> DataFrame:
    """Counts of a run's status (order, pixel, state, rows)."""
    of = lambda s: F.count(F.when(F.col("state") == s, 1))
    return status.agg(of("done").alias("done"), of("skipped").alias("skipped"), of("failed").alias("failed"), F.coalesce(F.sum(F.when(F.col("state") == "done", F.col("rows"))), F.lit(0)).cast("long").alias("rows"))


def by_state(status: DataFrame, state: str) -> DataFrame:
    """(label, rows, error) of a run's partitions of one state, in order."""
    return status.filter(F.col("state") == state).orderBy(*KEY).select(layout.label(F.col("order"), F.col("pixel")).alias("label"), "rows", "error")


def row_groups(rows: DataFrame, by: str, size: int, batch: int) -> DataFrame:
    """rows (order, pixel, ...) with the row group of each in its partition's file, rows ordered by `by`.

    Groups close at the first whole batch with at least `size` rows.
    """
    whole = -(-size // batch) * batch
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(by)) - 1
    return rows.withColumn("row_group", F.floor(place / whole).cast("long"))
