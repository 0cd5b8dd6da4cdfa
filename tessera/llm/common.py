"""Shared plumbing: tables, written intermediates, Arrow batch size, distributed ranks."""

from __future__ import annotations

import atexit
import ctypes
import gc
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of every contract: runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows and bytes of one Arrow batch handed to Python, so that long texts stay bounded.
ARROW_ROWS, ARROW_BYTES = 500, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, where they aren't smaller already; both settings are read when a query runs."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(name).removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


_OWN: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Only a local Spark has one of its own where that is unset; a cluster is an error."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tessera-")
    return _OWN[app]


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete written intermediates that no later result reads."""
    for df in frames:
        _delete(df.sparkSession, df._tessera_path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # noqa: BLE001  the session has ended, and its folder with it
        return


def letting_go(batches: Iterable[pa.RecordBatch], forget: Callable[[], None] = lambda: None) -> Iterator[pa.RecordBatch]:
    """The batches; at a task's end its caches are forgotten and memory goes back to the system.

    Spark keeps Python workers for later tasks, beside those of other operators.
    """
    try:
        yield from batches
    finally:
        forget()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of df's, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        pick = next(x for x in itertools.chain([name], (f"{name}_{i}" for i in itertools.count(1))) if x.lower() not in taken)
        taken.add(pick.lower())
        out.append(pick)
    return out


def unit(*cols: Column, seed: int) -> Column:
    """A seeded uniform number in [0, 1) from the columns' values."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") / F.lit(float(1 << 53))


#: Equal rows that numbered() counts off in one step.
CHUNK = 10_000


def numbered(rows: DataFrame, number: str) -> DataFrame:
    """rows with a number from 0 that tells equal ones apart, the same on every run.

    Equal rows are counted before they are dealt, then counted off in chunks, so any number of them is
    spread over the tasks.
    """
    n, chunk = fresh(rows, "_n", "_chunk")
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias(n))
    zero = F.lit(0).cast("long")
    dealt = counted.withColumn(chunk, F.explode(F.sequence(zero, F.floor((F.col(n) - 1) / CHUNK).cast("long")))).repartition(*rows.columns, chunk)
    ends = F.least(F.col(chunk) * CHUNK + CHUNK, F.col(n)) - 1
    return dealt.withColumn(number, F.explode(F.sequence(F.col(chunk) * CHUNK, ends))).drop(n, chunk)


#: Rows of one bucket of ranked() in groups of up to its square; the square root of the group beyond.
RANK_ROWS = 400


def ranked(df: DataFrame, keys: list[str], size: str, by: str, ties: list[str], rank: str) -> DataFrame:
    """Gapless rank from 0 of each row in its group by (by, ties), without a group in one task.

    keys: the group; size: column with the group's row count; by: column uniform in [0, 1), so rows that
    are alike are told apart before (numbered()).
    A group is cut by value of `by` into buckets, as many as rows in a bucket where it is large; a
    bucket's first rank is the running count of the buckets before it, and a row's rank inside is
    its row_number.
    """
    (b,) = fresh(df, "_bucket")
    cut = df.withColumn(b, F.floor(F.col(by) * F.ceil(F.col(size) / F.greatest(F.lit(float(RANK_ROWS)), F.sqrt(size)))).cast("long"))
    # Dealt anew by bucket: rows that come dealt by group would otherwise be ranked where they are, a hot group in one task.
    cut = cut.repartition(*keys, b)
    counts = cut.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(b).alias("_kb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = cut.withColumn(rank, F.row_number().over(Window.partitionBy(*keys, b).orderBy(by, *ties)) - 1)
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col(b) == F.col("_kb")]
    joined = inside.join(counts, on)
    return joined.withColumn(rank, (F.col(rank) + F.col("_first")).cast("long")).drop(b, "_kb", "_first", *[f"_k{i}" for i in range(len(keys))])


def extended(schema: T.StructType, *fields: tuple[str, str]) -> T.StructType:
    """A copy of the schema with further nullable columns (name, simple type)."""
    kinds = {"string": T.StringType(), "binary": T.BinaryType(), "long": T.LongType(), "double": T.DoubleType()}
    return T.StructType([*schema.fields, *(T.StructField(n, kinds[t]) for n, t in fields)])
