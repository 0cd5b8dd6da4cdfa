"""Catalogs: a folder of properties, a list of partitions, and a parquet file for each partition."""

from __future__ import annotations

import csv
import functools
import io
import os
import re
from collections.abc import Iterator, Sequence
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from tessera.functions import properties
from tessera.functions.layout import DATASET, PATH, Partition, named
from tessera.plans.specs import IMAGE_FIELDS, alias

#: File names of the catalog format.
PROPERTIES, COLLECTION, PRIMARY, INDEX = "hats.properties", "collection.properties", "hats_primary_table_url", "partition_info.csv"


#: Stores that must be opened by other libraries, not by Spark.
FOREIGN = "hf"


def normalized(source: str | os.PathLike) -> str:
    """A source as a URL or path. Two words with a slash name a dataset of a hub, unless there is such a path."""
    source = os.fspath(source)
    words = source.split("/")
    of_hub = len(words) == 2 and all(w and not re.search(r"[^\w.-]", w) for w in words)
    return f"{FOREIGN}://datasets/{source}" if of_hub and not os.path.exists(source) else source


def filesystem(url: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URL or local path."""
    if url.startswith(f"{FOREIGN}://"):
        raise ValueError(f"{url} is a hub's; copy it to a path or store that Spark and Arrow open")
    if "://" in url:
        return pafs.FileSystem.from_uri(url)
    return pafs.LocalFileSystem(), os.path.abspath(url)


def listed(url: str) -> dict[Partition, int]:
    """Size of each partition file below a catalog's folder, in order, from one listing."""
    fs, root = filesystem(url)
    files = fs.get_file_info(pafs.FileSelector(f"{root}/{DATASET}", recursive=True, allow_not_found=True))
    return dict(sorted((named(f.path), f.size) for f in files if f.type == pafs.FileType.File and re.search(PATH, f.path)))


def indexed(url: str) -> list[Partition]:
    """A catalog's partitions in order, from its index file if there is one, else from the files' names."""
    fs, root = filesystem(url)
    if fs.get_file_info(f"{root}/{INDEX}").type == pafs.FileType.File:
        with fs.open_input_stream(f"{root}/{INDEX}") as f:
            found = [Partition(int(r["Norder"]), int(r["Npix"])) for r in csv.DictReader(io.StringIO(f.read().decode()))]
    else:
        found = list(listed(url))
    if not found:
        raise FileNotFoundError(f"{url} has no partitions")
    return sorted(found)


def keys(spark: SparkSession, partitions: Sequence[Partition]) -> DataFrame:
    """(order, pixel) of the partitions."""
    return spark.createDataFrame([tuple(p) for p in partitions], "order int, pixel long")


FOOTER = "order int, pixel bigint, rows bigint, footer binary, error string"


def footers(url: str, partitions: DataFrame, whole: bool = False) -> DataFrame:
    """partitions (order, pixel) with what their files' footers say, read by tasks; whole: with the footer itself, by its path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(url)
        for b in batches:
            found: list[tuple] = []
            for p in map(Partition, b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    with fs.open_input_file(f"{root}/{DATASET}/{p.file}") as f:
                        footer = pq.read_metadata(f)
                    kept = pa.BufferOutputStream()
                    if whole:
                        footer.set_file_path(p.file)
                        footer.write_metadata_file(kept)
                    found.append((footer.num_rows, kept.getvalue().to_pybytes() if whole else None, None))
                except Exception as e:  # noqa: BLE001  an unreadable file is that partition's failure
                    found.append((0, None, f"{type(e).__name__}: {e}"))
            told = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.binary(), pa.string()), strict=True)]
            if told:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *told], ["order", "pixel", "rows", "footer", "error"])

    return partitions.select("order", "pixel").mapInArrow(run, FOOTER)


def faults(url: str, partitions: DataFrame, schema: pa.Schema) -> DataFrame:
    """(order, pixel, error) of partitions (order, pixel): why a file can't be read as the schema, null where it can; read by tasks."""

    def why(path: str, fs: pafs.FileSystem) -> str | None:
        try:
            with pq.ParquetFile(fs.open_input_file(path)) as f:
                if lacking := [c for c in schema.names if c not in f.schema_arrow.names]:
                    return f"no column {', '.join(lacking)}"
                if other := [f"{c} is {f.schema_arrow.field(c).type}, not {schema.field(c).type}" for c in schema.names if f.schema_arrow.field(c).type != schema.field(c).type]:
                    return "; ".join(other)
                for _ in f.iter_batches(1024, columns=schema.names):
                    pass
        except Exception as e:  # noqa: BLE001  whatever a damaged file raises is the answer
            return f"{type(e).__name__}: {e}"
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(url)
        for b in batches:
            told = [why(f"{root}/{DATASET}/{p.file}", fs) for p in map(Partition, b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(told, pa.string())], ["order", "pixel", "error"])

    return partitions.select("order", "pixel").mapInArrow(run, "order int, pixel bigint, error string")


class Catalog:
    """A catalog opened for reading; data are read by Spark, only indexes and footers here."""

    def __init__(self, spark: SparkSession, url: str):
        self.spark, self.url = spark, url.rstrip("/")
        self.fs, self.root = filesystem(self.url)
        info = self.fs.get_file_info(self.root)
        if info.type != pafs.FileType.Directory:
            raise FileNotFoundError(f"no catalog at {url}")
        self.is_complete = self._exists(PROPERTIES)
        self.properties = properties.read(self._text(PROPERTIES)) if self.is_complete else {}
        self.name = self.properties.get("obs_collection") or self.root.rsplit("/", 1)[-1]

    @property
    def protocol(self) -> str:
        return urlparse(self.url).scheme if "://" in self.url else "file"

    @property
    def is_local(self) -> bool:
        return self.protocol in ("file", "local")

    def _exists(self, path: str) -> bool:
        return self.fs.get_file_info(f"{self.root}/{path}").type == pafs.FileType.File

    def _text(self, path: str) -> str:
        with self.fs.open_input_stream(f"{self.root}/{path}") as f:
            return f.read().decode()

    @functools.cached_property
    def partitions(self) -> list[Partition]:
        """In order, from the index file if there is one, else from the files' names."""
        return indexed(self.url)

    def path(self, partition: Partition) -> str:
        return f"{self.root}/{DATASET}/{partition.file}"

    def uri(self, partition: Partition) -> str:
        """The partition's file as Spark reads it."""
        return f"file://{self.path(partition)}" if "://" not in self.url else f"{self.url}/{DATASET}/{partition.file}"

    @functools.cached_property
    def arrow_schema(self) -> pa.Schema:
        """Of the common metadata file, else the metadata file, else the first partition."""
        names = [f"{DATASET}/{n}" for n in ("_common_metadata", "_metadata") if self._exists(f"{DATASET}/{n}")]
        with self.fs.open_input_file(f"{self.root}/{names[0]}" if names else self.path(self.partitions[0])) as f:
            return pq.read_schema(f)

    @functools.cached_property
    def schema(self) -> T.StructType:
        return from_arrow_schema(self.arrow_schema.remove_metadata())

    def index(self, partitions: Sequence[Partition] | None = None) -> DataFrame:
        """(order, pixel) of the partitions."""
        return keys(self.spark, self.partitions if partitions is None else partitions)

    def read(self, partitions: Sequence[Partition] | None = None, columns: Sequence[str] | None = None, keys: bool = False, damaged: bool = False) -> DataFrame:
        """Rows of the partitions; keys: with _order, _pixel and _row (place in the file).

        Files are named one by one, so no column is taken from folder names. damaged: a file that can't be read
        gives the rows before the fault only, and what reads them must count them.
        """
        chosen = self.partitions if partitions is None else list(partitions)
        fields = self.schema.names if columns is None else list(columns)
        schema = T.StructType([self.schema[c] for c in fields])
        if not chosen:
            df = self.spark.createDataFrame([], schema)
            return df.selectExpr("*", "0 _order", "0L _pixel", "0L _row") if keys else df
        df = self.spark.read.schema(schema).option("ignoreCorruptFiles", str(damaged).lower()).parquet(*[self.uri(p) for p in chosen])
        if not keys:
            return df
        part = lambda i, t: F.regexp_extract("_metadata.file_path", PATH, i).cast(t)
        return df.select("*", part(1, "int").alias("_order"), part(3, "long").alias("_pixel"), F.col("_metadata.row_index").alias("_row"))

    def sample(self, n: int = 8) -> DataFrame:
        """First rows of the first partition."""
        return self.read_partition(self.partitions[0], most=n)

    def read_partition(self, partition: Partition, columns: Sequence[str] | None = None, most: int | None = None) -> DataFrame:
        df = self.read([partition], columns, keys=most is not None)
        return df if most is None else df.filter(F.col("_row") < most).drop("_order", "_pixel", "_row")

    def band_labels(self, column: str) -> list[str] | None:
        """Labels of the column's first row, None where it has none."""
        name = alias(self.schema[column].dataType, IMAGE_FIELDS["bands"])
        row = self.read([self.partitions[0]], [column], keys=True).filter("_row = 0").select(F.col(f"`{column}`").getField(name)).first()
        return list(row[0]) if row and row[0] else None


def open_catalog(spark: SparkSession, source: str | os.PathLike, catalog: str | None = None) -> Catalog:
    """A catalog, or the main one of a collection unless another is named."""
    url = normalized(source).rstrip("/")
    if catalog is not None:
        return Catalog(spark, f"{url}/{catalog}")
    fs, root = filesystem(url)
    have = lambda n: fs.get_file_info(f"{root}/{n}").type == pafs.FileType.File
    if have(COLLECTION) and not have(PROPERTIES):
        with fs.open_input_stream(f"{root}/{COLLECTION}") as f:
            url = f"{url}/{properties.read(f.read().decode())[PRIMARY]}"
    return Catalog(spark, url)
