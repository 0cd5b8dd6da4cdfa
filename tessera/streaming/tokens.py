"""Tokens of a growing catalog: new partition files as a stream, the checkpoint as the memory of what is done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.layout import DATASET
from tessera.operators.tokenizer import Tokenizer
from tessera.sources.catalog import Catalog


def read_stream(catalog: Catalog, files_at_once: int = 64) -> DataFrame:
    """Rows of partition files as they appear."""
    at = f"file://{catalog.root}/{DATASET}" if "://" not in catalog.url else f"{catalog.url}/{DATASET}"
    options = {"recursiveFileLookup": "true", "pathGlobFilter": "Npix=*.parquet", "maxFilesPerTrigger": str(files_at_once)}
    return catalog.spark.readStream.schema(catalog.schema).options(**options).parquet(at)


def tokenize_stream(catalog: Catalog, tokenizer: Tokenizer, output: str, checkpoint: str, files_at_once: int = 64, **trigger) -> StreamingQuery:
    """Append tokens of new files to a parquet folder; rows that can't be tokenized keep their _error.

    A stream that stops or fails goes on from its checkpoint: files already done are not read again,
    and what a failed batch had written is not part of the output.
    """
    rows = tokenizer.transform(read_stream(catalog, files_at_once), errors="column")
    writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start(output)


