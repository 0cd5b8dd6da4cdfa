"""Rows of a catalog beside their tokens: both files of a partition are read in step, so nothing is shuffled or compared by key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions.layout import DATASET, Partition
from tessera.sources.catalog import Catalog, filesystem

BATCH = 1024


def beside(source: Catalog, tokens: Catalog, columns: Sequence[str], token_columns: Sequence[str], check: Sequence[str] = (), partitions: Sequence[Partition] | None = None) -> DataFrame:
    """`columns` of the source and `token_columns` of the catalog made of it, row by row.

    A row's tokens stand at its place in the file of its partition, so one task reads both files of a partition in step, a batch of each at a time; only the
    list of partitions is dealt. Files that have drifted end the query: another number of rows, or another value in one of the
    columns `check`, which both have (null equals null, NaN itself). A shortened file of a limited run has drifted too. partitions: all of the tokens' by default; one that
    either lacks is a ValueError. Names that both sides give are a ValueError.
    """
    spark, wanted = source.spark, list(tokens.partitions if partitions is None else partitions)
    if absent := [str(p) for p in wanted for c in (source, tokens) if p not in set(c.partitions)]:
        raise ValueError(f"there is no {', '.join(absent)} on both sides")
    if twice := sorted({*columns} & {*token_columns}):
        raise ValueError(f"both sides have {', '.join(twice)}")
    schema = T.StructType([*[source.schema[c] for c in columns], *[tokens.schema[c] for c in token_columns]])
    arrow = to_arrow_schema(schema)
    urls = source.url, tokens.url
    sides = list(dict.fromkeys([*columns, *check])), list(dict.fromkeys([*token_columns, *check]))

    def pairs(p: Partition) -> Iterator[pa.RecordBatch]:
        files = []
        for url in urls:
            fs, root = filesystem(url)
            files.append(pq.ParquetFile(fs.open_input_file(f"{root}/{DATASET}/{p.file}")))
        n = [f.metadata.num_rows for f in files]
        if n[0] != n[1]:
            raise ValueError(f"{p} has {n[0]} rows and tokens of {n[1]}")
        at, held = 0, [iter(f.iter_batches(BATCH, columns=c)) for f, c in zip(files, sides, strict=True)]
        left, right = (None, None)
        while at < n[0]:
            # Batches end where row groups do, which differ between the files.
            left = left if left is not None and left.num_rows else next(held[0])
            right = right if right is not None and right.num_rows else next(held[1])
            k = min(left.num_rows, right.num_rows)
            a, b = left.slice(0, k), right.slice(0, k)
            for c in check:
                x, y = a.column(a.schema.get_field_index(c)), b.column(b.schema.get_field_index(c))
                if x.type != y.type or not x.equals(y) and x.to_pandas().fillna("").tolist() != y.to_pandas().fillna("").tolist():
                    raise ValueError(f"{p} has drifted from its tokens: {c} differs in rows {at} to {at + k - 1}")
            found = [*[a.column(a.schema.get_field_index(c)) for c in columns], *[b.column(b.schema.get_field_index(c)) for c in token_columns]]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(found, arrow, strict=True)], schema=arrow)
            at, left, right = at + k, left.slice(k), right.slice(k)
        for f in files:
            f.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in map(Partition, b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield from pairs(p)

    return source.index(wanted).repartition(max(1, len(wanted)), "order", "pixel").mapInArrow(run, schema)
