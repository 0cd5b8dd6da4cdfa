"""The engine as SQL text: functions, catalogs and their tokens as views.

Functions are temporary ones of Spark's own, whose text takes the place of a call before the plan is
optimized, so a call costs what the expression costs and filters go through it. Views are the lazy
frames of the API, so a query over them has the plan of the API.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions import layout, sphere
from tessera.operators.rows import explode_tokens
from tessera.operators.tokenizer import Tokenizer
from tessera.plans import specs
from tessera.plans.specs import Spec
from tessera.sources.catalog import Catalog, keys, open_catalog


def _text(value: str) -> str:
    """A value as a text of SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _named(pattern: str, order: int, pixel: int) -> str:
    part = lambda group, kind: f"cast(regexp_extract(named, {_text(pattern)}, {group}) AS {kind})"
    return f"CASE WHEN rlike(named, {_text(pattern)}) THEN named_struct('order', {part(order, 'INT')}, 'pixel', {part(pixel, 'BIGINT')}) END"


_BAND = "translate(upper(label), '_', '-')"
_IGNORED = "NOT coalesce(abs(cast({0} AS FLOAT)) < double('Infinity'), false)"
#: Name, parameters, type and text of each function; the columns of functions/ have the same results.
FUNCTIONS = {
    "partition_file": ("norder INT, npix BIGINT", "STRING", f"format_string({_text(layout.FILE)}, norder, npix - npix % {layout.PER_FOLDER}, npix)"),
    "partition_label": ("norder INT, npix BIGINT", "STRING", f"format_string({_text(layout.LABEL)}, norder, npix)"),
    "partition_of": ("named STRING", "STRUCT<`order`: INT, pixel: BIGINT>", f"coalesce({', '.join(_named(*form) for form in layout.FORMS)})"),
    "band_of": ("label STRING, survey STRING", "STRING", f"CASE WHEN contains({_BAND}, '-') THEN {_BAND} ELSE concat(survey, '-', {_BAND}) END"),
    "zero_unless_finite": ("flux ARRAY<FLOAT>", "ARRAY<FLOAT>", "transform(flux, v -> CASE WHEN abs(v) < double('Infinity') THEN v ELSE float(0) END)"),
    "spectrum_ignored": ("flux ARRAY<FLOAT>, ivar ARRAY<FLOAT>", "ARRAY<BOOLEAN>", f"zip_with(flux, ivar, (f, i) -> {_IGNORED.format('f')} OR {_IGNORED.format('i')} OR i <= 0)"),
    "pixel_parent": ("pixel BIGINT, deep INT, norder INT", "BIGINT", "shiftright(pixel, 2 * (deep - norder))"),
    "pixel_first": ("pixel BIGINT, norder INT", "BIGINT", f"shiftleft(pixel, 2 * ({sphere.DEEPEST} - norder))"),
}


def register(spark: SparkSession) -> list[str]:
    """Make FUNCTIONS and the table function explode_tokens known to the session's SQL; once or again. Names of all."""
    for name, (parameters, kind, text) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {text}")
    spark.udtf.register("explode_tokens", explode_tokens)
    return [*FUNCTIONS, "explode_tokens"]


def attach(spark: SparkSession, name: str, source: str | os.PathLike | Catalog, wanted: str | Spec | Sequence[str | Spec] | None = None, number: str = "long") -> list[str]:
    """Views of a catalog: `name` (its rows, with `_order`, `_pixel` and `_row`), `name_partitions` (order, pixel, file), and `name_tokens`.

    wanted: what to tokenize, as for a run ('auto': what is detected); without it there is no
    `name_tokens`, and one that an earlier call made goes. Views are made anew where they exist. Rows that
    can't be tokenized end the query that reads their tokens, and no other. Names of the views.
    """
    if not re.fullmatch(r"[A-Za-z]\w*", name):
        raise ValueError(f"{name!r} is no name of a view")
    catalog = source if isinstance(source, Catalog) else open_catalog(spark, source)
    # All that can be wrong is found before a view changes.
    found = None if wanted is None else specs.resolve(catalog.schema, wanted, catalog.name, catalog.band_labels)
    rows = catalog.read(keys=True)
    made = keys(spark, catalog.partitions).select("order", "pixel", layout.file(F.col("order"), F.col("pixel")).alias("file"))
    views = {name: rows, f"{name}_partitions": made}
    if found is None:
        spark.catalog.dropTempView(f"{name}_tokens")
    else:
        views[f"{name}_tokens"] = Tokenizer(found, number=number).transform(rows)
    for view, df in views.items():
        df.createOrReplaceTempView(view)
    return list(views)
