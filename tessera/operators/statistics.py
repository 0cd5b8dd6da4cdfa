"""Statistics of token columns that merge: how often each code is used, per column and partition, counts of rows and nulls.

A part is a table of counts; two parts, of other rows, files or runs, merge by adding. From the merged counts come what a codec is
judged by: codes in use, entropy, perplexity, the most frequent code.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of what is counted beside codes: rows of a column, and those without tokens.
ROWS, NULLS = "rows", "nulls"
SCHEMA = "order int, pixel bigint, column string, what string, code bigint, n bigint"


def codes_of(schema: T.StructType, name: str) -> Column | None:
    """The codes of a token column as an array of longs, null where there are none; None of other columns."""
    kind, col = schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.StructType) and kind.names == ["token"] and isinstance(kind["token"].dataType, T.ArrayType):
        col, kind = col.getField("token"), kind["token"].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.IntegralType):
        return col.cast("array<long>")
    return F.when(col.isNotNull(), F.array(col.cast("long"))) if isinstance(kind, T.IntegralType) else None


def part(df: DataFrame, columns: Sequence[str], place: tuple[str, str] | None = None) -> DataFrame:
    """The counts (order, pixel, column, what, code, n) of df's token columns.

    what is 'code' (n uses of a code), 'rows' or 'nulls' (n rows, and of these the ones without tokens). place: columns of order and pixel; else
    both are null. A null code within a row's tokens counts as a code of its own, null. Counting is partial before the only shuffle, which carries
    a row for each code at most. A column that holds no tokens is a ValueError; an empty df has no counts.
    """
    found = {c: codes_of(df.schema, c) for c in columns}
    if wrong := [c for c, codes in found.items() if codes is None]:
        raise ValueError(f"{', '.join(wrong)}: no tokens of whole numbers")
    at = [F.col(c).cast(t) for c, t in zip(place, ("int", "long"), strict=True)] if place else [F.lit(None).cast("int"), F.lit(None).cast("long")]
    item = lambda c, what, code: F.struct(F.lit(c).alias("column"), F.lit(what).alias("what"), code.cast("long").alias("code"))
    none = F.lit(None)

    def items(c: str, codes: Column) -> Column:
        told = F.when(codes.isNull(), F.array(item(c, ROWS, none), item(c, NULLS, none))).otherwise(F.array(item(c, ROWS, none)))
        return F.concat(told, F.coalesce(F.transform(codes, lambda x: item(c, "code", x)), F.slice(told, 1, 0)))

    each = [items(c, codes) for c, codes in found.items()]
    rows = df.select(at[0].alias("order"), at[1].alias("pixel"), F.explode(functools.reduce(lambda a, b: F.concat(a, b), each)).alias("i"))
    return rows.groupBy("order", "pixel", "i.column", "i.what", "i.code").agg(F.count(F.lit(1)).alias("n"))


def merge(*parts: DataFrame) -> DataFrame:
    """Parts of different rows as one."""
    return functools.reduce(DataFrame.unionByName, parts).groupBy("order", "pixel", "column", "what", "code").agg(F.sum("n").alias("n"))


def whole(counts: DataFrame) -> DataFrame:
    """The part of all partitions together; order and pixel are null."""
    none = counts.withColumns({"order": F.lit(None).cast("int"), "pixel": F.lit(None).cast("long")})
    return none.groupBy("order", "pixel", "column", "what", "code").agg(F.sum("n").alias("n"))


def summary(counts: DataFrame, codebook: int | None = None) -> DataFrame:
    """(order, pixel, column, rows, nulls, tokens, codes, entropy, perplexity, top, top_n[, used]) of each partition and column of counts.

    entropy in bits of the code distribution, perplexity 2 to that power, both of no token null; top is the most frequent code, ties to the smallest (null
    first); used: share of a codebook of so many codes. Sums of logarithms are taken over codes in order, so reruns agree.
    """
    by = ["order", "pixel", "column"]
    code = F.col("what") == "code"
    # Entropy from counts alone: log N - sum(n log n) / N, and equal counts are added up at once.
    alike = counts.groupBy(*by, "what", "n").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(F.col("code").isNotNull().alias("known"), F.col("code"))).alias("least"))
    ordered = F.array_sort(F.collect_list(F.when(code, F.struct("n", "m"))))
    weighed = F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x["m"] * (x["n"] * F.log2(x["n"].cast("double"))))
    sums = alike.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("what") == ROWS, F.col("n"))), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("what") == NULLS, F.col("n"))), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(F.when(code, F.col("n") * F.col("m"))), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(code, F.col("m"))), F.lit(0)).alias("codes"),
        weighed.alias("w"),
        F.max_by(F.when(code, F.col("least.code")), F.when(code, F.col("n"))).alias("top"),
        F.max(F.when(code, F.col("n"))).alias("top_n"),
    )
    entropy = F.when(F.col("tokens") > 0, F.greatest(F.log2(F.col("tokens").cast("double")) - F.col("w") / F.col("tokens"), F.lit(0.0)))
    out = sums.withColumn("entropy", entropy).withColumn("perplexity", F.pow(F.lit(2.0), F.col("entropy")))
    out = out.select(*by, "rows", "nulls", "tokens", "codes", "entropy", "perplexity", "top", "top_n")
    return out if codebook is None else out.withColumn("used", F.col("codes") / F.lit(codebook))
