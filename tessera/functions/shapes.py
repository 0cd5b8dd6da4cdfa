"""Columns over nested arrays: shape, regularity, finite values, spectrum masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")
#: Largest float32, to which a codec's input may clip infinities.
FLOAT_MAX = 3.4028234663852886e38


def as_float(x: Column) -> Column:
    """The value in single precision; the cast comes before any test, so 1e300 is infinite."""
    return x.cast("float")


def finite(x: Column) -> Column:
    """Whether a value is neither null, NaN nor infinite in single precision; never null itself.

    NaN is larger than any number in Spark, so one comparison tells.
    """
    return F.coalesce(F.abs(as_float(x)) < INFINITY, F.lit(False))


def _sizes(x: Column) -> Column:
    return F.transform(x, lambda s: F.coalesce(F.size(s), F.lit(0)))


def _level_down(x: Column) -> Column:
    return F.flatten(F.filter(x, lambda s: s.isNotNull()))


def shape(x: Column, ndim: int) -> Column:
    """Array of the ndim dimensions by the longest sub-list of each level; a null sub-list has length 0."""
    dims, level = [F.size(x)], x
    for _ in range(ndim - 1):
        dims.append(F.coalesce(F.array_max(_sizes(level)), F.lit(0)))
        level = _level_down(level)
    return F.when(x.isNotNull(), F.array(*dims))


def regular(x: Column, ndim: int) -> Column:
    """Whether the nested list is a dense block: not null, equal lengths at each level, no empty dimension."""
    ok, level = F.size(x) > 0, x
    for _ in range(ndim - 1):
        sizes = _sizes(level)
        ok = ok & (F.array_min(sizes) == F.array_max(sizes)) & (F.array_min(sizes) > 0)
        level = _level_down(level)
    return F.coalesce(ok, F.lit(False))


def flat(x: Column, ndim: int) -> Column:
    """All values of a regular nested list in order."""
    return reduce(lambda a, _: F.flatten(a), range(ndim - 1), x)


def zero_unless_finite(values: Column) -> Column:
    """Values in single precision, anything not finite as zero (images)."""
    return F.transform(values, lambda v: F.when(F.abs(as_float(v)) < INFINITY, as_float(v)).otherwise(F.lit(0.0).cast("float")))


def spectrum_mask(flux: Column, ivar: Column, mask: Column | None = None, mask_is_bool: bool = True) -> Column:
    """True where a spectrum's sample is to be ignored: flux or ivar not finite, ivar not positive, or masked.

    A null in a boolean mask masks nothing; a null in a numeric mask masks.
    """
    base = F.zip_with(flux, ivar, lambda f, i: ~finite(f) | ~finite(i) | (as_float(i) <= 0))
    if mask is None:
        return base
    given = F.transform(mask, lambda m: F.coalesce(m.cast("boolean"), F.lit(not mask_is_bool)))
    return F.zip_with(base, given, lambda a, b: a | b)
