"""Names of a catalog's files, all of them derived from one declaration of the folder levels."""

from __future__ import annotations

import bisect
import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the catalog layout: folder of the files, levels of a file's path, pixels of a folder, ending.
DATASET = "dataset"
LEVELS = ("Norder", "Dir", "Npix")
PER_FOLDER = 10_000
ENDING = ".parquet"


#: Order of the keys that rows are sorted by; a partition is a range of them.
DEEPEST = 29


def _template(*levels: str) -> str:
    return "/".join(f"{level}=%d" for level in levels)


FILE = _template(*LEVELS) + ENDING
LABEL = _template(LEVELS[0], LEVELS[-1])
PATH = re.escape(FILE).replace("%d", r"(\d+)") + "$"
#: Texts that name a partition: pattern, and the groups of order and pixel. A file's path, else just two whole numbers.
FORMS = ((PATH, 1, 3), (r"^\D*(\d+)\D+(\d+)\D*$", 1, 2))


def values(order, pixel) -> tuple:
    """A path's numbers by level, of numbers or of columns."""
    return order, pixel - pixel % PER_FOLDER, pixel


class Partition(NamedTuple):
    order: int
    pixel: int

    def __str__(self) -> str:
        return LABEL % self

    @property
    def file(self) -> str:
        """Path below the dataset's folder."""
        return FILE % values(*self)


def named(text: str) -> Partition:
    """The partition that a text names in one of the FORMS."""
    for pattern, order, pixel in FORMS:
        if found := re.search(pattern, text):
            return Partition(int(found[order]), int(found[pixel]))
    raise ValueError(f"{text!r} names no partition; write {LABEL % (4, 119)}, for one")


def file(order: Column, pixel: Column) -> Column:
    return F.format_string(FILE, *values(order, pixel))


def label(order: Column, pixel: Column) -> Column:
    return F.format_string(LABEL, order, pixel)


def parsed(text: Column) -> Column:
    """struct<order:int,pixel:bigint> of named(), null where it would raise."""

    def by(pattern: str, order: int, pixel: int) -> Column:
        part = lambda group, kind: F.regexp_extract(text, pattern, group).cast(kind)
        return F.when(text.rlike(pattern), F.struct(part(order, "int").alias("order"), part(pixel, "long").alias("pixel")))

    return F.coalesce(*[by(*form) for form in FORMS])


def overlapping(partitions: Sequence[Partition], ranges: Sequence[tuple[int, int]]) -> list[Partition]:
    """Of a catalog's partitions, each a range of keys itself, those that meet one of the ranges (in order, apart from each other)."""
    firsts, lasts = ([r[i] for r in ranges] for i in (0, 1))

    def meets(p: Partition) -> bool:
        low, high = (p.pixel + i << 2 * (DEEPEST - p.order) for i in (0, 1))
        i = bisect.bisect_left(lasts, low)
        return i < len(firsts) and firsts[i] < high

    return [p for p in partitions if meets(p)]
