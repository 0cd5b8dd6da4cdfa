"""Codecs: what makes tokens of values."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import shapes
from tessera.plans.registry import Modality


@dataclass
class Batch:
    """Values of one shape: float32 arrays whose first axis are rows; bands and mask where the kind has them."""

    modality: Modality
    flux: np.ndarray
    bands: tuple[str, ...] = ()
    ivar: np.ndarray | None = None
    mask: np.ndarray | None = None
    wavelength: np.ndarray | None = None


class Codec(Protocol):
    """Any model: tokens of whole batches. validate() runs on the driver before any data is read."""

    def validate(self) -> None: ...

    def encode(self, batch: Batch) -> np.ndarray:
        """(rows, num_tokens) whole numbers."""


class HashQuantizer:
    """Deterministic tokens without weights, as a column and as a batch codec with equal results.

    Of a key (the value, or the sum of the flux) the base is |key| * 1000, half to even, modulo 4000;
    token i is base + i modulo 4096.
    """

    SCALE, BASES, CODES = 1000.0, 4000, 4096

    def validate(self) -> None:
        return None

    def encode(self, batch: Batch) -> np.ndarray:
        x = batch.flux.astype(np.float32)
        if batch.modality.kind == "spectrum":
            x = np.nan_to_num(x)
        # Sums run left to right in double precision, as the column's do.
        key = np.cumsum(x.reshape(len(x), -1).astype(np.float64), axis=1)[:, -1]
        base = (np.rint(np.abs(key) * self.SCALE) % self.BASES).astype(np.int64)
        n = batch.modality.num_tokens
        return base[:, None] if n == 1 else (base[:, None] + np.arange(n)) % self.CODES

    def base(self, key: Column) -> Column:
        return (F.rint(F.abs(key) * self.SCALE) % self.BASES).cast("long")

    def key(self, values: Column, kind: str) -> Column:
        """The key of flat values (an array), or of a scalar."""
        if kind == "scalar":
            return shapes.as_float(values).cast("double")

        def clean(v: Column) -> Column:
            f = shapes.as_float(v).cast("double")
            known = F.when(F.abs(f) < shapes.INFINITY, f)
            if kind == "spectrum":
                known = known.when(f == shapes.INFINITY, F.lit(shapes.FLOAT_MAX)).when(f == -shapes.INFINITY, F.lit(-shapes.FLOAT_MAX))
            return known.otherwise(F.lit(0.0))

        return F.aggregate(values, F.lit(0.0), lambda a, v: a + clean(v))

    def tokens(self, values: Column, kind: str, n: int) -> Column:
        """A number for one token, else an array of n; the base is bound once, not once for each token."""
        base = self.base(self.key(values, kind))
        if n == 1:
            return base
        zero, top = F.lit(0).cast("long"), F.lit(self.CODES - 1).cast("long")

        def run(b: Column) -> Column:
            """The tokens from b on; up to CODES of them begin anew once at most, which needs no work for each token."""
            last = b + (n - 1)
            if n > self.CODES:
                return F.transform(F.sequence(b, last), lambda t: t % self.CODES)
            return F.when(last <= top, F.sequence(b, last)).otherwise(F.concat(F.sequence(b, top), F.sequence(zero, last - self.CODES)))

        return F.get(F.transform(F.array(base), run), F.lit(0))
