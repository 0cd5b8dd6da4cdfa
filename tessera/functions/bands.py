"""Band labels of images: normal form and survey."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: surveys' label prefixes and the bands known for each. A codec may bring its own.
SURVEYS = {"DES": ("G", "R", "I", "Z"), "HSC": ("G", "R", "I", "Z", "Y")}
BANDS = tuple(f"{p}-{b}" for p, bands in SURVEYS.items() for b in bands)


def normalize(label: str, prefix: str, bands: tuple[str, ...] = BANDS) -> str:
    """des-g, des_g or g as DES-G; an unknown band is a ValueError."""
    band = label.upper().replace("_", "-")
    band = band if "-" in band else f"{prefix}-{band}"
    if band not in bands:
        raise ValueError(f"band {label!r} is not one of {list(bands)}")
    return band


def normalized(label: Column, prefix: str) -> Column:
    """normalize() as a column, without the check."""
    band = F.translate(F.upper(label), "_", "-")
    return F.when(band.contains("-"), band).otherwise(F.concat(F.lit(f"{prefix}-"), band))


def unknown(labels: Column, prefix: str, bands: tuple[str, ...] = BANDS) -> Column:
    """Whether any label of the array is null or no known band."""
    return F.exists(labels, lambda x: ~F.coalesce(normalized(x, prefix).isin(*bands), F.lit(False)))
