"""Modalities as data: what a column can be tokenized as."""

from __future__ import annotations

from dataclasses import dataclass

KINDS = ("image", "spectrum", "scalar")


@dataclass(frozen=True)
class Modality:
    """name: as users write it; key: default token column; source: column name of a scalar; prefix: band prefix."""

    name: str
    kind: str
    key: str
    num_tokens: int
    source: str | None = None
    prefix: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise TypeError(f"{self.name}: {self.kind!r} is no image, spectrum or scalar")
        if self.kind == "scalar" and self.num_tokens != 1:
            raise TypeError(f"{self.name}: a scalar has one token")


def _magnitude(name: str, key: str, source: str) -> Modality:
    return Modality(name, "scalar", key, 1, source)


#: Public survey modalities, their token columns and sizes. register() corrects or adds.
_KNOWN = (
    Modality("LegacySurveyImage", "image", "tok_image", 576, prefix="DES"),
    Modality("HSCImage", "image", "tok_image_hsc", 576, prefix="HSC"),
    Modality("DESISpectrum", "spectrum", "tok_spectrum_desi", 273),
    Modality("SDSSSpectrum", "spectrum", "tok_spectrum_sdss", 273),
    *(_magnitude(f"LegacySurveyFlux{b}", f"tok_flux_{b.lower()}", f"flux_{b.lower()}") for b in ("G", "R", "I", "Z")),
    *(_magnitude(f"LegacySurveyFlux{b}", f"tok_flux_{b.lower()}", f"flux_{b.lower()}") for b in ("W1", "W2", "W3", "W4")),
    Modality("LegacySurveyEBV", "scalar", "tok_ebv", 1, "ebv"),
    Modality("Z", "scalar", "tok_z", 1, "z"),
    Modality("Ra", "scalar", "tok_ra", 1, "ra"),
    Modality("Dec", "scalar", "tok_dec", 1, "dec"),
    *(_magnitude(f"HSCMag{b}", f"tok_mag_{b.lower()}_hsc", f"{b.lower()}_cmodel_mag") for b in ("G", "R", "I", "Z", "Y")),
)
#: Parts of a catalog's name that tell the survey, in order.
IMAGE_HINTS = {"hsc": "HSCImage", "legacysurvey": "LegacySurveyImage", "legacy_survey": "LegacySurveyImage", "decals": "LegacySurveyImage"}
SPECTRUM_HINTS = {"desi": "DESISpectrum", "sdss": "SDSSSpectrum"}

REGISTRY: dict[str, Modality] = {m.name.lower(): m for m in _KNOWN}


def register(modality: Modality) -> Modality:
    """Add a modality, or replace the one of its name."""
    REGISTRY[modality.name.lower()] = modality
    return modality


def get(name: str) -> Modality:
    """By name, whatever its case; KeyError with the known names."""
    if name.lower() not in REGISTRY:
        raise KeyError(f"unknown modality {name!r}; known: {sorted(m.name for m in REGISTRY.values())}")
    return REGISTRY[name.lower()]


def scalar_of(column: str) -> Modality | None:
    """The scalar modality of a column's name, whatever its case."""
    return next((m for m in REGISTRY.values() if m.source and m.source.lower() == column.lower()), None)


def by_prefix(prefix: str) -> Modality | None:
    return next((m for m in REGISTRY.values() if m.kind == "image" and m.prefix == prefix), None)
