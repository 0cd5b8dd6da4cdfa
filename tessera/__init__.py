"""Tessera: catalogs of images, spectra and scalars to catalogs of tokens, on Spark DataFrames."""

from tessera.functions.layout import Partition
from tessera.operators.codecs import Batch, Codec, HashQuantizer
from tessera.operators.tokenizer import Tokenizer
from tessera.plans.job import Report, tokenize_catalog
from tessera.plans.registry import Modality, register
from tessera.plans.specs import Spec, detect, resolve
from tessera.sources.catalog import Catalog, open_catalog
from tessera.sources.sink import finalize

__all__ = ["Batch", "Catalog", "Codec", "HashQuantizer", "Modality", "Partition", "Report", "Spec", "Tokenizer", "detect", "finalize", "open_catalog", "register", "resolve", "tokenize_catalog"]
