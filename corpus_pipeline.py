"""Corpus preparation: toxicity, near-duplicates, repeated passages, mixing, token ids.

Every stage works on all rows that its predecessor kept, and all but the last return the columns of
documents. Nulls, empty texts and repeated rows have each operator's defined result; an empty table
passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, shingles, suffixes, toxicity
from tessera.llm.common import fresh, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under one half, by a network fitted to the labels of these documents."""
    (name,) = fresh(docs, "score")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.filter(F.col(name) < 0.5).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each class of near copies: SimHash of 5-word shingles by covering masks, minimum hashes for what its radius leaves out, similarity 0.8 and more on whole texts."""
    return shingles.near_dedup(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the strings of 200 bytes that start elsewhere too; n_chars is counted anew."""
    added = fresh(docs, "n_bytes", "n_removed", "n_spans", "kept")
    text = F.when(F.col(added[1]) > 0, F.col(added[3])).otherwise(F.col("text").cast("string"))
    cut = suffixes.dedup(docs, readable=True).withColumn("text", text).drop(*added)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else cut


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.apply_mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian uint32) and whether they decode to the text."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    both = bpe.decode_documents(bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), path), path)
    same = F.col("decoded") == F.coalesce(F.col("text").cast("string"), F.lit(""))
    return both.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("decodes"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("repeated passages", cut_repeats),
    ("source mix", mix_sources),
    ("token ids", tokenize),
]
#: A trained network, classes of links and subset sums are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
