"""Near copies by SimHash confirmed on whole texts: Jaccard similarity of 5-word shingles of 0.8 and more.

Candidates come from simhash.py: fingerprints of the shingles meet through covering masks, so every pair
within the radius is proposed. At a similarity of 0.8 a bit of two fingerprints differs with a
probability of 0.15, 10 of 64 on average, and covering masks for a radius that reaches these pairs
would number hundreds of thousands. What the radius leaves out is proposed by keys: every distinct set
of shingles has BANDS of them, each of ROWS minimum hashes, and a pair of similarity s shares one with
probability 1 - (1 - s^ROWS)^BANDS, 0.999995 at 0.8 and more above it. Proposals of both kinds only
bring texts together: a link stands where the whole sets of shingles have the similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, letting_go, materialize, prepare
from tessera.llm.simhash import RADIUS, components, fingerprint_links, majority, one_of_each, shingle_hashes, text_hash

SEED = 42
WORDS = 5
PERCENT = 80
ROWS, BANDS = 6, 40
#: Distinct sets, and shingles of all of them, that one task compares.
BUCKET, WEIGHT = 4096, 1 << 20
_RANDOM = np.random.default_rng(SEED)
_XOR, _ODD = (_RANDOM.integers(0, 1 << 32, (ROWS * BANDS, 1), np.uint32) for _ in range(2))
_ODD |= np.uint32(1)
_MIX = _RANDOM.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of words; one of all words where there are fewer, none without a word."""
    return np.unique(shingle_hashes(text, words, SEED))


def keys(hashes: np.ndarray) -> np.ndarray:
    """A signed key for each band, distinct between bands."""
    low = np.full(ROWS * BANDS, (1 << 32) - 1, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 512):
        np.minimum(low, ((short[None, i : i + 512] ^ _XOR) * _ODD).min(axis=1), out=low)
    mixed = (low.reshape(BANDS, ROWS).astype(np.uint64) * _MIX).sum(axis=1, dtype=np.uint64)
    return ((mixed >> np.uint64(6)) | (np.arange(BANDS, dtype=np.uint64) << np.uint64(58))).view(np.int64)


def sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, t, sig, n, fp, keys) of every row: hash of the text, hash and size of its set, fingerprint, keys of the set."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = [shingle_hashes(t, words, SEED) for t in b.column(2).to_pylist()]
            found = [np.unique(h) for h in every]
            sig = pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), seed=SEED) if len(s) else 0 for s in found], np.uint64).view(np.int64))
            size = pa.array(np.array([len(s) for s in found], np.int64))
            prints = pa.array([majority(h) for h in every], pa.int64())
            key = pa.array([keys(s) for s in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sig, size, prints, key], ["doc_id", "t", "sig", "n", "fp", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_hash().alias("t"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(lambda batches: letting_go(run(batches)), f"doc_id {kind}, t bigint, sig bigint, n bigint, fp bigint, keys array<bigint>")


def by_fingerprint(first: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(sig, n, key) of the distinct sets (sig, n, fp): sets whose fingerprints are linked, by covering masks, share the key."""
    roots = materialize(components(fingerprint_links(first.select("fp").distinct(), radius)))
    root = F.shiftrightunsigned(F.coalesce("root", "fp"), 6).bitwiseOR(F.lit(-1 << 58))  # no band has this number
    return first.join(roots, F.col("fp") == F.col("node"), "left").select("sig", "n", root.alias("key"))


def forest(found: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (x, centre) joining each connected class of the sets at the similarity, one per non-centre."""
    size = np.array([len(s) for s in found])
    _, token = np.unique(np.concatenate(found), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(found)), size)[np.argsort(token, kind="stable")]
    many = np.bincount(token)
    first = np.cumsum(many) - many
    left, links = np.ones(len(found), bool), []
    for centre in range(len(found)):
        if not left[centre]:
            continue
        left[centre] = False
        front = [centre]
        while front and left.any():
            x = front.pop()
            mine = token[start[x] : start[x + 1]]
            n = many[mine]
            at = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(found))
            hit = np.flatnonzero(left & (100 * both >= percent * (size + size[x] - both)))
            left[hit] = False
            front += hit.tolist()
            links += [(int(y), centre) for y in hit]
    return links


def classes(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, radius: int = RADIUS, bucket: int = BUCKET, weight: int = WEIGHT) -> DataFrame:
    """(doc_id, t, class) of every row of docs: t is the hash of the text, class names its class of near copies.

    Classes are those of links between texts whose sets of shingles have the similarity. Null, empty
    and wordless texts are one class. Sets that fingerprints within the radius or keys connect are compared in one task up to `bucket`
    sets and `weight` shingles. More are compared by key instead, and where a key has more, by pairs
    of parts of it; no pair that shares a key goes unseen.
    """
    every = materialize(sets(docs.select("doc_id", "text"), words))
    # Any row of a set stands for it; a null doc_id is found again by the text's hash.
    first = materialize(every.filter("n > 0").groupBy("sig", "n").agg(F.first("keys").alias("keys"), F.min("fp").alias("fp"), F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "t")).alias("row")))
    dealt = materialize(first.select("sig", "n", F.explode("keys").alias("key")).unionByName(by_fingerprint(first, radius)))
    # Written before it is joined, so both sides are plain exchanges and a hot key's side can be split.
    met = materialize(dealt.groupBy("key").agg(F.min("sig").alias("c"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")).filter("size > 1"))
    shared = materialize(dealt.join(met, "key"))
    discard(dealt, met)
    roots = components(shared.select(F.greatest("sig", "c").alias("a"), F.least("sig", "c").alias("b")).filter("a != b"))
    members = materialize(shared.select("sig", "n").distinct().join(roots, F.col("sig") == F.col("node")).select("sig", "n", "root"))
    loads = materialize(members.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")))
    parts = F.ceil(F.greatest(F.col("size") / bucket, F.col("weight") / weight)).cast("long")
    none = F.lit(0).cast("long")
    units = members.join(loads.filter(parts <= 1).select("root"), "root").select("sig", F.struct(F.col("root").alias("key"), none.alias("i"), none.alias("j")).alias("unit"))
    if not loads.filter(parts > 1).isEmpty():
        large = members.join(loads.filter(parts > 1).select("root"), "root").select("sig")
        cut = shared.join(large, "sig").select("sig", "key", parts.alias("parts")).withColumn("i", F.pmod(F.xxhash64("sig"), F.col("parts")))
        cut = cut.withColumn("j", F.explode(F.sequence(none, F.col("parts") - 1)))
        units = units.unionByName(cut.select("sig", F.struct("key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).alias("unit")))
    rows = first.join(units, "sig").select("sig", "unit", F.col("row.doc_id").alias("_id"), F.col("row.t").alias("_t"))
    texts = docs.select("doc_id", text_hash().alias("t"), F.col("text").cast("string").cast("binary").alias("text"))
    # Rows that repeat doc_id and text bring a set twice, which links it to itself and changes nothing.
    read = texts.join(rows, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")))
    gathered = read.groupBy("unit").agg(F.collect_list(F.struct("sig", "text")).alias("rows")).select("rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1).column(0).flatten()
                sig, text = one.field(0).to_numpy(zero_copy_only=False), one.field(1).to_pylist()
                links = np.array(forest([shingles(t, words) for t in text], percent), np.int64).reshape(-1, 2)
                x, c = sig[links[:, 0]], sig[links[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, c)), pa.array(np.minimum(x, c))], ["a", "b"])

    links = gathered.mapInArrow(lambda batches: letting_go(run(batches)), "a bigint, b bigint")
    found = materialize(components(links).withColumnsRenamed({"node": "sig"}))
    return every.select("doc_id", "t", "sig").join(found, "sig", "left").select("doc_id", "t", F.coalesce("root", "sig").alias("class"))


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """docs without near copies, by classes() and one_of_each()."""
    return one_of_each(docs, materialize(classes(docs, **options)))
