"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position of a 64-bit fingerprint carries a non-zero vector of GF(2)^(r+1). Table v (each
non-zero v) keeps the positions whose vector has odd inner product with v. Any r differing positions
span at most r dimensions, so some v is orthogonal to all of them and its table drops every differing
bit: each pair within the radius shares a bucket in at least one of the 2^(r+1)-1 tables. No link is
missed, and none is added as distances are checked.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, fresh, letting_go, materialize, prepare, table

SEED = 42
WORDS = 3
RADIUS = 3
#: Distinct fingerprints of a bucket compared in one task; larger buckets go by shared points.
BUCKET = 4096
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_SHIFT = (np.arange(8) * 256).astype(np.int64)


def shingle_hashes(text: bytes | None, words: int, seed: int = SEED) -> np.ndarray:
    """Hashes of all runs of words of UTF-8 text, repeats included; of all words where there are fewer, none without a word."""
    found = (text or b"").lower().split()  # both are ASCII-only on bytes
    rows = zip(*(found[i:] for i in range(words)), strict=False) if len(found) >= words else [found] if found else []
    return np.fromiter(map(functools.partial(xxhash.xxh64_intdigest, seed=seed), map(b" ".join, rows)), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Signed number of the bits that over half of the hashes have; zero where there are none."""
    counts = np.zeros(2048, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.bincount((hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8) + _SHIFT).ravel(), minlength=2048)
    ones = (counts.reshape(8, 256) @ _BITS).ravel()
    value = int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of UTF-8 text; zero where there is no word (null and empty included)."""
    return majority(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row of docs, whole texts."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t, words, seed) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(lambda batches: letting_go(run(batches)), f"doc_id {kind}, fp bigint")


def covering_masks(radius: int = RADIUS) -> list[int]:
    """Signed masks of the 2^(radius+1)-1 tables."""
    top = (1 << (radius + 1)) - 1
    owner = [i % top + 1 for i in range(64)]
    masks = [sum(1 << i for i, m in enumerate(owner) if (m & v).bit_count() & 1) for v in range(1, top + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (x, centre) joining each connected class of distinct fps at the radius, one per non-centre."""
    u, left = fps.view(np.uint64), np.arange(len(fps))
    xs, cs = [], []
    while len(left):
        centre, front = left[0], left[:1]
        left = left[1:]
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            for i in range(0, len(front), 256):
                hit |= (np.bitwise_count(u[front[i : i + 256]][:, None] ^ u[left][None, :]) <= radius).any(axis=0)
            front, left = left[hit], left[~hit]
            xs.append(fps[front])
            cs.append(np.full(len(front), fps[centre]))
    return (np.concatenate(xs), np.concatenate(cs)) if xs else (fps[:0], fps[:0])


def _points(fps: np.ndarray, free: list[int], most: int) -> list[tuple[np.ndarray, int]]:
    """Every point within `most` flips of free bits, by number of flips."""
    flips = [(np.zeros(1, np.int64), np.full(1, -1))]
    bit = np.array([1 << b if b < 63 else -(1 << 63) for b in free], np.int64)
    for _ in range(most):
        value, last = flips[-1]
        a, b = np.nonzero(last[:, None] < np.arange(len(free))[None, :])
        flips.append((value[a] ^ bit[b], b))
    return [(fps[:, None] ^ f[None, :], d) for d, (f, _) in enumerate(flips)]


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a > b: links that connect exactly the distinct fps (column fp) within the radius.

    A bucket of up to `bucket` fingerprints is compared in numpy and returns a spanning forest, never
    all pairs. A larger one is not gathered: each member goes to the points around it, and pairs
    within the radius meet where the half-radius ball of one touches the rest of the other's; a
    point meets a fixed number of members at most, whatever the size of the bucket.
    """
    spark = fps.sparkSession
    masks = covering_masks(radius)
    tables = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("v", "key"))
    # Written before it is joined, so both sides are plain exchanges and a hot bucket's side can be split.
    size = materialize(tables.groupBy("v", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    shared = materialize(tables.join(size, ["v", "key"]))

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_forest(np.sort(np.asarray(x.values, np.int64)), radius) for x in b.column(0)]
            x, c = (np.concatenate([g[i] for g in got] or [np.zeros(0, np.int64)]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, c)), pa.array(np.minimum(x, c))], ["a", "b"])

    small = shared.filter(F.col("n") <= bucket).groupBy("v", "key").agg(F.collect_list("fp").alias("fps"))
    links = small.select("fps").mapInArrow(forests, "a bigint, b bigint")
    if shared.filter(F.col("n") > bucket).isEmpty():
        return links.distinct()
    near, far = radius // 2, radius - radius // 2
    free = [[i for i in range(64) if not (m >> i) & 1] for m in masks]

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, v = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for t in np.unique(v):
                own = fp[v == t]
                for i in range(0, len(own), 64):
                    part = own[i : i + 64]
                    for at, d in _points(part, free[t], far):
                        n = at.shape[1]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(at.size, t, np.int32)), pa.array(at.ravel()), pa.array(np.repeat(part, n)), pa.array(np.full(at.size, d <= near))], ["v", "at", "fp", "near"])

    touched = shared.filter(F.col("n") > bucket).select("fp", "v").mapInArrow(points, "v int, at bigint, fp bigint, near boolean")
    centre = touched.filter("near").groupBy("v", "at").agg(F.min("fp").alias("c"))
    met = touched.join(centre, ["v", "at"]).filter("fp != c").select(F.greatest("fp", "c").alias("a"), F.least("fp", "c").alias("b"))
    return links.unionByName(met).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): smallest node of each connected class, for nodes that have a link (columns a, b).

    Alternating large-star and small-star steps; each is a minimum per node and a join on that node,
    so no class is ever gathered. Every round is written to the shared folder.
    """
    def measure(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialize(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = measure(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # What is aggregated by node is written before it meets the links of a node, so both sides are plain exchanges.
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = materialize(large)
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        before, edges = edges, materialize(small.filter("a != b").distinct())
        now = measure(edges)
        discard(before, low, large, least)
        if now == seen:
            break
        seen = now
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, seed: int = SEED, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs.

    component_id is the smallest doc_id reachable over links of at most `radius` differing bits.
    Null, empty and wordless texts have fingerprint zero and link like any other. Equal rows share
    their class; a null doc_id keeps its row and never names a class unless it is alone. An empty
    table gives an empty result. Other columns of docs are ignored.
    """
    every = materialize(fingerprints(docs.select("doc_id", "text"), words, seed))
    first = every.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(fingerprint_links(first.select("fp"), radius, bucket))
    known = materialize(first.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")))
    # A class of many fingerprints is reduced by partial aggregation before its rows meet.
    low = materialize(known.filter("node is not null").groupBy("root").agg(F.min("first").alias("low")))
    classes = known.join(low, "root", "left").select("fp", F.coalesce("low", "first").alias("component_id"))
    return every.join(materialize(classes), "fp").select("doc_id", "fp", "component_id")


def text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The row of docs with the smallest doc_id of each class, ties and null ids by the text's hash; columns as they were.

    found: (doc_id, t, class) of every row. Only members of one class replace each other; rows that
    repeat doc_id and text are copies, whatever their other columns.
    """
    best = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "t")).alias("row"))
    key, t, mine = fresh(docs, "_id", "_t", "_hash")
    best = materialize(best.select(F.col("row.doc_id").alias(key), F.col("row.t").alias(t)))
    rows = docs.withColumn(mine, text_hash())
    kept = rows.join(best, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(mine) == F.col(t)), "left_semi")
    again = found.groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return (kept if again.isEmpty() else kept.dropDuplicates(["doc_id", mine])).drop(mine)


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """docs without near copies, by near_duplicates() over rows and one_of_each()."""
    row = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("i"), text_hash().alias("t"))
    found = materialize(near_duplicates(docs.select(row.alias("doc_id"), "text"), **options))
    return one_of_each(docs, found.select(F.col("doc_id.i").alias("doc_id"), F.col("doc_id.t").alias("t"), F.col("component_id").alias("class")))


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
