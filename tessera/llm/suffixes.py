"""Removal of repeated passages by bucket-pointer refinement of suffixes.

A byte goes if a string of `length` bytes that covers it starts anywhere else too. Equal strings are
found as suffixes that share a bucket:

1. Initial buckets. Every window of `length` bytes picks its smallest q-gram, the leftmost on ties, so
   equal windows pick the same one at the same place. The windows that pick one occurrence of a q-gram
   are consecutive: a run. Suffixes are bucketed by the picked q-gram's hash; a bucket of one run is
   final.
2. Equal runs of a bucket are told by their hash and stand there once, with their number.
3. Refinement. The texts of a bucket's runs meet in a task. Its suffixes are sorted by their bucket
   identifier and that of the suffix as many bytes later as buckets are deep, which doubles the depth;
   the new identifiers are used for the next round, until no bucket holds two suffixes (a run's number
   counts) or buckets are `length` bytes deep. Suffixes that still share one repeat.

Identifiers are the same in every task, so a bucket of more than `bucket` runs is dealt over several
tasks, and suffixes still single in theirs meet by their last identifiers. Nothing is capped.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, extended, fresh, letting_go, materialize, prepare, table

LENGTH = 200
Q = 64
#: Bytes that the first buckets of a refinement are deep.
DEPTH = 25
#: Different runs of a bucket that meet in one task.
BUCKET = 1024
#: Windows of a text looked at together, and bytes of runs refined together: memory only.
PIECE, BATCH = 1 << 18, 1 << 20
_BASE = 0xD6E8FEB86659FD93
_BYTES = np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=np.uint64)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    return tuple(np.cumprod(np.concatenate([np.ones(1, _U), np.full(n, b, _U)]), dtype=_U) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


class _Hashes:
    """Hashes of any part of a text from running sums; equal parts hash alike wherever they stand."""

    def __init__(self, text: np.ndarray):
        self.up, down = _powers(1 << max(12, len(text).bit_length()))
        self.sums = np.zeros(len(text) + 1, _U)
        np.cumsum(_BYTES[text] * down[: len(text)], out=self.sums[1:])

    def grams(self, q: int) -> np.ndarray:
        n = len(self.sums) - q
        return _mix((self.sums[q:] - self.sums[:n]) * self.up[:n])

    def parts(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * self.up[a] + (b - a).astype(_U))


def runs(text: bytes, length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, run hash, first window, last window) of each run of windows that pick one q-gram."""
    out, w = [], length - q + 1
    every = np.frombuffer(text, np.uint8)
    for at in range(0, len(text) - length + 1, PIECE):
        hashes = _Hashes(every[at : at + PIECE + length - 1])
        grams = hashes.grams(q)
        n = len(grams) - w + 1
        # Smallest of w neighbours from running minima of blocks, forwards and backwards.
        key = np.full(-(-len(grams) // w) * w, (1 << 64) - 1, _U)
        key[: len(grams)] = (grams >> _U(24) << _U(24)) | np.arange(len(grams), dtype=_U)
        block = key.reshape(-1, w)
        ahead, back = np.minimum.accumulate(block, axis=1).ravel(), np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        pick = (np.minimum(back[:n], ahead[w - 1 : w - 1 + n]) & _U(0xFFFFFF)).astype(np.int64)
        last = np.flatnonzero(np.append(pick[1:] != pick[:-1], True))
        first = np.concatenate([[0], last[:-1] + 1])
        out.append((grams[pick[last]].view(np.int64), hashes.parts(first, last + length).view(np.int64), first + at, last + at))
    return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(4))


def refine(texts: list[bytes], number: np.ndarray, length: int = LENGTH, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of the texts in turn: text, offset, whether another window equals it, place in the joined texts.

    number: how often each text stands in the bucket. Buckets are `depth` bytes deep to begin with.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    of = np.repeat(np.arange(len(texts)), sizes)
    room = np.cumsum(sizes)[of] - np.arange(len(of))  # bytes from a suffix to the end of its text
    times, bucket = number[of], np.zeros(len(of), np.int64)

    def dealt(live: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that share their bucket, also as marks of all; buckets of equal keys get an identifier."""
        bucket[live] = np.unique(keys, return_inverse=True)[1]
        shared = live[np.bincount(bucket[live], times[live])[bucket[live]] > 1]
        held = np.zeros(len(of), bool)
        held[shared] = True
        return shared, held

    depth = min(depth, length)
    live = np.flatnonzero(room >= depth)
    shared, held = dealt(live, _Hashes(np.frombuffer(b"".join(texts), np.uint8)).grams(depth)[live])
    while depth < length and len(shared):
        step = min(depth, length - depth)
        live = shared[room[shared] >= depth + step]
        live = live[held[live + step]]  # where the later part is alone, the whole is
        shared, held = dealt(live, bucket[live] << 32 | bucket[live + step])
        depth += step
    count = sizes - length + 1
    text = np.repeat(np.arange(len(texts)), count)
    offset = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    at = (np.cumsum(sizes) - sizes)[text] + offset
    return text, offset, held[at], at


def identifiers(texts: list[bytes], length: int = LENGTH, depth: int = DEPTH) -> np.ndarray:
    """Of every suffix of the joined texts: its bucket's identifier at full depth, by the rounds of refine(), the same in any task."""
    depth = min(depth, length)
    name = _Hashes(np.frombuffer(b"".join(texts), np.uint8)).grams(depth)
    while depth < length:
        step = min(depth, length - depth)
        name = _mix(name[: len(name) - step] * _U(0xC2B2AE3D27D4EB4F)) + name[step:]
        depth += step
    return name.view(np.int64)


def _spans(of: np.ndarray, offset: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last) of maximal runs of hit windows within a text."""
    at = np.flatnonzero(hit)
    if not len(at):
        return at, at, at
    new = np.flatnonzero(np.append(True, (np.diff(at) > 1) | (np.diff(of[at]) > 0)))
    last = np.append(new[1:], len(at)) - 1
    return of[at[new]], offset[at[new]], offset[at[last]]


def _binary(df: DataFrame, name: str):
    return F.coalesce(df[name].cast("string").cast("binary"), F.lit(b""))


def repeated(docs: DataFrame, length: int = LENGTH, q: int = Q, bucket: int = BUCKET, again: bool = False) -> DataFrame:
    """(key, spans) of the rows of docs (key, text binary) that hold a repeated string.

    spans: array of (a, b), first and last start of strings of `length` bytes that start elsewhere too.
    again: rows may share a key; they must be equal then.
    """
    prepare(docs.sparkSession)
    kind = docs.schema["key"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [runs(t, length, q) for t in b.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(g[0]) for g in got])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([g[i] for g in got]).astype(t))) for i, t in enumerate((np.int64, np.int64, np.int32, np.int32))]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], ["key", "h", "r", "a", "b"])

    long = docs.filter(F.octet_length("text") >= length)
    every = materialize(long.mapInArrow(lambda batches: letting_go(cut(batches)), f"key {kind}, h array<bigint>, r array<bigint>, a array<int>, b array<int>"))
    shared = materialize(every.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
    found = materialize(every.select("key", F.inline(F.arrays_zip("h", "r", "a", "b"))).join(shared, "h"))
    discard(every, shared)
    # Equal runs as one, with their number; by bucket, how many different runs. Written before they are
    # joined: both sides are plain exchanges then, so a hot bucket's side can be split.
    same = materialize(found.groupBy("h", "r").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "a", "b")).alias("one")))
    kinds = materialize(same.groupBy("h").agg(F.count(F.lit(1)).alias("m")))
    lists = same.join(kinds, "h").groupBy(F.col("one.key").alias("key")).agg(F.collect_list(F.struct("h", "r", "n", "m", "one.a", "one.b")).alias("runs"))
    once = long.dropDuplicates(["key"]) if again else long

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ("h", "r", "n", "m"), (pa.int64(),) * 4
        for b in batches:
            for text, rows in zip(*(b.column(k).to_pylist() for k in range(2)), strict=True):
                for k in range(0, len(rows), 20_000):
                    part = rows[k : k + 20_000]
                    data = [pa.array([x[c] for x in part], t) for c, t in zip(names, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*data, pa.array([text[x["a"] : x["b"] + length] for x in part], pa.binary())], [*names, "text"])

    sent = once.join(lists, "key").select("text", "runs").mapInArrow(lambda batches: letting_go(texts(batches)), "h bigint, r bigint, n bigint, m bigint, text binary")
    parts = F.ceil(F.col("m") / bucket)
    sent = sent.withColumn("s", F.pmod("r", parts)).withColumn("many", parts > 1)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            h, s = b.column(0).to_numpy(), b.column(1).to_numpy()
            edge = np.append(0, np.flatnonzero((np.diff(h) != 0) | (np.diff(s) != 0)) + 1) if len(h) else np.zeros(0, int)
            if held and len(h) and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) == (h[0], s[0]):
                edge = edge[1:]  # the first group goes on from the batch before
            bytes_before = np.concatenate([[0], np.cumsum(pc.binary_length(b.column(5)).to_numpy())])
            start = 0
            for e in edge:
                if size + bytes_before[e] - bytes_before[start] >= BATCH and (e > start or held):
                    yield from refined_of([*held, b.slice(start, e - start)])
                    held, size, start = [], 0, e
            held.append(b.slice(start))
            size += bytes_before[-1] - bytes_before[start]
        yield from refined_of(held)

    def refined_of(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks() if held else None
        if t is None or not t.num_rows:
            return
        h, r, number, many = (t.column(i).to_numpy() for i in (0, 2, 3, 4))
        text = t.column(5).to_pylist()
        of, offset, equal, at = refine(text, number, length)
        names = ["h", "r", "a", "b", "w"]
        row, x, y = _spans(of, offset, equal)
        yield pa.RecordBatch.from_arrays([pa.array(h[row]), pa.array(r[row]), pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.nulls(len(row), pa.int64())], names)
        if many.any():
            window = identifiers(text, length)[at]
            for seen in (False, True):
                some = np.flatnonzero(many[of] & (equal == seen))
                if seen:  # once is enough
                    some = some[np.unique(window[some], return_index=True)[1]]
                n, place = len(some), pa.array(offset[some], pa.int32())
                where = pa.nulls(n, pa.int32()) if seen else place
                yield pa.RecordBatch.from_arrays([pa.array(h[of[some]]), pa.array(r[of[some]]), where, where, pa.array(window[some])], names)

    dealt = sent.repartition("h", "s").sortWithinPartitions("h", "s").select("h", "s", "r", "n", "many", "text")
    refined = materialize(dealt.mapInArrow(lambda batches: letting_go(sort(batches), _powers.cache_clear), "h bigint, r bigint, a int, b int, w bigint"))
    hits = refined.filter("w is null").select("h", "r", "a", "b")
    open_ = refined.filter("w is not null")
    if not open_.isEmpty():
        twice = materialize(open_.groupBy("h", "w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "w"))
        hits = hits.unionByName(open_.filter("a is not null").join(twice, ["h", "w"]).select("h", "r", "a", "b"))
    # From the runs that stand for others to all of these.
    at = hits.select("h", "r", F.col("a").alias("x"), F.col("b").alias("y"))
    placed = found.join(at, ["h", "r"]).select("key", (F.col("a") + F.col("x")).alias("a"), (F.col("a") + F.col("y")).alias("b"))
    spans = materialize((placed.distinct() if again else placed).groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    discard(found, same, kinds, refined)
    return spans


def removed_spans(spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by the strings."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"] + length) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def dedup(docs: DataFrame, length: int = LENGTH, q: int = Q, bucket: int = BUCKET, readable: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (long) and kept (binary): each text without repeated strings.

    readable: kept is a string, and a character that a cut goes through goes as well. The columns' names take a suffix where docs has them already. Texts are whole UTF-8 bytes, null as
    empty; strings are judged on the input. Texts under `length` bytes keep all. Equal texts of at
    least `length` bytes lose all, rows that repeat a doc_id included. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    key, text, spans = fresh(docs, "_key", "_text", "_spans")
    names = fresh(docs, "n_bytes", "n_removed", "n_spans", "kept")
    # doc_id names a row; where it repeats, the text's hash joins it, and rows equal in both share a key.
    repeats = not docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty()
    name = F.concat_ws("#", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64(F.col("text").cast("string"))) if repeats else F.col("doc_id")
    keyed = docs.withColumn(key, name).withColumn(text, _binary(docs, "text"))
    found = repeated(keyed.select(F.col(key).alias("key"), F.col(text).alias("text")), length, q, bucket, repeats).withColumnsRenamed({"key": key, "spans": spans})
    both = keyed.join(found, key, "left").drop(key).select(*docs.columns, text, spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, marked = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            cuts = [removed_spans(m, length) for m in marked]
            kept = []
            for t, c in zip(raw, cuts, strict=True):
                edges = [0, *(x for s in c for x in s), len(t)]
                kept.append(b"".join(t[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)) if c else t)
            sizes = [[len(t) for t in raw], [len(t) - len(k) for t, k in zip(raw, kept, strict=True)], list(map(len, cuts))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *(pa.array(s, pa.int64()) for s in sizes), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if readable else pa.array(kept, pa.binary())], [*b.schema.names[:-2], *names])

    return both.mapInArrow(lambda batches: letting_go(run(batches)), extended(docs.schema, *((n, "long") for n in names[:3]), (names[3], "string" if readable else "binary")))


def query(spark, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Every window's hash counted, on the bytes as hexadecimal digits; runs of windows that repeat become spans.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, {2 * LENGTH})) AS m FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - {LENGTH - 1})) AS i FROM d WHERE len(x) >= {2 * LENGTH})),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY m) AS n FROM w) WHERE n > 1),
s AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH}, TRUE)::INT AS new FROM r),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM s),
p AS (SELECT doc_id, k, min(i) AS a, max(i) + {LENGTH} AS b FROM g GROUP BY ALL),
c AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM p GROUP BY doc_id),
e AS (SELECT d.doc_id, x, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, [0] || coalesce(b, []) AS b, coalesce(a, []) || [len(x) // 2] AS a FROM d LEFT JOIN c ON c.doc_id = d.doc_id)
SELECT doc_id, len(x) // 2 AS n_bytes, n_removed, n_spans, sha256(unhex(array_to_string(list_transform(range(1, len(a) + 1), lambda k: x[2 * b[k] + 1 : 2 * a[k]]), ''))) AS kept_sha256 FROM e"""
