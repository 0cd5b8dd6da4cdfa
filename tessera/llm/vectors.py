"""Near-duplicate vectors by a pigeonhole join over subspaces.

Vectors of length one with a cosine of t or more are within a squared distance of 2 - 2t. Rotated by a fixed random rotation and
split into blocks of few dimensions, such a pair is within the block's proportional share of that distance in one block at
least. So each block is range-joined under its share, and what any block proposes is verified exactly.

The join of a block is a grid over its first places: a vector goes to all cells within half the radius, so two vectors
within the radius meet in the cell of their midpoint, which alone counts them; of the blocks that propose a pair, the first
counts it. So no pair is ever written, compared for distinctness or found twice: tasks return, for each vector, a number of
links and a spanning forest. A first pass ships only a block's places and tells which vectors have a partner in a cell;
whole vectors are sent to these cells alone.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import discard, letting_go, materialize, prepare, table
from tessera.llm.simhash import components

COSINE = 0.98
#: Places of a block, and how many of them the grid cuts.
WIDTH, GRID = 8, 4
#: Members of a cell that one task compares in the first pass and, with whole vectors, in the second.
PLACES, WHOLE = 4096, 1024
SEED = 42
#: Rotated places are in single precision; radii are wider by more than its error.
SLACK = 1e-5


@functools.cache
def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random rotation of d dimensions, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by a power of two before, so that no square is out of range."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


@functools.cache
def blocks(d: int, cosine: float) -> list[tuple[int, int, float]]:
    """(from, to, squared radius) of each block of d dimensions."""
    cuts = np.linspace(0, d, max(1, round(d / WIDTH)) + 1).astype(int)
    return [(int(a), int(b), (2 - 2 * cosine + SLACK) * float(b - a) / d) for a, b in itertools.pairwise(cuts)]


def _mixed(key: np.ndarray, value: np.ndarray) -> np.ndarray:
    key = (key ^ value.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return key ^ (key >> np.uint64(29))


def _cells(places: np.ndarray, label: np.ndarray, d: int, block: int, squared: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, keys) of the cells within half the radius of each row of places."""
    radius = squared**0.5
    at = places[:, :GRID].astype(np.float64)
    low, high = (np.floor((at + s * radius * 0.500001) / (2 * radius)) for s in (-1, 1))
    start = _mixed(_mixed(label.astype(np.int64).view(np.uint64), np.full(len(at), d)), np.full(len(at), block))
    for step in itertools.product((0, 1), repeat=at.shape[1]):
        rows = np.flatnonzero((high - low >= step).all(axis=1))
        key = start[rows]
        for i, s in enumerate(step):
            key = _mixed(key, low[rows, i] + s)
        yield rows, key.view(np.int64)


def _home(places: np.ndarray, label: np.ndarray, d: int, block: int, squared: float) -> np.ndarray:
    """Key of the cell that each row of places (midpoints) is in."""
    cell = np.floor(places[:, :GRID] / (2 * squared**0.5))
    key = _mixed(_mixed(label.astype(np.int64).view(np.uint64), np.full(len(cell), d)), np.full(len(cell), block))
    for i in range(cell.shape[1]):
        key = _mixed(key, cell[:, i])
    return key.view(np.int64)


def _close(places: np.ndarray, squared: float, side: np.ndarray | None, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of all rows within the radius and a little more, each pair once; only of different sides where there are any."""
    order = np.argsort(places[:, -1], kind="stable")
    x, side = places[order].astype(np.float64), None if side is None else side[order]
    norm, edge = (x * x).sum(axis=1), (squared + SLACK) ** 0.5 * 1.001
    for i in range(0, len(x), rows):
        end = min(len(x), i + rows)
        stop = np.searchsorted(x[:, -1], x[end - 1, -1] + edge, "right")
        near = norm[i:end, None] + norm[None, i:stop] - 2 * (x[i:end] @ x[i:stop].T) <= squared + SLACK
        near &= np.arange(i, end)[:, None] < np.arange(i, stop)[None, :]
        if side is not None:
            near &= side[i:end, None] != side[None, i:stop]
        a, b = np.nonzero(near)
        if len(a):
            yield order[a + i], order[b + i]


def _distance(x: np.ndarray, i: np.ndarray, j: np.ndarray, a: int, b: int) -> np.ndarray:
    """Squared distances over places a to b, added up in order, so that every task gets the same."""
    out = np.zeros(len(i))
    for p in range(a, b):
        step = x[i, p].astype(np.float64) - x[j, p]
        out += step * step
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def _units(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows that agree in the first columns, which come together, across batches."""
    held, last = [], None
    for b in batches:
        columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for start, end in itertools.pairwise([0, *new.tolist(), b.num_rows]):
            if start == end:
                continue
            now = tuple(c[start] for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(b.slice(start, end - start))
            last = now
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _sides(unit_: pa.Table) -> np.ndarray | None:
    return None if unit_["ua"][0] == unit_["ub"][0] else unit_["side"].to_numpy()


def _dealt(rows: DataFrame, most: int) -> DataFrame:
    """rows of keys that more than one node has, sorted into units (key, ua, ub) of `most` nodes on each side.

    A larger key is cut by hash into parts, and every two parts meet in a unit of their own (side tells which is which): a
    row is sent once for each part, so no task holds more than two parts.
    """
    size = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    parts = F.ceil(F.col("size") / most).cast("int")
    cut = rows.join(size, "key").withColumn("parts", parts).withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = cut.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    units = met.select("key", F.least("p", "q").alias("ua"), F.greatest("p", "q").alias("ub"), (F.col("p") > F.col("q")).cast("int").alias("side"), *[c for c in rows.columns if c != "key"])
    return units.repartition("key", "ua", "ub").sortWithinPartitions("key", "ua", "ub")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, smallest row of its class) of rows that aren't it."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            rows = np.flatnonzero(root != np.arange(n))
            return rows, root[rows]


def vector_links(nodes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(a, b, n) of nodes (node, l, m, vec, rot; distinct valid vectors, l their label as a long).

    Rows without b: a is linked to n rows (m of each partner) in some task; rows with b: a and b are in one class.
    """

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, label, size = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for d in np.unique(size):
                of = np.flatnonzero(size == d)
                x = _matrix(b.column(3).take(pa.array(of)))
                for k, (start, end, squared) in enumerate(blocks(int(d), cosine)):
                    for rows, key in _cells(x[:, start:end], label[of], d, k, squared):
                        if len(rows):
                            meta = [key, node[of][rows], label[of][rows], np.full(len(rows), d, np.int32), np.full(len(rows), k, np.int32)]
                            yield pa.RecordBatch.from_arrays([*map(pa.array, meta), _lists(x[rows, start:end])], names=["key", "node", "l", "d", "block", "places"])

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit_ in _units(batches, 3):
            # A key is one block of one label, but for equal hashes, which only add candidates.
            d, k = unit_["d"][0].as_py(), unit_["block"][0].as_py()
            same = np.flatnonzero((unit_["d"].to_numpy() == d) & (unit_["block"].to_numpy() == k))
            if len(same) != len(unit_):
                yield pa.RecordBatch.from_arrays([pa.array(unit_[c].to_numpy()) for c in ("key", "node", "block")], names=["key", "node", "block"])
                continue
            squared, x = blocks(d, cosine)[k][2], _matrix(unit_["places"].chunk(0))
            key, label, found = unit_["key"].to_numpy(), unit_["l"].to_numpy(), np.zeros(len(unit_), bool)
            for i, j in _close(x, squared, _sides(unit_)):
                mine = _home((x[i].astype(np.float64) + x[j]) / 2, label[i], d, k, squared) == key[0]
                found[i[mine]] = found[j[mine]] = True
            rows = np.flatnonzero(found)
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(unit_["node"].to_numpy()[rows]), pa.array(np.full(len(rows), k, np.int32))], names=["key", "node", "block"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit_ in _units(batches, 3):
            of = [unit_[c].to_numpy() for c in ("d", "l", "block")]
            for is_ in sorted({*zip(*(c.tolist() for c in of), strict=True)}):
                rows = np.flatnonzero(np.all([c == v for c, v in zip(of, is_, strict=True)], axis=0))
                yield from links(unit_ if len(rows) == len(unit_) else unit_.take(pa.array(rows)).combine_chunks(), *is_)

    def links(own: pa.Table, d: int, label: int, k: int) -> Iterator[pa.RecordBatch]:
        x, v = _matrix(own["rot"].chunk(0)), unit(_matrix(own["vec"].chunk(0)).astype(np.float64))
        key, node, m = own["key"][0].as_py(), own["node"].to_numpy(), own["m"].to_numpy()
        n, firsts, seconds = np.zeros(len(own), np.int64), [], []
        ways = blocks(d, cosine)
        start, end, squared = ways[k]
        for far_i, far_j in _close(x[:, start:end], squared, _sides(own)):
            for s in range(0, len(far_i), 1 << 14):
                i, j = far_i[s : s + (1 << 14)], far_j[s : s + (1 << 14)]
                middle = (x[i, start:end].astype(np.float64) + x[j, start:end]) / 2
                mine = (_home(middle, np.full(len(i), label), d, k, squared) == key) & (_distance(x, i, j, start, end) <= squared)
                i, j = i[mine], j[mine]
                for a, b, before in ways[:k]:
                    late = _distance(x, i, j, a, b) > before
                    i, j = i[late], j[late]
                good = (v[i] * v[j]).sum(axis=1) >= cosine
                i, j = i[good], j[good]
                np.add.at(n, i, m[j])
                np.add.at(n, j, m[i])
                firsts.append(i)
                seconds.append(j)
                if len(firsts) > 64:  # only a forest is kept of what was found
                    firsts, seconds = ([part] for part in _forest(len(own), np.concatenate(firsts), np.concatenate(seconds)))
        if firsts:
            a, b = _forest(len(own), np.concatenate(firsts), np.concatenate(seconds))
            some = np.flatnonzero(n)
            none = np.full(len(some), None)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[some], node[a]])), pa.array([*none, *node[b].tolist()], pa.int64()), pa.array(np.concatenate([n[some], np.zeros(len(a), np.int64)]))], names=["a", "b", "n"])

    places = T.StructType([*[T.StructField(c, T.LongType()) for c in ("key", "node", "l")], *[T.StructField(c, T.IntegerType()) for c in ("d", "block")], T.StructField("places", T.ArrayType(T.FloatType()))])
    spread = materialize(nodes.select("node", "l", F.size("rot").alias("d"), "rot").mapInArrow(lambda b: letting_go(cells(b)), places))
    marked = materialize(_dealt(spread, PLACES).mapInArrow(lambda b: letting_go(partners(b)), "key long, node long, block int").distinct())
    whole = marked.join(nodes.select("node", "l", F.size("rot").alias("d"), "m", "rot", "vec"), "node").select("key", "node", "block", "l", "d", "m", "rot", "vec")
    found = materialize(_dealt(whole, WHOLE).mapInArrow(lambda b: letting_go(verified(b)), "a long, b long, n long"))
    discard(spread, marked)
    return found


def near_duplicates(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of rows (vec_id, embedding, label).

    Rows link if their labels are equal and the cosine in double precision is at least `cosine` (over 0.5 or so, or blocks
    propose nearly all). n_links: other rows linked directly; component_id: smallest vec_id reachable; kept: vec_id is it.
    A vector that is null, empty, zero or has a null or non-finite place, and a row without a label, link with nothing;
    vectors of different lengths don't link. Equal rows link and are rows of their own; a null vec_id links but names
    no class unless it is alone. An empty table gives no rows. Labels other than whole numbers are told apart by a 64-bit
    hash. Other columns are ignored.
    """
    prepare(rows.sparkSession)
    kind = rows.schema["embedding"].dataType.elementType
    kind = kind if isinstance(kind, T.FloatType) else T.DoubleType()
    vec = F.col("embedding").cast(T.ArrayType(kind))
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    whole = isinstance(rows.schema["label"].dataType, T.IntegralType)
    label = F.col("label").cast("long") if whole else F.when(F.col("label").isNotNull(), F.xxhash64("label"))
    every = materialize(rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("l"), F.when(label.isNotNull() & fine, vec).alias("vec")))
    valid = every.filter("vec is not null")
    distinct = valid.groupBy("l", "vec").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("m")).withColumn("node", F.monotonically_increasing_id())

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.array([len(x) for x in b.column(4)])
            for d in np.unique(size):
                part = b.take(pa.array(np.flatnonzero(size == d)))
                rot = (unit(_matrix(part.column(4)).astype(np.float64)) @ rotation(int(d))).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(rot)], names=[*part.schema.names, "rot"])

    fields = [*[T.StructField(c, T.LongType()) for c in ("node", "l", "first", "m")], T.StructField("vec", T.ArrayType(kind)), T.StructField("rot", T.ArrayType(T.FloatType()))]
    # The nodes get their numbers in the written table, before anything is joined by them.
    numbered = materialize(distinct.select("node", "l", "first", "m", "vec"))
    nodes = materialize(numbered.mapInArrow(lambda b: letting_go(rotate(b)), T.StructType(fields)))
    found = vector_links(nodes, cosine)
    counts = materialize(found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others")))
    root = materialize(components(found.filter("b is not null").select("a", "b")))
    known = nodes.select("node", "first", "m", "l", "vec").join(counts, "node", "left").join(root, "node", "left")
    known = materialize(known.select("l", "vec", "first", "root", (F.coalesce("others", F.lit(0)) + F.col("m") - 1).alias("n_links")))
    low = materialize(known.filter("root is not null").groupBy("root").agg(F.min("first").alias("low")))
    classes = materialize(known.join(low, "root", "left").select("l", "vec", "n_links", F.coalesce("low", "first").alias("component_id")))
    linked = valid.join(classes, ["l", "vec"]).select("vec_id", "n_links", "component_id")
    alone = every.filter("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= {COSINE}),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(l.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN low l ON l.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
"""
