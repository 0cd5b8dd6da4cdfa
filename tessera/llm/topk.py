"""Exact top-k by inner product, term at a time.

Candidates of a block are inverted into postings (term, row, weight). A query's non-zero terms scatter
weighted postings into a dense array of the block's scores; partition selection finds the k-th score
and ties go to the smaller id. Blocks' winners are merged by query. Query blocks meet candidate
blocks, so a task holds one of each whatever the size of either side; terms travel in the narrowest
type that holds them all, and every row is sent once for each block of thousands of the other side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize, table

K = 5
SCALE = 256
QUERY_BLOCK, CANDIDATE_BLOCK = 8192, 4096
#: Whole numbers that a double holds one by one, the largest double, and where products leave the fast path.
_WHOLE, _MOST, _FAST = float(1 << 53), 1.7976931348623157e308, float(1 << 62)
_LONG = (-(1 << 63), (1 << 63) - 1)


def quantized(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as a double, which holds it exactly; null where the vector or a component is null or not finite.

    A component whose multiple is beyond a double counts as the largest double of its sign.
    """
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def cell(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < _WHOLE, F.floor(y).cast("double")).otherwise(F.least(F.greatest(y, F.lit(-_MOST)), F.lit(_MOST)))

    return F.when(vector.isNotNull() & fine, F.transform(vector, cell))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows padded with zeros to the longest; a missing term weighs nothing."""
    rows = column.combine_chunks()
    sizes = np.diff(rows.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = rows.flatten().to_numpy(zero_copy_only=False)
    return out


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, vec_id, score) of each query's k best rows of the block, ties to the smaller id.

    queries and vectors hold whole numbers as doubles. A score beyond a long counts as the long's limit.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    large = np.abs(vectors).max(axis=1, initial=0) >= _FAST
    whole = np.where(large[:, None], 0, vectors).astype(np.int64)
    postings = []
    for t in range(whole.shape[1]):
        at = np.flatnonzero(whole[:, t])
        postings.append((slice(None), whole[:, t].copy()) if len(at) == len(ids) else (at, whole[at, t]))
    with np.errstate(over="ignore", invalid="ignore"):
        # Norms bound every score and partial sum; where these might not fit a long, whole numbers of any size are added up.
        norms, reach = (np.sqrt((x * x).sum(axis=1)) for x in (vectors, queries))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for place, (q, row) in enumerate(zip(query_ids, queries, strict=True)):
        with np.errstate(over="ignore", invalid="ignore"):
            exact = np.flatnonzero(large | ~(norms * reach[place] < _FAST))
        scores = np.zeros(len(ids), np.int64)
        if len(exact) < len(ids):
            for t in np.flatnonzero(row[: len(postings)]):
                at, weights = postings[t]
                scores[at] += int(row[t]) * weights if abs(row[t]) < _FAST else 0
        for i in exact:
            score = sum(int(a) * int(b) for a, b in zip(row.tolist(), vectors[i].tolist(), strict=False) if a and b)
            scores[i] = min(max(score, _LONG[0]), _LONG[1])
        a, b = np.searchsorted(ids, [q, q + 1])
        others = np.concatenate([np.arange(a), np.arange(b, len(ids))])
        own = scores[others]
        if len(own) > k:
            least = np.partition(own, len(own) - k)[len(own) - k]
            above = np.flatnonzero(own > least)
            pick = np.concatenate([above, np.flatnonzero(own == least)[: k - len(above)]])
        else:
            pick = np.arange(len(own))
        out.append((np.full(len(pick), place), ids[others[pick]], own[pick]))
    return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))


def _narrow(df: DataFrame) -> tuple[DataFrame, int]:
    """df with terms in the narrowest type that holds all of them, and its rows."""
    found = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("terms", F.abs))).alias("most")).first()
    kind = next((t for t, bits in (("smallint", 15), ("int", 31)) if (found["most"] or 0) < float(1 << bits)), "double")
    return df.withColumn("terms", F.col("terms").cast(f"array<{kind}>")), found["n"]


def search(queries: DataFrame, candidates: DataFrame, k: int = K, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query row, all if fewer.

    Both sides have vec_id and `terms` (whole numbers; null: takes no part). A query's candidates are
    all rows but those of its own vec_id. Rows that repeat a vec_id and its terms count once; rows of
    one vec_id with other terms are candidates, and queries, of their own. A null vec_id takes no
    part. Empty vectors score zero. A score beyond a long counts as the long's limit. An empty side
    gives no rows.
    """
    sides = [materialize(d.filter("vec_id is not null and terms is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("terms").cast("array<double>").alias("terms")).distinct()) for d in (queries, candidates)]
    (left, n_left), (right, n_right) = map(_narrow, sides)
    n_q, n_c = max(1, -(-n_left // query_block)), max(1, -(-n_right // candidate_block))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id", F.col("terms").cast("array<double>")), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = left.select("vec_id", "terms", F.xxhash64(F.col("terms").cast("array<double>")).alias("name"), dealt(n_q).alias("q"), every(n_c).alias("c"))
    right = right.select("vec_id", "terms", dealt(n_c).alias("c"), every(n_q).alias("q"))

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        own, names = a.column("vec_id").to_numpy(), a.column("name").to_numpy()
        got = (np.zeros(0, np.int64),) * 3
        if a.num_rows and b.num_rows:
            got = best_of_block(_matrix(a.column("terms")), own, _matrix(b.column("terms")), b.column("vec_id").to_numpy(), k)
        return pa.table({"query_id": own[got[0]], "name": names[got[0]], "vec_id": got[1], "score": got[2]})

    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(score, "query_id bigint, name bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id", "name").orderBy(F.desc("score"), "vec_id"))
    best = materialize(found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    discard(*sides)
    return best


def query(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", quantized(F.col("embedding")).alias("terms"))
    return search(vectors.filter("vec_id % 50 = 0"), vectors)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS terms FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.terms, c.terms), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
