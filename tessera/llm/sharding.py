"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions.

The ring is cut into CELLS cells. A text's hash is its place, so equal texts are neighbours. Each
shard owns the cells up to its virtual nodes. A shard holds at most its share; keys that find theirs
full continue clockwise to the next virtual node whose shard has room. Only the number of rows of
each cell (a fixed number of cells) reaches the driver, which cuts cells where a shard fills up; rows
find their place by rank in their cell.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, numbered, ranked, table, unit

CELLS = 4096
NODES = 32
SEED = 11


def ring(shards: int, nodes: int = NODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node in clockwise order; further shards only add nodes."""
    return sorted((zlib.crc32(f"{s}:{v}".encode()) % cells, s) for s in range(shards) for v in range(nodes))


def place(counts: dict[int, int], shards: int, slack: float = 0.0, nodes: int = NODES, cells: int = CELLS) -> list[dict]:
    """Runs of ranks of each cell and the shard and first slot they go to.

    Without slack the shards' room adds up to the rows, so counts are at most one apart.
    """
    total, points = sum(counts.values()), ring(shards, nodes, cells)
    room = [total // shards + (s < total % shards) if not slack else -int(-(1 + slack) * total // shards) for s in range(shards)]
    used, out, nearest = [0] * shards, [], 0
    for cell in range(cells):
        while nearest < len(points) and points[nearest][0] < cell:
            nearest += 1
        at, rank, left = nearest, 0, counts.get(cell, 0)
        while left:
            s = points[at % len(points)][1]
            n = min(left, room[s] - used[s])
            if n > 0:
                out.append({"c": cell, "a": rank, "b": rank + n, "s": s, "t": used[s]})
                used[s], rank, left = used[s] + n, rank + n, left - n
            at += 1
    return out


def shard(docs: DataFrame, shards: int = 16, slack: float = 0.0, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of docs.

    Rows of equal texts follow one another on the ring and share a shard unless it fills up. size is
    the text's UTF-8 bytes plus 1; a null text counts as empty. Equal rows are interchangeable.
    Slots run from 0 without gaps in every shard. An empty table gives no rows; other columns of docs
    are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(text).alias("place"))
    rows = materialize(numbered(rows, "k").withColumn("u", unit(F.col("doc_id").cast("string"), F.col("k"), seed=seed)))
    cell = F.pmod(F.shiftrightunsigned(F.col("place"), 40), F.lit(CELLS)).cast("int")
    keys = materialize(rows.groupBy("place").agg(F.count(F.lit(1)).alias("n")).withColumn("cell", cell))
    sums = {r["cell"]: r["n"] for r in keys.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    runs = F.from_json(F.lit(json.dumps(place(sums, shards, slack))), "array<struct<c:int,a:bigint,b:bigint,s:int,t:bigint>>")
    runs = rows.sparkSession.range(1).select(F.inline(runs))
    before = Window.partitionBy("cell").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    # Written before the join: both of its sides are plain exchanges, so a hot text's side can be split.
    keys = materialize(keys.select("place", "n", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    joined = materialize(rows.join(keys, "place"))
    placed = ranked(joined, ["place"], "n", "u", ["doc_id", "k"], "r").withColumn("r", F.col("r") + F.col("start"))
    # The runs are a few for each of a fixed number of cells.
    found = placed.join(F.broadcast(runs), (F.col("cell") == F.col("c")) & (F.col("r") >= F.col("a")) & (F.col("r") < F.col("b")))
    return found.select("doc_id", "size", "text_crc32", F.col("s").alias("shard"), (F.col("t") + F.col("r") - F.col("a")).alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    found = shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
