"""Prefix trie of conversations, rolled up by depth bands.

A conversation is a path of turns. Every node of the trie is named by 128 bits: the XOR of hashes of
(depth, turn) down to it, so prefixes need no text and a parent's name is the node's own without its last
turn. The root is zero.

Depths are cut into bands of a fixed height. A node explodes only to its ancestors within its band, whose
sums are then whole for the band; band roots form a trie of their own that is `height` times less deep and
is rolled up the same way; its completed totals go to the ancestors in the band above each band root.
So a node is multiplied by the height at most, and the rounds are the logarithm of the depth to that base.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, discard, letting_go, materialize, prepare, table

#: Depths of a band.
HEIGHT = 16
#: Conversations that share a first conversation's opening, and most turns that they share.
SHARED, OPENING = 20, 4
#: Turns summed in one window; names of conversations joined in one string.
CHUNK, NAMES = 512, 4096
ROOT = "named_struct('a', 0L, 'b', 0L)"


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SPACE.replace("[", "[^"))).cast("long")


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, words): place from 0 of every turn in its conversation, with the turn's two hashes.

    By turn (null first), equal turns by role, then by the text's hash. Rows are sorted over the whole table, so one
    conversation may span many tasks; each task counts from 0, and what the tasks before it hold is added: a task
    starts in the middle of one conversation at most, so these sums are no more rows than tasks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.xxhash64(F.lit(11), role, text).alias("a"), F.xxhash64(F.lit(12), text, role).alias("b"), words(text).alias("words")
    )
    # The last key tells equal rows apart, so that any number of them is dealt over tasks.
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "a", "b"]
    dealt = rows.withColumn("tie", F.rand(7)).repartitionByRange(*order, "tie").sortWithinPartitions(*order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, now, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            at = []
            for c in batch.column(0).to_pylist():
                now, n = c, (n + 1 if c == now else 0)
                at.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([task] * len(at), pa.int32()), pa.array(at, pa.int64()), *(batch.column(i) for i in (1, 2, 3))], names=["conv_id", "task", "at", "a", "b", "words"])

    local = materialize(dealt.select("conv_id", "a", "b", "words").mapInArrow(lambda x: letting_go(count(x)), "conv_id long, task int, at long, a long, b long, words long"))
    held = local.groupBy("conv_id", "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = materialize(held.select("conv_id", "task", before.alias("first")).filter("first is not null"))
    joined = local.join(F.broadcast(starts), ["conv_id", "task"], "left")
    return joined.select("conv_id", (F.col("at") + F.coalesce("first", F.lit(0))).alias("pos"), "a", "b", "words")


def rebuilt(turns: DataFrame, shared: int = SHARED, opening: int = OPENING) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n) of every conversation and (conv_id, d, a, b, words) of its turns, d from 1, with the opening shared.

    Conversation c has the first h turns of c - c % shared (all if fewer, none if absent), then its own after its first
    h, where h = crc32(decimal c) % opening.
    """
    own = materialize(ordered(turns))
    names = materialize(own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % opening
    turn = F.struct("pos", "a", "b", "words")
    first = own.filter((F.col("conv_id") % shared == 0) & (F.col("pos") < opening - 1)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(turn)).alias("first"))
    convs = names.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % shared).alias("base"))
    taken = F.slice(F.col("first"), F.lit(1), F.col("h").cast("int"))
    convs = convs.join(first, "base", "left").select("conv_id", "own", "h", F.coalesce(taken, F.expr("array()").cast("array<struct<pos:bigint,a:bigint,b:bigint,words:bigint>>")).alias("first"))
    convs = materialize(convs.withColumn("shift", F.size("first") - F.col("h")))
    head = convs.select("conv_id", F.explode("first").alias("t")).select("conv_id", F.col("t.pos").alias("pos"), "t.a", "t.b", "t.words")
    tail = own.join(convs.select("conv_id", "h", "shift"), "conv_id").filter("pos >= h").select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "a", "b", "words")
    rows = materialize(head.unionByName(tail).select("conv_id", (F.col("pos") + 1).cast("long").alias("d"), "a", "b", "words"))
    left = F.greatest(F.col("own") - F.col("h"), F.lit(0))
    sizes = materialize(convs.select("conv_id", (F.size("first") + left).cast("long").alias("n")))
    discard(own, names, convs)
    return sizes, rows


def paths(rows: DataFrame) -> DataFrame:
    """rows with `id` (struct a, b) of the node that each turn leads to and `up`, its parent's."""
    step = [F.xxhash64(F.lit(s), "d", "a", "b") for s in (21, 22)]
    terms = rows.select("conv_id", "d", "words", step[0].alias("x"), step[1].alias("y"), F.floor((F.col("d") - 1) / CHUNK).alias("chunk"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    near = materialize(terms.select("*", F.expr("bit_xor(x)").over(inside).alias("p"), F.expr("bit_xor(y)").over(inside).alias("q")))
    # Only chunks with one before them have something to add; a conversation has a row here for every 512 turns.
    longer = near.filter(f"d % {CHUNK} = 0").select("conv_id", "chunk", "p", "q")
    so_far = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    before = materialize(longer.select("conv_id", (F.col("chunk") + 1).alias("chunk"), F.expr("bit_xor(p)").over(so_far).alias("p0"), F.expr("bit_xor(q)").over(so_far).alias("q0")))
    full = near.join(before, ["conv_id", "chunk"], "left").withColumns({c: F.col(c).bitwiseXOR(F.coalesce(f"{c}0", F.lit(0))) for c in ("p", "q")})
    own = F.struct(F.col("p").alias("a"), F.col("q").alias("b"))
    up = F.struct(F.col("p").bitwiseXOR(F.col("x")).alias("a"), F.col("q").bitwiseXOR(F.col("y")).alias("b"))
    return full.select("conv_id", "d", "words", own.alias("id"), up.alias("up"))


def _banded(steps: DataFrame, height: int) -> DataFrame:
    """steps (conv_id, j, id, up) with `line`: ids from the band root above to the node itself."""
    band = Window.partitionBy("conv_id", F.floor((F.col("j") - 1) / height)).orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("line", F.concat(F.array(F.first("up").over(band)), F.collect_list("id").over(band)))


def subtree_sums(steps: DataFrame, values: DataFrame, sums: list[str], height: int = HEIGHT) -> DataFrame:
    """(id, *sums): each of the sums over the node and all that stand below it.

    steps: (conv_id, j, id, up), the nodes of every path in order, j from 1 without gaps, up the node before it;
    values: (id, *sums) of every node, the root included, one row each. Sums are longs.
    """
    # The rows of one node share its line, whichever conversation they come from.
    lines = materialize(_banded(steps, height).groupBy("id").agg(F.any_value("line").alias("line"), F.any_value("j").alias("j"), F.any_value("conv_id").alias("conv_id")))
    placed = values.join(lines.select("id", "j", "line"), "id", "left")
    inner = F.coalesce(F.col("j"), F.lit(0)) % height != 0
    add = [F.sum(s).cast("long").alias(s) for s in sums]
    reach = placed.select(F.explode(F.when(inner, F.col("line")).otherwise(F.array("id"))).alias("id"), *sums)
    local = materialize(reach.groupBy("id").agg(*add))
    roots = lines.filter(f"j % {height} = 0")
    if roots.isEmpty():
        return local
    # The trie of band roots: a root's parent is the root of the band above it.
    above = steps.filter(f"j % {height} = 0").select("conv_id", (F.col("j") / height).cast("long").alias("j"), "id")
    parent = materialize(roots.select("id", F.col("line")[0].alias("up")))
    upper = materialize(above.join(parent, "id").select("conv_id", "j", "id", "up"))
    held = local.join(parent.select("id").unionByName(local.sparkSession.sql(f"SELECT {ROOT} AS id")), "id", "left_semi")
    totals = materialize(subtree_sums(upper, held, sums, height))
    line = F.expr(f"slice(line, 1, {height})")
    sent = totals.join(roots.select("id", "line"), "id").select(F.explode(line).alias("id"), *sums)
    return local.unionByName(sent).groupBy("id").agg(*add)


def digests(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256) from (id, conv_id): SHA-256 of each id's conversations, ascending, comma-joined.

    Names are joined in pieces all over the cluster; one node's pieces then pass one after another through the hash,
    which has to see them in order, so only a piece at a time is in memory.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names = None, []

        def piece(held: list) -> pa.RecordBatch:
            a, b, first, text = ([x[i] for x in held] for i in range(4))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(first, pa.int64()), pa.array(text, pa.string())], names=["a", "b", "first", "names"])

        for batch in batches:
            held = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if names and (row[:2] != now or len(names) >= NAMES):
                    held.append((*now, names[0], ",".join(map(str, names))))
                    names = []
                now = row[:2]
                names.append(row[2])
            yield piece(held)
        if names:
            yield piece([(*now, names[0], ",".join(map(str, names)))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None

        def out(held: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.int64()), pa.array([x[2] for x in held], pa.string())], names=["a", "b", "ends_sha256"])

        for batch in batches:
            held = []
            for a, b, names in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (a, b) != now:
                    if sha:
                        held.append((*now, sha.hexdigest()))
                    now, sha = (a, b), hashlib.sha256(names.encode())
                else:
                    sha.update(b"," + names.encode())
            yield out(held)
        if sha:
            yield out([(*now, sha.hexdigest())])

    flat = ends.select("id.a", "id.b", "conv_id")
    pieces = flat.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(lambda x: letting_go(joined(x)), "a long, b long, first long, names string")
    met = pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(lambda x: letting_go(hashed(x)), "a long, b long, ends_sha256 string")
    return met.select(F.struct("a", "b").alias("id"), "ends_sha256")


def prefix_trie(turns: DataFrame, height: int = HEIGHT, shared: int = SHARED, opening: int = OPENING) -> DataFrame:
    """A row for every distinct beginning of the rebuilt conversations, the root (depth 0) included.

    conv_id: the smallest member; depth; parent_conv_id: the parent's conv_id, null at the root; n_convs: members;
    n_children; n_leaves: nodes without children in the subtree, itself included; saved_tokens: over the subtree, words
    of each node's turn times its members but one; ends_sha256: of the members that end here.

    Turns are ordered as in ordered(). A null role or text is empty; rows with a null conv_id belong to no
    conversation; a repeated row is a turn of its own; an empty table has no node, not even a root. Other columns of
    turns are ignored. Names of nodes and the equality of turns rest on 128-bit hashes.
    """
    prepare(turns.sparkSession)
    sizes, rows = rebuilt(turns.select("conv_id", "turn", "role", "text"), shared, opening)
    on_path = materialize(paths(rows))
    ended = on_path.join(sizes.select("conv_id", F.col("n").alias("d")), ["conv_id", "d"]).select("id", "conv_id")
    ends = materialize(ended.unionByName(sizes.filter("n = 0").select(F.expr(ROOT).alias("id"), "conv_id")))
    below = on_path.groupBy("id").agg(F.min("conv_id").alias("conv_id"), F.any_value("d").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.any_value("words").alias("words"), F.any_value("up").alias("up"))
    top = sizes.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    top = top.select(F.expr(ROOT).alias("id"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("words"), F.lit(None).cast("struct<a:bigint,b:bigint>").alias("up"))
    nodes = materialize(below.unionByName(top))
    children = materialize(nodes.filter("up is not null").groupBy(F.col("up").alias("id")).agg(F.count(F.lit(1)).alias("n_children")))
    n_children = F.coalesce("n_children", F.lit(0)).cast("long")
    counted = nodes.join(children, "id", "left").select("id", "conv_id", "depth", "n_convs", "words", "up", n_children.alias("n_children"))
    values = counted.select("id", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    sums = materialize(subtree_sums(on_path.select("conv_id", F.col("d").alias("j"), "id", "up"), values, ["n_leaves", "saved_tokens"], height))
    parents = nodes.select(F.col("id").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    out = counted.join(parents, "up", "left").join(sums, "id").join(materialize(digests(ends)), "id", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of ASCII text in whole numbers: every byte is mixed in, then eight steps of the polynomial.
CRC = """list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, (a & 1) * 3988292384) END)"""

ORACLE_SQL = f"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor({CRC.format("conv_id::VARCHAR")}, 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
steps AS (
  SELECT c.conv_id, 0 AS part, o.i, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.i <= c.h
  UNION ALL
  SELECT c.conv_id, 1, o.i, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.i > c.h),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS d,
         md5(length(role) || ':' || role || text) AS h, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM steps),
prefixes AS (
  SELECT conv_id, d, words, md5(string_agg(h, ',') OVER (PARTITION BY conv_id ORDER BY d)) AS id,
         coalesce(md5(string_agg(h, ',') OVER (PARTITION BY conv_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 'root') AS up FROM turns
  UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM convs),
lengths AS (SELECT conv_id, max(d) AS d FROM prefixes GROUP BY conv_id),
ends AS (
  SELECT id, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS names FROM prefixes JOIN lengths USING (conv_id, d) GROUP BY id),
nodes AS (
  SELECT id, any_value(up) AS up, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) * (count(*) - 1) AS saved
  FROM prefixes GROUP BY id),
children AS (SELECT up AS id, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
lines AS (
  SELECT DISTINCT b.id AS below, a.id AS above FROM prefixes a JOIN prefixes b ON a.conv_id = b.conv_id AND a.d <= b.d),
sums AS (
  SELECT above AS id, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (c.n IS NULL) AS n_leaves
  FROM lines JOIN nodes n ON n.id = below LEFT JOIN children c ON c.id = below GROUP BY above)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves, s.saved_tokens,
       sha256(coalesce(e.names, '')) AS ends_sha256
FROM nodes n JOIN sums s USING (id) LEFT JOIN nodes p ON p.id = n.up LEFT JOIN children c ON c.id = n.id LEFT JOIN ends e ON e.id = n.id
"""
