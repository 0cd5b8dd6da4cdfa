"""Mixing sources to target weights by subset sums over document lengths.

Documents are counted by source and exact length in words. A source whose target reaches its size is
taken whole, and the rest of its budget is filled with second copies. The rest is fitted on the
counts alone: first an equal share of every length, then a bounded-knapsack dynamic programme over
the lengths for what remains. Which documents of a length are taken follows from a seeded hash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import CHUNK, fresh, materialize, numbered, ranked, table, unit

WEIGHTS = (3, 1, 2)
PERCENT = 150
COPIES = 2
SEED = 7
#: The dynamic programme fits budgets of up to this many words; larger ones are first reduced by whole documents.
EXACT = 1 << 16


def share_out(sizes: Sequence[int], weights: Sequence[float], total: float, copies: int = COPIES) -> list[float]:
    """Targets by weight; what stops at copies * size is shared again by weight among the others.

    In order of what a unit of weight can take, so one pass finds all that stop.
    """
    targets, weight = [0.0] * len(sizes), sum(weights)
    order = sorted(range(len(sizes)), key=lambda i: copies * sizes[i] / weights[i])
    for k, i in enumerate(order):
        if total * weights[i] / weight <= copies * sizes[i]:
            for j in order[k:]:
                targets[j] = total * weights[j] / weight
            break
        targets[i] = float(copies * sizes[i])
        total, weight = total - targets[i], weight - weights[i]
    return targets


def fit(lengths: Sequence[int], counts: Sequence[int], budget: int, exact: int = EXACT) -> list[int]:
    """How many documents of each length to take: a sum up to the budget, as near as the programme finds."""
    lengths, counts = [int(x) for x in lengths], [int(x) for x in counts]
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return counts
    # A few of the longest texts' words are left to the programme, or it could not meet the budget.
    share = max(0, budget - min(exact, 4 * max(lengths)))
    taken = [c * share // total for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, taken, strict=True))
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if left > exact and 0 < lengths[i] <= left:
            more = min(counts[i] - taken[i], -(-(left - exact) // lengths[i]), left // lengths[i])
            taken[i] += more
            left -= more * lengths[i]
    # Reachable sums as bits of one number; for each sum, the item that first reached it.
    mask, reach, items = (1 << (left + 1)) - 1, 1, []
    first = np.full(left + 1, -1, np.int64)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room, step = min(counts[i] - taken[i], left // lengths[i]) if lengths[i] else 0, 1
        while room > 0 and not reach >> left & 1:
            step = min(step, room)
            new = (reach << step * lengths[i]) & mask & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(left // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits)] = len(items)
                items.append((i, step))
                reach |= new
            room, step = room - step, step * 2
    at = reach.bit_length() - 1
    while at:
        i, step = items[first[at]]
        taken[i] += step
        at -= step * lengths[i]
    return taken


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, percent: float = PERCENT, copies: int = COPIES, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row of docs.

    Sources in code-point order, null last, take the weights in turn and share percent % of all words.
    size counts the words of the whole text (null: 0); taken is copies * size, from 0 to 2 copies. A
    source's taken words stay at most its target rounded and come within its smallest gap of sums.
    Rows that repeat are separate documents; equal rows are interchangeable, so reruns agree. An empty
    table gives no rows; other columns of docs are ignored.
    """
    return _mixed(docs, F.lit(0), weights, percent, copies, seed).drop("h", "v")


def _mixed(docs: DataFrame, variant: Column, weights: Sequence[float] = WEIGHTS, percent: float = PERCENT, copies: int = COPIES, seed: int = SEED) -> DataFrame:
    """mix() with h, the text's hash, and v, by which rows are told apart that are alike else."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), words.alias("size"), F.xxhash64(text).alias("h"), variant.cast("long").alias("v"))
    rows = materialize(numbered(rows, "k").withColumn("u", unit(F.col("doc_id").cast("string"), F.col("h"), F.col("k"), seed=seed)))
    lengths = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    sources = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))

    def targets(pdf: pd.DataFrame) -> pd.DataFrame:
        # A row per source: UTF-8 order is code-point order.
        named = sorted(range(len(pdf)), key=lambda i: (pdf.source[i] is None, (pdf.source[i] or "").encode()))
        pdf = pdf.iloc[named].reset_index(drop=True)
        sizes = pdf.source_size.astype(int).tolist()
        turn = [float(weights[i % len(weights)]) for i in range(len(pdf))]
        return pdf[["source", "source_size"]].assign(target=share_out(sizes, turn, sum(sizes) * percent / 100, copies))

    goal = sources.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(targets, "source string, source_size bigint, target double")
    goal = materialize(goal)
    counted = lengths.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        size, budget = int(pdf.source_size[0]), int(pdf.target[0] + 0.5)
        base = min(budget // size, copies - 1) if size else 0
        return pdf.assign(base=base, extra=fit(pdf["size"], pdf.n, budget - base * size))

    planned = counted.groupBy("source").applyInPandas(plan, "source string, size bigint, n bigint, source_size bigint, target double, base int, extra bigint")
    planned = materialize(planned.withColumnsRenamed({"source": "_s", "size": "_z"}))
    # Both sides are written, so a hot source's side of the join can be split.
    joined = rows.join(planned, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))).drop("_s", "_z")
    placed = ranked(materialize(joined), ["source", "size"], "n", "u", ["doc_id", "h", "v", "k"], "r")
    times = (F.col("base") + (F.col("r") < F.col("extra")).cast("int")).cast("int")
    return placed.select("doc_id", "source", "size", "source_size", "target", times.alias("copies"), (times * F.col("size")).cast("long").alias("taken"), "h", "v")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as mix() takes it, columns as they were; documents without words stay once.

    Rows that are alike in all columns are interchangeable: one of them stands for all, as often as the plan takes them
    together, dealt in chunks. So as many words are taken as planned, whatever rows share an id.
    """
    mine, key, n, times, chunk = fresh(docs, "_mine", "_key", "_n", "_times", "_chunk")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "source", "text")]
    variant = F.xxhash64(F.lit(0), *rest)
    hashed = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    taken = F.sum(F.when(F.col("size") > 0, F.col("copies")).otherwise(1)).cast("long")
    plan = _mixed(docs, variant, **options).groupBy(F.struct("doc_id", "source", "h", "v").alias(key)).agg(F.count(F.lit(1)).alias(n), taken.alias(times))
    plan = materialize(plan.filter(F.col(times) > 0))
    named = docs.withColumn(mine, F.struct("doc_id", F.col("source").cast("string").alias("source"), hashed.alias("h"), variant.alias("v")))
    each = named.join(plan, F.col(mine).eqNullSafe(F.col(key))).drop(key)
    # A null text and an empty one have one hash; both have no words and stay once.
    single, alike = each.filter((F.col(n) == 1) | F.col("text").isNull() | (F.col("text") == "")), each.filter((F.col(n) > 1) & (F.col("text") != ""))
    one = F.when(F.col(n) == 1, F.col(times)).otherwise(1)
    single = single.withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), one)))
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / CHUNK).cast("long"))
    alike = alike.dropDuplicates([mine]).withColumn(chunk, F.explode(chunks)).repartition(mine, chunk)
    alike = alike.withColumn(times, F.explode(F.sequence(F.col(chunk) * CHUNK, F.least(F.col(chunk) * CHUNK + CHUNK, F.col(times)) - 1))).drop(chunk)
    return single.unionByName(alike).select(*[f"`{c}`" for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
