from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tessera.llm import tries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows) -> set:
    """The same by dictionaries; turns of one conversation that share their number must be equal."""
    own = defaultdict(list)
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    members = defaultdict(list)
    ends = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, who in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(who) - 1) * words
            leaves[node[:d]] += node not in children
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return {(min(m), len(x), min(members[x[:-1]]) if x else None, len(m), children.get(x, 0), leaves[x], saved[x], sha(ends[x])) for x, m in members.items()}


def talk(seed: int) -> list[tuple]:
    """Conversations that share openings of many lengths, one of 150 turns, some that end inside others, some without a first one."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in [*range(0, 130), -7, -20, -25, 1005, 1007]:
        if c in (60, 80):
            continue
        n = 150 if c in (17, 33) else int(rng.integers(1, 40 if c % 9 == 0 else 5))
        rows += [(c, t, "user" if t % 2 == 0 else "bot", " ".join(f"w{rng.integers(0, 2)}" for _ in range(1 if t < 3 else 2)) if c not in (17, 33) else f"same {t if t < 140 else t + c}") for t in range(n)]
    return rows


@pytest.mark.parametrize("height", [3, 16])
def test_against_dictionaries(spark, height, monkeypatch):
    monkeypatch.setattr(tries, "CHUNK", 7)
    monkeypatch.setattr(tries, "NAMES", 5)
    rows = talk(height)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = tries.prefix_trie(df, height=height)
    assert got.columns == COLUMNS
    got = list(map(tuple, got.collect()))
    assert len(got) == len(set(got)) and set(got) == plain(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "no id"), (5, None, None, None), (5, 0, "user", ""), (5, 3, "user", "b c"), (0, 1, None, "x"), (0, 1, None, "x"), (0, 1, None, "x"), (25, 0, "user", "b " * 9000), (25, 0, "user", "b " * 9000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", id string, d int")
    assert set(map(tuple, tries.prefix_trie(df).collect())) == plain(rows)
    assert tries.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    # No conversation keeps a turn of its own, and none has a first one: all end at the root.
    lone = [c for c in range(1, 200) if zlib.crc32(str(c).encode()) % 4 and c % 20][:9]
    bare = [(c, 0, "user", "gone") for c in lone]
    assert set(map(tuple, tries.prefix_trie(spark.createDataFrame(bare, SCHEMA)).collect())) == plain(bare)


def test_sql(spark):
    """The query's SQL says the same as the dictionaries, and the query the same as both."""
    rows = [r for r in talk(1) if r[0] >= 0]
    spark.createDataFrame(rows, SCHEMA).toPandas().pipe(lambda conversations: duckdb.register("conversations", conversations))
    cur = duckdb.sql(tries.ORACLE_SQL)
    assert cur.columns == COLUMNS and set(cur.fetchall()) == plain(rows)
