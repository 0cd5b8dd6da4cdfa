from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import spelling

SCHEMA = "doc_id long, text string"


def near(x: str, y: str) -> bool:
    if abs(len(x) - len(y)) > 1 or x == y:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len, reverse=True)
    return any(x[:i] + x[i + 1 :] == y for i in range(len(x)))


def plain(rows) -> set:
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            i = h % len(run)
            n[run[:i] + run[i + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    others = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: min(o, key=lambda v: (-n[v], v)) for w, o in others.items() if o}
    form = {w: v for w, v in form.items() if n[v] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), k, len(others[w]), n.get(form.get(w))) for w, k in n.items()}


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text(alphabet="abé", max_size=6), max_size=40))
def test_acceptor(words):
    got = list(spelling.Acceptor(sorted(words)).pairs())
    want = {frozenset(p) for p in itertools.combinations(words, 2) if near(*p)}
    assert len(got) == len(want) and {frozenset(p) for p in got} == want


def test_acceptor_is_minimal():
    a = spelling.Acceptor(sorted(x + y for x in ("ab", "cd", "ef") for y in ("ing", "ed", "")))
    assert len(a.out) == 1 + 3 + 5  # the start, after a, c or e, and one machine for all endings


@pytest.mark.parametrize("partition", [1, 7, 20_000])
def test_pairs_of_any_partition(spark, partition):
    """Small partitions are cut again and again; no pair is lost or found twice."""
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abé"), rng.integers(5, 8))) for _ in range(200)} | {"a" * 300, "a" * 299, "a" * 150 + "b" + "a" * 150, "aaaaa", "aaaaaa", "aaaaaaa", "baaaaa", "aaabaaa"}
    got = [frozenset((r.x, r.y)) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), partition).collect()]
    want = {frozenset(p) for p in itertools.combinations(words, 2) if near(*p)}
    assert len(got) == len(want) and set(got) == want


def corpus(seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    base = ["garden", "gardens", "garten", "Straße", "strasse", "élève", "eleve", "ÉLÈVE", "running", "runing", "abcdefgh", "letter", "better", "setter", "x" * 300]
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(base, 30, p=np.arange(1, 16) / 120))
        rows.append((i if i % 10 else None, text.replace(" ", ["-", " ", "1", "\n"][i % 4])))
    return rows + [(1, None), (2, ""), (3, "÷× ÷÷÷×× " * 9), (4, "long " * 1 + "y" * 5000), (5, "y" * 5000 + " " + "y" * 5000 + " " + "y" * 4999 + "z"), *[(6, "again repeated")] * 4]


def test_against_brute_force(spark):
    rows = corpus(3)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", word string, n int").repartition(4)
    got = list(map(tuple, spelling.variants(df).collect()))
    assert len(got) == len(set(got)) and set(got) == plain(rows)
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql():
    rows = corpus(4)
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert set(con.sql(spelling.ORACLE_SQL).fetchall()) == plain(rows)


def test_chain_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(40)], "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {"w40"}
