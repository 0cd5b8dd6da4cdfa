from __future__ import annotations

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import vectors

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, cosine: float = 0.98) -> list:
    def fine(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def near(a, b):
        if not (fine(*a[1:]) and fine(*b[1:])) or a[2] != b[2] or len(a[1]) != len(b[1]):
            return False
        x, y = (np.array(v, float) / np.abs(np.array(v, float)).max() for v in (a[1], b[1]))
        return x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine or a[1] == b[1]

    n = len(rows)
    links = [{j for j in range(n) if j != i and near(rows[i], rows[j])} for i in range(n)]
    out = []
    for i in range(n):
        seen, front = {i}, [i]
        while front:
            front = [j for k in front for j in links[k] if j not in seen and not seen.add(j)]
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), low, rows[i][0] == low))
    return sorted(out, key=str)


def clusters(seed: int, d: int, n: int = 60) -> list[tuple]:
    """Vectors around a few centres, at spreads about the cosine, of any length; labels, copies and chains."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        centre = np.random.default_rng(1000 + i % 7).standard_normal(d)
        at = centre + rng.standard_normal(d) * rng.choice([0.01, 0.1, 0.14, 0.5])
        rows.append((i, (at * rng.choice([1, 1e-3, 1e150, 1e-150])).tolist(), int(rng.integers(0, 2))))
    # A path whose ends are far apart.
    step = np.eye(max(d, 2))[:2, :d] if d > 1 else np.ones((2, 1))
    rows += [(1000 + k, (np.cos(k * 0.15) * step[0] + np.sin(k * 0.15) * step[1]).tolist(), 5) for k in range(9)]
    return rows + [(2000 + k, rows[0][1], rows[0][2]) for k in range(5)]


@pytest.mark.parametrize(("d", "places", "whole"), [(64, 4096, 1024), (20, 5, 3), (8, 4096, 2), (3, 4, 1024)])
def test_against_all_pairs(spark, d, places, whole, monkeypatch):
    """Small parts make every cell meet in units; no link is lost or counted twice."""
    monkeypatch.setattr(vectors, "PLACES", places)
    monkeypatch.setattr(vectors, "WHOLE", whole)
    rows = clusters(d, d)
    got = vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_odd_rows(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.01]
    rows = [(1, a, 1), (1, a, 1), (1, b, 1), (None, b, 1), (2, a, None), (3, None, 1), (4, [], 1), (5, [0.0, -0.0], 1), (6, [1.0, None], 1), (7, [1.0, float("nan")], 1), (8, [float("inf"), 1.0], 1), (9, a, 2), (10, [*a, 0.0], 1), (None, [5.0, -5.0], 3), (11, [-0.0, 1.0], 4), (12, [0.0, 1.0], 4)]
    df = spark.createDataFrame([(*r, "x", 2) for r in rows], SCHEMA + ", node string, l int")
    assert sorted(map(tuple, vectors.near_duplicates(df).collect()), key=str) == plain(rows)
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    named = spark.createDataFrame([(1, a, "x"), (2, b, "x"), (3, a, "y")], "vec_id long, embedding array<float>, label string")
    assert sorted(map(tuple, vectors.near_duplicates(named).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 40), st.integers(0, 10_000))
def test_pigeonhole(d, seed):
    """Every pair at the cosine is within the radius of some block, and there its midpoint's cell is a cell of both."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((1, d))
    y = x + rng.standard_normal((1, d)) * rng.choice([0.01, 0.1, 0.2])
    z = vectors.unit(np.concatenate([x, y]))
    if z[0] @ z[1] < 0.98:
        return
    z = (z @ vectors.rotation(d)).astype(np.float32)
    hits = 0
    for k, (a, b, squared) in enumerate(vectors.blocks(d, 0.98)):
        if vectors._distance(z, np.array([0]), np.array([1]), a, b)[0] <= squared:
            hits += 1
            label = np.array([3, 3])
            mid = vectors._home((z[:1, a:b].astype(float) + z[1:, a:b]) / 2, label[:1], d, k, squared)[0]
            for r in (0, 1):
                assert sum((key[rows == r] == mid).sum() for rows, key in vectors._cells(z[:, a:b], label, d, k, squared)) == 1
    assert hits


def test_sql(spark):
    rows = [r for r in clusters(2, 16) if max(map(abs, r[1])) < 1e100 and max(map(abs, r[1])) > 1e-100]
    con = duckdb.connect()
    con.sql("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    assert sorted(con.sql(vectors.ORACLE_SQL).fetchall(), key=str) == plain(rows)
