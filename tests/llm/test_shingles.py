"""Near copies by 5-word shingles."""

from __future__ import annotations

import itertools

import corpus_pipeline
import numpy as np
import pytest
from catalogs import DATA

from tessera.llm import shingles


def plain(rows) -> list[set]:
    """Classes of row numbers by brute force."""
    found = []
    for _, t in rows:
        words = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        found.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if found[a] == found[b] or 5 * len(found[a] & found[b]) >= 4 * len(found[a] | found[b]) > 0:
            old, new = root[b], root[a]
            root = [new if r == old else r for r in root]
    return [{i for i, r in enumerate(root) if r == c} for c in set(root)]


def edited() -> list[tuple]:
    """Texts with 1 to 6 changed words at similarities around 0.8, chains of them, and strangers."""
    rng = np.random.default_rng(3)
    word = lambda: "w" + str(rng.integers(0, 5000))
    rows = []
    for i in range(40):
        words = [word() for _ in range(int(rng.integers(20, 250)))]
        for _ in range(int(rng.integers(1, 4))):
            rows.append((len(rows), " ".join(words)))
            for k in rng.integers(0, len(words), int(rng.integers(0, 7))):
                words[k] = word()
    return rows


@pytest.mark.parametrize(("bucket", "weight"), [(4096, 1 << 20), (2, 1 << 20), (4096, 150)])
def test_classes(spark, bucket, weight):
    rows = [*edited(), (900, None), (901, " \t"), (902, "a b"), (903, "A  b"), (None, "not near to any of these at all"), (None, "another one without an id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got: dict = {}
    for r in shingles.classes(docs, bucket=bucket, weight=weight).join(docs.withColumn("h", shingles.text_hash()), "doc_id").collect():
        got.setdefault(r["class"], set()).add(r.doc_id)
    want = [{rows[i][0] for i in c} for c in plain(rows) if rows[min(c)][0] is not None]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want)) and any(len(c) > 2 for c in want)


def test_fingerprints_propose(spark):
    """Sets whose fingerprints are within the radius share a key, by brute force, and no others do."""
    rows = [(i, t) for i, t in edited()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    first = shingles.sets(docs).select("sig", "n", "fp").distinct()
    got: dict = {}
    for r in shingles.by_fingerprint(first).join(first, "sig").collect():
        got.setdefault(r.key, set()).add(r.fp & (1 << 64) - 1)
    prints = {r.fp & (1 << 64) - 1 for r in first.collect()}
    near = lambda a: {b for b in prints if (a ^ b).bit_count() <= 3}
    for group in got.values():
        seen, front = set(), {min(group)}
        while front:
            seen |= front
            front = set().union(*map(near, front)) - seen
        assert seen == group
    assert sum(map(len, got.values())) == len(prints)


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_stage(spark):
    """Near copies of 7 and 11 differing fingerprint bits go too."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    kept = corpus_pipeline.drop_near_copies(spark, docs, str(DATA))
    assert kept.dtypes == docs.dtypes
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(rows[i][0] for i in c) for c in plain(rows))


def test_rows_of_odd_ids(spark, odd, empty):
    """Only members of one class replace each other, whatever their ids."""
    rows = [(None, "first text without an id"), (None, "second text without an id"), (4, "the text of a document"), (None, "the text of a document"), (5, "one text under five"), (5, "other text under five"), (5, "one text under five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, shingles.near_dedup(docs).collect()), key=str)
    assert got == sorted({rows[i] for i in (0, 1, 2, 4, 5)}, key=str)
    assert shingles.near_dedup(odd).columns == odd.columns and shingles.near_dedup(odd).count() == 7
    assert shingles.near_dedup(empty).count() == 0
