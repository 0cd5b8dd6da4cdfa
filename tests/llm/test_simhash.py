from __future__ import annotations

import itertools

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import simhash


def plain(text: str | None) -> int:
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    rows = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    hs = [xxhash.xxh64_intdigest(b" ".join(r), seed=42) for r in rows]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(fps: dict) -> dict:
    found = {i: i for i in fps}
    for _ in fps:
        for a, b in itertools.combinations(fps, 2):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                found[a] = found[b] = min(found[a], found[b])
    return found


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="abAB É\t\x1c\n", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) % (1 << 64) == plain(text)


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks(3)
    assert len(masks) == 15
    for flips in itertools.chain(itertools.combinations(range(64), 3), itertools.combinations(range(64), 1)):
        assert any(not any((m >> f) & 1 for f in flips) for m in masks)


@pytest.mark.parametrize("bucket", [4096, 3])
def test_classes_by_either_way(spark, bucket):
    """A chain of near fingerprints, a dense ball, and strangers; small buckets go by shared points."""
    base = 0x0123456789ABCDEF
    fps = [base, base ^ 0b111, base ^ 0b111111, base ^ 0b111111 << 6]
    fps += [(1 << 40) ^ (1 << i) for i in range(12)] + [0x5555555555555555, 0]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.fingerprint_links(df, bucket=bucket)).collect()}
    want = classes(dict(enumerate(fps)))
    for (i, a), (j, b) in itertools.combinations(enumerate(signed), 2):
        assert (roots.get(a, a) == roots.get(b, b)) == (want[i] == want[j])


def test_long_chain(spark):
    pairs = [(i + 1, i) for i in range(200)] + [(500, 400)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {400: 400, 500: 400}


def test_odd_documents(spark, odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 11 and simhash.near_duplicates(empty).count() == 0 == simhash.near_dedup(empty).count()
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert all(r.fp % (1 << 64) == plain(texts[r.doc_id]) for r in got)
    by = {r.doc_id: r.component_id for r in got}
    want = classes({i: plain(t) for i, t in texts.items() if i is not None})
    assert {i: c for i, c in by.items() if i is not None} == want
    kept = simhash.near_dedup(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))


def test_rows_of_odd_ids(spark):
    """Only members of one class replace each other, whatever their ids."""
    rows = [(None, "first text without an id"), (None, "second words that name no id"), (4, "the text of a document"), (None, "the text of a document"), (5, "one text under five"), (5, "some other words under five"), (5, "one text under five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, simhash.near_dedup(docs).collect()), key=str)
    assert got == sorted({rows[i] for i in (0, 1, 2, 4, 5)}, key=str)
