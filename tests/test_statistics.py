"""Counts of codes against plain counters; parts that merge; counts that are kept beside a catalog."""

from __future__ import annotations

import math
from collections import Counter

import catalogs
import pytest

from tessera.functions.layout import Partition
from tessera.operators import statistics
from tessera.plans import bookkeeping
from tessera.plans.job import tokenize_catalog
from tessera.sources.catalog import open_catalog

ROWS = [(1, [5, 5, 6], 7), (1, [], None), (1, None, 7), (2, [6, None], 8), (2, [9] * 1000, 8), (3, None, None), (None, [1], 1)]
SCHEMA = "p int, many struct<token: array<int>>, one long, text string"


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(p, None if t is None else (t,), o, "x") for p, t, o in rows], SCHEMA)


def plain(token_lists) -> tuple:
    codes = Counter(c for t in token_lists if t is not None for c in t)
    n = codes.total()
    top = min(codes, key=lambda c: (-codes[c], c is not None, c or 0)) if codes else None
    entropy = -sum(k / n * math.log2(k / n) for k in codes.values()) if n else None
    return len(token_lists), sum(t is None for t in token_lists), n, len(codes), None if entropy is None else round(abs(entropy), 9), top, codes[top] if codes else None


def told(df) -> dict:
    return {(r.pixel, r.column): (r.rows, r.nulls, r.tokens, r.codes, None if r.entropy is None else round(r.entropy, 9), r.top, r.top_n) for r in df.collect()}


def test_counts(spark):
    df = frame(spark).selectExpr("*", "0 AS o")
    got = told(statistics.summary(statistics.part(df, ["many", "one"], ("o", "p"))))
    want = {}
    for p in (1, 2, 3, None):
        want[p, "many"] = plain([t for q, t, _ in ROWS if q == p])
        want[p, "one"] = plain([None if o is None else [o] for q, _, o in ROWS if q == p])
    assert got == want
    whole = told(statistics.summary(statistics.whole(statistics.part(df, ["many"], ("o", "p")))))
    assert whole == {(None, "many"): plain([t for _, t, _ in ROWS])} == told(statistics.summary(statistics.part(df, ["many"])))
    assert [r.used for r in statistics.summary(statistics.part(df, ["one"]), 6).collect()] == [0.5]
    with pytest.raises(ValueError, match="text"):
        statistics.part(df, ["text"])
    assert statistics.summary(statistics.part(df.limit(0), ["one"])).count() == 0


def test_parts_merge(spark):
    df = frame(spark)
    parts = [statistics.part(df.filter(f"coalesce(p, 0) = {p}"), ["many", "one"]) for p in range(4)]
    key = lambda d: sorted(map(str, map(tuple, d.select("order", "pixel", "column", "what", "code", "n").collect())))
    assert key(statistics.merge(*parts)) == key(statistics.merge(statistics.merge(parts[3], parts[1]), parts[0], parts[2])) == key(statistics.part(df, ["many", "one"]))


def test_kept_beside_a_catalog(spark, tmp_path):
    """Only what is new is counted, and what was replaced is counted anew."""
    root = catalogs.make(tmp_path / "in")
    go = lambda **how: tokenize_catalog(spark, root, tmp_path / "out", ["ebv", "flux_g"], finalize=True, **how)
    go(max_partitions=2)
    columns = ["tok_ebv", "tok_flux_g"]
    made = lambda: open_catalog(spark, tmp_path / "out")
    assert bookkeeping.record(made(), columns) == 2 and bookkeeping.record(made(), columns) == 0
    go()
    got = told(bookkeeping.token_statistics(made(), columns))
    assert got[None, "tok_ebv"][:2] == (22, 0) and got[None, "tok_flux_g"][:2] == (22, 3) and bookkeeping.record(made(), columns) == 0
    before = {k: v for k, v in told(bookkeeping.token_statistics(made(), columns, by_partition=True)).items()}
    go(partitions=[Partition(5, 1239)], overwrite=True)
    assert bookkeeping.record(made(), columns) == 1
    assert told(bookkeeping.token_statistics(made(), columns, by_partition=True)) == before and len(before) == 6
    assert told(bookkeeping.token_statistics(made(), columns)) == got


def test_rows_beside_their_tokens(spark, tmp_path):
    """Files of other row groups in step; what has drifted is told, whether by number or by value."""
    import pyarrow.parquet as pq

    from tessera.sources.joined import beside

    root = catalogs.make(tmp_path / "in")
    report = tokenize_catalog(spark, root, tmp_path / "out", ["ebv", "image"], row_group_size=3, batch_size=3)
    assert report.metrics == {"rows": 22, "errors": 0, "nulls of tok_ebv": 0, "nulls of tok_image": 3}
    source, tokens = (open_catalog(spark, tmp_path / x) for x in ("in", "out"))
    both = beside(source, tokens, ["object_id", "ebv"], ["tok_ebv"], check=["object_id", "flux_g"])
    want = {r.object_id: (r.ebv, r.tok_ebv) for r in tokens.read(columns=["object_id", "ebv", "tok_ebv"]).collect()}
    got = both.collect()
    assert {r.object_id: (r.ebv, r.tok_ebv) for r in got} == want and len(got) == 22
    plan = beside(source, tokens, ["object_id"], ["tok_ebv"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Exchange hashpartitioning(order") == 1  # of the list of partitions
    assert beside(source, tokens, ["object_id"], ["tok_ebv"], partitions=[Partition(5, 1239)]).count() == 7
    with pytest.raises(ValueError, match="no Norder=9"):
        beside(source, tokens, ["object_id"], ["tok_ebv"], partitions=[Partition(9, 1)])
    with pytest.raises(ValueError, match="both sides"):
        beside(source, tokens, ["ebv"], ["ebv"])
    p = tmp_path / "in/dataset" / Partition(5, 1239).file
    held = pq.read_table(p)
    pq.write_table(held.take([1, 0, *range(2, 7)]), p)
    with pytest.raises(Exception, match="object_id differs in rows 0 to"):
        beside(source, tokens, ["ebv"], ["tok_ebv"], check=["object_id"]).collect()
    pq.write_table(held.slice(1), p)
    with pytest.raises(Exception, match="has 6 rows and tokens of 7"):
        beside(source, tokens, ["object_id"], ["tok_ebv"]).collect()
