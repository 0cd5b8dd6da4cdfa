"""Top-k, mixing, sharding, URL filter."""

from __future__ import annotations

import datetime
import itertools
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from catalogs import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_queries import check

from tessera.llm import common, mixing, queries, sharding, topk, urls


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_queries_with_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("blocks", [(2, 3), (8192, 4096)])
def test_topk(spark, blocks):
    rng = np.random.default_rng(2)
    vectors = {i: rng.integers(-2, 3, 6) / 4 for i in range(40)}
    vectors[7] = vectors[8] = vectors[9] = vectors[3]
    rows = [(i, v.tolist(), 1) for i, v in vectors.items()] + [(100, None, 1), (101, [1.0, None], 1), (102, [float("nan")], 1), (103, [], 1), (None, [1.0], 1), (5, vectors[5].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").select("vec_id", topk.quantized(F.col("embedding")).alias("terms"), "score")
    got = defaultdict(list)
    for r in topk.search(df.filter("vec_id % 5 = 0"), df, 3, *blocks).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ints = {i: np.floor(256 * v).astype(int) for i, v in vectors.items()} | {103: np.zeros(0, int)}
    dot = lambda a, b: int(sum(x * y for x, y in zip(a, b, strict=False)))
    for q in [i for i in ints if i % 5 == 0]:
        best = sorted((-dot(ints[q], v), i) for i, v in ints.items() if i != q)[:3]
        assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk.search(df.limit(0), df).count() == 0


def test_topk_of_large_components(spark):
    """Every finite component takes part; a score beyond a long counts as its limit."""
    big, top, one = float(1 << 21), (1 << 63) - 1, 256 * 256
    rows = [(0, [big, 1.0]), (1, [1.0, 0.0]), (2, [big, 0.0]), (3, [0.0, 2.0]), (4, [float(1 << 40), 0.0]), (5, [3e38, 0.0]), (6, [-3e38, 0.0]), (7, [0.0, 3e38])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", topk.quantized(F.col("embedding")).alias("terms"))
    got = [(r.query_id, r.vec_id, r.score) for r in topk.search(df.filter("vec_id in (0, 3, 6)"), df, 7).orderBy("query_id", "rank").collect()]
    assert got[:7] == [(0, 4, top), (0, 5, top), (0, 7, top), (0, 2, one << 42), (0, 1, one << 21), (0, 3, 2 * one), (0, 6, -top - 1)]
    assert got[7:14] == [(3, 7, top), (3, 0, 2 * one), (3, 1, 0), (3, 2, 0), (3, 4, 0), (3, 5, 0), (3, 6, 0)]
    assert [g[1:] for g in got[14:]] == [(3, 0), (7, 0), (0, -top - 1), (1, -top - 1), (2, -top - 1), (4, -top - 1), (5, -top - 1)]


def test_topk_of_components_in_the_millions_against_sql(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-4_000_000, 4_000_000, 8) * (1.0 if i % 3 else 1e-7)).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    con = duckdb.connect()
    vectors = df.select("vec_id", topk.quantized(F.col("embedding")).alias("terms"))
    con.register("embeddings", df.toArrow())
    want = con.sql(topk.ORACLE_SQL).fetchall()
    got = topk.search(vectors.filter("vec_id % 50 = 0"), vectors).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 15


def test_topk_of_a_repeated_id(spark):
    """Rows of one vec_id with other terms are candidates of their own, and queries of their own."""
    rows = [(0, [1.0]), (0, [2.0]), (1, [1.0]), (1, [3.0]), (1, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, terms array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(df.filter("vec_id = 0"), df).collect())
    assert got == [(0, 1, 1, 3), (0, 1, 1, 6), (0, 2, 1, 1), (0, 2, 1, 2)]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 30), st.integers(1, 5), min_size=1, max_size=7), st.integers(0, 200), st.sampled_from([5, 60, 1 << 16]))
def test_fit(lengths, budget, exact):
    taken = mixing.fit(list(lengths), list(lengths.values()), budget, exact)
    assert all(0 <= t <= c for t, c in zip(taken, lengths.values(), strict=True))
    total = sum(n * t for n, t in zip(lengths, taken, strict=True))
    assert total <= budget
    if exact == 1 << 16 and len(set(lengths)) == 1:
        assert total == min(max(lengths) * max(lengths.values()), budget // max(1, max(lengths)) * max(lengths)) or not max(lengths)


def test_fit_is_exact_on_the_rest():
    assert mixing.fit([7, 5, 3], [4, 4, 4], 31) and sum(a * b for a, b in zip([7, 5, 3], mixing.fit([7, 5, 3], [4, 4, 4], 31), strict=True)) == 31


def test_share_out():
    assert mixing.share_out([10, 100, 100], [3, 1, 2], 315) == pytest.approx([20, 295 / 3, 590 / 3])
    rng = np.random.default_rng(4)
    for _ in range(50):
        sizes, weights = rng.integers(0, 50, 7).tolist(), rng.integers(1, 4, 7).tolist()
        total = float(rng.uniform(0, 2 * sum(sizes)))
        got = mixing.share_out(sizes, weights, total)
        level = max((t / w for t, w, n in zip(got, weights, sizes, strict=True) if t < 2 * n), default=None)
        assert sum(got) == pytest.approx(total) and all(t <= 2 * n + 1e-9 for t, n in zip(got, sizes, strict=True))
        assert level is None or all(t == pytest.approx(min(level * w, 2 * n)) for t, w, n in zip(got, weights, sizes, strict=True))
    assert mixing.share_out([1, 1], [3, 1], 4) == [2, 2] and mixing.share_out([], [], 0) == [] and mixing.share_out([0, 4], [3, 1], 6) == [0, 6]


def test_mix(spark, odd, empty):
    rows = [(i, "w " * (i % 37 + 1), f"s{i % 4}") for i in range(400)] + [(1000 + i, "w " * 12, None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got, again = (sorted(map(tuple, mixing.mix(d).collect())) for d in (docs, docs.repartition(2)))
    assert got == again and len(got) == 700
    sums: Counter = Counter()
    for _, source, size, source_size, target, copies, taken in got:
        assert copies in (0, 1, 2) and taken == copies * size and target <= 2 * source_size
        sums[source, target] += taken
    assert all(-1 < t - n < (2 if s else 12) for (s, t), n in sums.items())  # without a source all have 12 words
    assert sum(t for _, t in sums) == pytest.approx(1.5 * sum(r[2] for r in got))
    assert Counter(r.doc_id for r in mixing.apply_mix(docs).collect()) == {r[0]: r[5] for r in got if r[5]}
    assert mixing.mix(odd).count() == 11 and mixing.apply_mix(odd).columns == odd.columns
    assert mixing.mix(empty).count() == 0 == mixing.apply_mix(empty).count()


def test_copies_of_rows_of_one_id(spark):
    """Rows that share an id, none of them or all columns are taken as often as planned together."""
    rows = [(None, " ".join(["w"] * (i + 1)), "a", i) for i in range(12)] + [(7, "x y z", "b", i % 3) for i in range(9)] + [(8, "one more", "b", 0)] * 25_001 + [(9, None, "b", 0)] * 3 + [(9, "", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(4)
    got = Counter(map(tuple, mixing.apply_mix(docs).collect()))
    assert got[9, None, "b", 0] == 3 and got[9, "", "b", 0] == 1
    for source in "ab":
        planned = sum(r.taken for r in mixing.mix(docs).filter(F.col("source") == source).collect())
        assert sum(n * len((t or "").split()) for (_, t, s, _), n in got.items() if s == source) == planned > 0
    assert all(n <= 2 * m for r, m in Counter(rows).items() for n in [got[r]])


@pytest.mark.parametrize("seed", range(40))
def test_fit_against_all_sums(seed):
    """The taken lengths come as near to the budget as any choice does, by all sums that there are."""
    rng = np.random.default_rng(seed)
    lengths = sorted(map(int, rng.choice(np.arange(1, 60), int(rng.integers(1, 6)), replace=False)))
    counts = [int(c) for c in rng.integers(1, 4, len(lengths))]
    budget = int(rng.integers(0, sum(a * c for a, c in zip(lengths, counts, strict=True)) + 1))
    sums = {sum(n * a for n, a in zip(some, lengths, strict=True)) for some in itertools.product(*(range(c + 1) for c in counts))}
    taken = mixing.fit(lengths, counts, budget)
    assert all(0 <= n <= c for n, c in zip(taken, counts, strict=True))
    best = max(x for x in sums if x <= budget)
    assert sum(int(n) * a for n, a in zip(taken, lengths, strict=True)) == best


def test_shard(spark, odd, empty):
    rows = [(i, f"text {i % 90}" if i % 3 else "hot") for i in range(3001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shard(docs).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, sharding.shard(docs.repartition(3)).collect()))
    few = sharding.shard(odd).collect()
    assert len(few) == 11 and {r.size for r in few if r.doc_id in (2, 3)} == {1} and sharding.shard(empty).count() == 0


def test_placement_walks_clockwise():
    counts = {c: c % 5 for c in range(sharding.CELLS)}
    runs = sharding.place(counts, 7)
    assert sum(r["b"] - r["a"] for r in runs) == sum(counts.values())
    assert sharding.place({}, 3) == []
    loose, grown = ({(r["c"], k): r["s"] for r in sharding.place(counts, n, slack=0.2) for k in range(r["a"], r["b"])} for n in (16, 17))
    assert sum(loose[k] != grown[k] for k in loose) < 0.35 * len(loose)
    assert max(Counter(loose.values()).values()) <= 1.2 * len(loose) / 16 + 1


def test_urls(spark):
    day = datetime.date
    entries = [("a.com", day(2024, 1, 1), "add", "x"), ("a.com", day(2024, 2, 1), "remove", "x"), ("A.com/p", day(2024, 1, 5), "add", "y"), ("b.org", day(2024, 1, 1), "add", "z"), ("b.org", day(2024, 1, 1), "remove", "z"), (None, day(2024, 1, 1), "add", "n"), ("c.net", None, "add", "n")]
    captures = [(1, "http://www.a.com/q", day(2024, 1, 1)), (2, "https://u@www.A.com:80/p/q?x#y", day(2024, 1, 31)), (3, "http://a.com/", day(2024, 2, 1)), (4, "http://xa.com", day(2024, 1, 3)), (5, None, day(2024, 1, 3)), (6, "", None), (7, "nonsense", day(2024, 1, 3)), (8, "http://b.org/", day(2024, 1, 1)), (9, "http://a.com/p", day(2025, 1, 1)), (9, "http://a.com/p", day(2025, 1, 1))]
    df = spark.createDataFrame(captures, "capture_id long, url string, fetched date").withColumn("key", F.lit("x"))
    listed = spark.createDataFrame(entries, "key string, day date, action string, reason string")
    got = {r.capture_id: (r.blocked, r.n_hits, r.reasons) for r in urls.judge(df, listed).collect()}
    no = (False, 0, "")
    assert got == {1: (True, 1, "x"), 2: (True, 2, "x,y"), 3: no, 4: no, 5: no, 6: no, 7: no, 8: no, 9: (True, 2, "y")}
    assert not urls.judge(df, listed.limit(0)).filter("blocked").count() and urls.judge(df.limit(0), listed).count() == 0


def test_urls_of_addresses_ports_and_case(spark):
    entries = spark.sql("SELECT * FROM VALUES ('[2001:db8::1]/A', date '2024-01-01', 'add', 'six'), ('10.0.0.7', date '2024-01-01', 'add', 'four'), ('0.7', date '2024-01-01', 'add', 'never'), ('Example.com/Big/Path', date '2024-01-01', 'add', 'case') AS t(key, day, action, reason)")
    pages = ["http://[2001:DB8::1]:8080/a/b", "http://[2001:db8::2]/a", "https://me:pw@10.0.0.7:99/x?y", "http://10.0.0.8/", "ftp://www.EXAMPLE.com.:21/big//PATH/x#f", "http://example.com/big"]
    df = spark.createDataFrame([(i, u, datetime.date(2024, 5, 1)) for i, u in enumerate(pages)], "capture_id long, url string, fetched date")
    assert {r.capture_id: r.reasons for r in urls.judge(df, entries).collect()} == {0: "six", 1: "", 2: "four", 3: "", 4: "case", 5: ""}


def test_urls_of_deep_keys(spark):
    """A key of any number of path parts is found, and those below it are not."""
    entries = spark.sql("SELECT * FROM VALUES ('example.com/a/b/c/d', date '2024-01-01', 'add', 'deep'), ('b.org', date '2024-01-01', 'add', 'flat') AS t(key, day, action, reason)")
    pages = ["http://example.com/a/b/c/d", "http://www.example.com/A/b/c/d/e/f?x", "http://example.com/a/b/c", "http://example.com/a/b/c/de", "http://b.org/1/2/3/4/5/6"]
    df = spark.createDataFrame([(i, u, datetime.date(2024, 5, 1)) for i, u in enumerate(pages)], "capture_id long, url string, fetched date")
    got = {r.capture_id: r.reasons for r in urls.judge(df, entries).collect()}
    assert got == {0: "deep", 1: "deep", 2: "", 3: "", 4: "flat"}


def test_numbers_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "CHUNK", 7)
    rows = spark.createDataFrame([(None, "a")] * 50 + [(1, "a")] * 8 + [(2, None)], "i int, t string").repartition(4)
    got = [tuple(r) for r in common.numbered(rows, "k").collect()]
    assert sorted(got, key=str) == sorted([(None, "a", k) for k in range(50)] + [(1, "a", k) for k in range(8)] + [(2, None, 0)], key=str)


def test_many_equal_rows_are_dealt(spark):
    """A hundred thousand equal rows are ranked in many buckets, and mixed and placed like any others."""
    docs = spark.range(100_300).select(F.when(F.col("id") >= 300, -1).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") >= 300, "same words here").otherwise(F.concat(F.lit("text "), "id")).alias("text"), F.lit("s").alias("source"))
    got = sharding.shard(docs)
    by = {r.shard: (r.n, r.top) for r in got.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top")).collect()}
    assert sum(n for n, _ in by.values()) == 100_300 and {n for n, _ in by.values()} <= {6268, 6269} and all(top == n - 1 for n, top in by.values())
    mixed = mixing.mix(docs)
    assert mixed.agg(F.sum("taken")).first()[0] == round(1.5 * (300_000 + 600))
    rows = mixed.select("doc_id", "source", "size").withColumn("n", F.lit(100_300)).repartition(4)
    ranks = common.ranked(common.numbered(rows, "k").withColumn("u", common.unit(F.col("doc_id"), F.col("k"), seed=1)), ["source"], "n", "u", ["doc_id", "k"], "r")
    assert ranks.agg(F.countDistinct("r"), F.max("r")).first()[:2] == (100_300, 100_299)


def test_placement_is_a_walk_key_by_key():
    """place() against a walk that carries each key on its own around the ring."""
    rng = np.random.default_rng(6)
    for shards, slack in ((3, 0.0), (7, 0.1), (16, 0.0)):
        counts = {int(c): int(n) for c, n in zip(rng.choice(sharding.CELLS, 200, replace=False), rng.integers(1, 9, 200), strict=True)}
        points, total = sharding.ring(shards), sum(counts.values())
        room = [total // shards + (s < total % shards) if not slack else -int(-(1 + slack) * total // shards) for s in range(shards)]
        used, want = [0] * shards, []
        for cell in sorted(counts):
            for rank in range(counts[cell]):
                clockwise = [s for at, s in points if at >= cell] + [s for at, s in points if at < cell]
                s = next(s for s in clockwise if used[s] < room[s])
                want.append((cell, rank, s, used[s]))
                used[s] += 1
        got = [(r["c"], k, r["s"], r["t"] + k - r["a"]) for r in sharding.place(counts, shards, slack) for k in range(r["a"], r["b"])]
        assert sorted(got) == sorted(want)


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    class Context:
        master, applicationId = "spark://somewhere", "x"

    class Session:
        conf, sparkContext = spark.conf, Context()

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError, match="checkpoint"):
            common.scratch(Session())
    assert common.scratch(spark) == common.scratch(spark)


def test_odd_urls_and_a_list_of_the_captures_themselves(spark):
    """Without a scheme a URL has no host; percent-encoded paths are compared as they are written; the rule lists keys of the captures alone, and the same ones again."""
    day = datetime.date(2024, 5, 1)
    urls_ = ["no-scheme.example.com/a", "//no-scheme.example.com/a", "http://x.example.com/a%20b/c", "http://x.example.com/a b/c", "HTTP://X.example.com./A%20B", None, ""]
    df = spark.createDataFrame([(i, u, day) for i, u in enumerate(urls_)], "capture_id long, url string, fetched date")
    entries = spark.createDataFrame([("no-scheme.example.com", day, "add", "host"), ("x.example.com/a%20b", day, "add", "coded")], "key string, day date, action string, reason string")
    assert {r.capture_id: r.reasons for r in urls.judge(df, entries).collect()} == {0: "", 1: "", 2: "coded", 3: "", 4: "coded", 5: "", 6: ""}
    many = spark.createDataFrame([(f"http://h{i % 40}.example.com/a{i % 7}/b{i % 3}/c/d",) for i in range(300)], "url string")
    found = sorted(map(tuple, urls.entries_of(many).collect()), key=str)
    assert found == sorted(map(tuple, urls.entries_of(many.repartition(3).union(many)).collect()), key=str) and len({r[0] for r in found}) > 50
    assert all(r[0].endswith(("example.com", "com")) or r[0].split("/")[0].endswith("example.com") for r in found) and max(r[0].count("/") for r in found) == 3
