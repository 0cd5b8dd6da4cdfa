"""Repeated passages, toxicity, the pipeline."""

from __future__ import annotations

import hashlib
import os
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from catalogs import DATA
from pyspark.sql import functions as F
from test_shingles import plain as classes
from test_text import OURS, ids

from tessera.llm import suffixes, toxicity


def plain(rows, length=200):
    counts: Counter = Counter()
    for _, t in rows:
        counts.update(t[i : i + length] for i in range(len(t) - length + 1))
    out = []
    for key, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        out.append((key, len(t), sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), kept))
    return sorted(out, key=str)


def ours(docs, **options):
    got = suffixes.dedup(docs, **options)
    return sorted((tuple(r) for r in got.select("doc_id", *got.columns[-4:]).collect()), key=str)


def passages():
    rng = np.random.default_rng(4)
    word = lambda n: bytes(rng.integers(97, 123, n).astype("u1")).decode()
    shared = [word(n) for n in (199, 200, 201, 330, 700)]
    rows = [(i, word(int(rng.integers(0, 300))) + "".join(shared[k] + word(3) for k in rng.choice(5, 2)) + word(50)) for i in range(30)]
    return [*rows, (90, "ab" * 400), (91, "q" * 450), (92, "x" + "q" * 199), (93, shared[4][100:600]), (94, "é" * 150), (95, "zé" + "é" * 120), (96, ""), (97, None)]


@pytest.mark.parametrize("bucket", [4096, 2])
def test_passages(spark, bucket):
    rows = passages()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert ours(docs, bucket=bucket) == plain([(i, (t or "").encode()) for i, t in rows])


def test_pieces_and_batches(spark, monkeypatch):
    """Long texts are looked at in pieces, and groups of runs in batches."""
    monkeypatch.setattr(suffixes, "PIECE", 150)
    text = passages()[0][1].encode()
    whole = suffixes.runs(text * 3)
    assert sum(b - a + 1 for a, b in zip(whole[2], whole[3], strict=True)) == len(text) * 3 - 199
    assert all(a[0] == b[0] + 1 for a, b in zip(np.stack(whole[2:])[:, 1:].T, np.stack(whole[2:])[::-1, :-1].T, strict=True))


def test_refinement_settles_repeats():
    """refine() and identifiers() against counts of whole windows, whatever the depth to begin with."""
    rng = np.random.default_rng(8)
    for _ in range(30):
        base = bytes(rng.integers(97, 99, 90).astype("u1"))
        texts = [base[int(a) : int(a) + int(n)] for a, n in zip(rng.integers(0, 30, 6), rng.integers(20, 60, 6), strict=True)]
        number = rng.integers(1, 3, 6)
        counts: Counter = Counter()
        for t, n in zip(texts, number, strict=True):
            for i in range(len(t) - 19):
                counts[t[i : i + 20]] += int(n)
        for depth in (1, 3, 8, 20):
            of, offset, equal, at = suffixes.refine(texts, number, 20, depth)
            windows = [texts[k][i : i + 20] for k, i in zip(of, offset, strict=True)]
            assert equal.tolist() == [counts[w] > 1 for w in windows]
            names = suffixes.identifiers(texts, 20, depth)[at].tolist()
            assert len(set(zip(names, windows, strict=True))) == len(set(names)) == len(set(windows))


def test_passages_of_odd_documents(odd, empty):
    rows = [(r.doc_id, (r.text or "").encode()) for r in odd.select("doc_id", "text").collect()]
    assert ours(odd) == plain(rows)
    assert suffixes.dedup(empty).count() == 0


def toy(n: int, seed: int):
    """Clean texts, and ones with a few of the words that the toy labels mark."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"{a}{b}" for a in ("ba", "ko", "li", "mun", "sa") for b in ("rin", "to", "ve", "lor", "d", "x")]
    out = []
    for i in range(n):
        words = list(rng.choice(vocabulary, int(rng.integers(5, 200))))
        bad = i % 3 == 0
        for _ in range(int(rng.integers(1, 4)) if bad else 0):
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(["snark", "boojum", "jabberx", "jabbery"])))
        out.append((i, " ".join(words), int(bad)))
    return out


def test_toxicity_on_held_out_rows(spark):
    rows = toy(400, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    network = toxicity.train(docs, labels)
    got = {r.doc_id: r.score_1 for r in toxicity.score(docs, network).collect()}
    rest = [(got[i] >= 0.5, bool(y)) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(rest) > 50 and np.mean([a == b for a, b in rest]) > 0.9
    again = toxicity.score(docs.repartition(3), toxicity.train(docs.repartition(2), labels))
    assert {r.doc_id: pytest.approx(r.score_1, abs=1e-5) for r in again.collect()} == got
    # A bad word far into a long text counts as much as one at its start.
    clean = rows[1][1]
    long = toxicity.Scorer(network).score([" ".join([clean] * 50), " ".join([clean] * 50) + " snark boojum snark", "", None, "..."])
    assert long[0] < 0.5 <= long[1] and len(set(long[2:])) == 1


def test_toxicity_learns_from_no_held_out_label(spark):
    rows = toy(120, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert all(np.array_equal(a, b) for a, b in zip(toxicity.train(docs, labels).p.values(), toxicity.train(docs, other).p.values(), strict=True))


def test_toxicity_is_the_same_for_any_number_of_threads():
    """A fit to enough words that a library would multiply them in several threads."""
    code = """
import hashlib, numpy as np
from tessera.llm import toxicity
rng = np.random.default_rng(1)
texts = [rng.integers(0, 9000, 150) for _ in range(120)]
labels = np.arange(120) % 2
for i in np.flatnonzero(labels):
    texts[i][7] = 5
network = toxicity.Network().fit(texts, [f"w{i}" for i in range(9000)], labels)
scores = toxicity.Scorer(network).score([" ".join(f"w{j}" for j in t) for t in texts] * 8)
print(hashlib.sha256(b"".join(network.p[k].tobytes() for k in sorted(network.p)) + scores.tobytes()).hexdigest(), (scores[:120] >= 0.5).sum())
"""
    env = lambda n: {**os.environ, **dict.fromkeys(("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS"), n)}
    said = [subprocess.run([sys.executable, "-c", code], env=env(n), cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True).stdout.split()[-2:] for n in ("1", "4")]
    assert said[0] == said[1] and said[0][1] == "60"


def test_toxicity_of_odd_documents(spark, odd, empty):
    labels = spark.createDataFrame([(0, 1), (1, 1), (1, 0), (5, 0), (6, None), (None, 1), (7, 0), (8, 0), (99, 1)], "doc_id long, toxic int")
    got = toxicity.score(odd, toxicity.train(odd, labels)).collect()
    assert len(got) == 11 and all(0 <= r.score_1 <= 1 for r in got)
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0
    assert {r.h for r in odd.select(toxicity.held_out(F.col("doc_id")).alias("h")).collect()} <= {True, False}
    assert toxicity.score(odd, toxicity.train(odd, labels.limit(0))).filter("score_1 >= 0.5").count() == 0


def test_windows_cover_every_word():
    for n in (0, 1, 39, 40, 41, 72, 73, 1000):
        starts = toxicity.windows_of(n)
        assert starts[0] == 0 and starts[-1] + toxicity.WINDOW >= n and (np.diff(starts) == toxicity.STRIDE).all()


def test_gradients():
    rng = np.random.default_rng(0)
    net, words = toxicity.Network(), ["", "abc", "idea", "the", "foo"]
    for k, n in (("word", 5), ("gram", 9)):
        net.p[k], net.row[k] = rng.standard_normal((n, 8)).astype("f4") * 0.3, rng.integers(0, n, len(net.row[k]))
        net.p[k][0] = 0
    shown, windows, y = net.features(words), rng.integers(0, 6, (4, toxicity.WINDOW)), np.array([1, 0, 1, 0], "f4")
    grads = net.gradients(shown, windows, y)

    def loss() -> float:
        real = windows != 5
        real[:, 0] = True
        logit = net.pool(net.states(net.gates(net.inputs(shown)), windows), real)[0].astype(float)
        return float(np.mean(np.log1p(np.exp(logit)) - y * logit))

    for k in net.p:
        at = int(np.abs(grads[k]).argmax())
        flat = net.p[k].reshape(-1)
        old, ends = flat[at], []
        for step in (0.01, -0.01):
            flat[at] = old + step
            ends.append(loss())
        flat[at] = old
        assert (ends[0] - ends[1]) / 0.02 == pytest.approx(float(grads[k].reshape(-1)[at]), abs=2e-4)


def plain_score(net, text: str | None) -> float:
    """The network's equations one word and one window at a time."""
    words = toxicity.words_of(text)
    p, sig = {k: v.astype(float) for k, v in net.p.items()}, lambda x: 1 / (1 + np.exp(-x))

    def vector(word: str) -> np.ndarray:
        own, grams, _ = toxicity._hashed([word])
        return p["word"][net.row["word"][own[0]]] + toxicity.GRAM_WEIGHT * sum((p["gram"][net.row["gram"][g]] for g in grams), np.zeros(toxicity.EMBED))

    def pass_over(vectors: list, way: str) -> list:
        h, state, out = toxicity.HIDDEN, np.zeros(toxicity.HIDDEN), []
        for x in vectors:
            a, u = x @ p[f"x{way}"] + p[f"b{way}"], state @ p[f"h{way}"]
            z, r = sig(a[:h] + u[:h]), sig(a[h : 2 * h] + u[h : 2 * h])
            new = np.tanh(a[2 * h :] + r * u[2 * h :])
            state = (1 - z) * new + z * state
            out.append(state)
        return out

    tops = []
    for start in toxicity.windows_of(len(words)):
        shown = [vector(w) for w in words[start : start + toxicity.WINDOW]]
        states = [np.concatenate(x) for x in zip(pass_over(shown, "f"), pass_over(shown[::-1], "b")[::-1], strict=True)] or [np.zeros(2 * toxicity.HIDDEN)]
        e = np.exp([np.tanh(s @ p["aw"] + p["ab"]) @ p["av"] for s in states])
        tops.append(sum(w * s for w, s in zip(e / e.sum(), states, strict=True)) @ p["ow"] + p["ob"][0])
    return sig(max(tops) - net.level)


def test_scores_are_those_of_a_plain_forward_pass():
    rng = np.random.default_rng(1)
    net = toxicity.Network()
    net.level = 0.3
    for k, n in (("word", 50), ("gram", 90)):
        net.p[k], net.row[k] = rng.standard_normal((n, toxicity.EMBED)).astype("f4") * 0.5, rng.integers(0, n, len(net.row[k])) * (rng.random(len(net.row[k])) < 0.7)
        net.p[k][0] = 0
    texts = ["one two three", "", None, " ".join(f"word{i % 37}" for i in range(150)), "a", "Ünïcode straße " * 25]
    scorer = toxicity.Scorer(net)
    for _ in range(2):  # a second time from words that are known
        assert scorer.score(texts) == pytest.approx([plain_score(net, t) for t in texts], abs=1e-4)


def test_known_words_are_bounded(monkeypatch):
    """No more words are kept than the bound or one batch has, and scores don't depend on it."""
    net = toxicity.Network()
    rng = np.random.default_rng(2)
    net.p["word"], net.row["word"] = rng.standard_normal((50, toxicity.EMBED)).astype("f4"), rng.integers(0, 50, len(net.row["word"]))
    net.p["word"][0] = 0
    parts = [[" ".join(f"w{i * 30 + j}" for j in range(40))] for i in range(12)]
    want = [toxicity.Scorer(net).score(p)[0] for p in parts]
    monkeypatch.setattr(toxicity, "KNOWN_WORDS", 100)
    scorer, most, got = toxicity.Scorer(net), 0, []
    for p in parts:
        got.append(scorer.score(p)[0])
        most = max(most, len(scorer.known))
    assert got == want and most <= 100


def test_sample_is_bounded_by_bytes(spark):
    rows = toy(300, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    small, large = (toxicity.train(docs, labels, most=n) for n in (20_000, 1 << 20))
    assert not np.array_equal(small.p["ow"], large.p["ow"]) and np.array_equal(toxicity.train(docs, labels).p["ow"], large.p["ow"])


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, str(DATA))
    assert clean.dtypes == docs.dtypes and clean.count() > 0.7 * docs.count()
    apart = stages["near duplicates"](spark, clean, str(DATA))
    rows = [(r.doc_id, r.text) for r in clean.select("doc_id", "text").collect()]
    assert {r.doc_id for r in apart.collect()} == {min(rows[i][0] for i in c) for c in classes(rows)} and apart.dtypes == docs.dtypes
    cut = stages["repeated passages"](spark, apart, str(DATA))
    want = {k: kept.decode("utf-8", "ignore") for k, *_, kept in plain([(r.doc_id, r.text.encode()) for r in apart.collect()])}
    rows = cut.collect()
    assert cut.dtypes == docs.dtypes and {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)
    mixed = stages["source mix"](spark, cut, str(DATA))
    assert mixed.dtypes == docs.dtypes and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2
    last = stages["token ids"](spark, mixed, str(DATA)).collect()
    assert all(r.decodes and r.n_tokens == len(ids(r.ids)) for r in last)
    assert all(OURS.decode(r.ids) == want[r.doc_id] for r in last)
    key = lambda r: (r.doc_id, hashlib.sha256(r.ids).hexdigest())
    assert sorted(map(key, corpus_pipeline.run(spark, str(DATA)).collect())) == sorted(map(key, last))


def test_pipeline_of_odd_and_empty_tables(spark, odd, empty, tmp_path):
    spark.createDataFrame([(0, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, docs in (("odd", odd), ("empty", empty)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert (docs.count() > 0) == (name == "odd")
