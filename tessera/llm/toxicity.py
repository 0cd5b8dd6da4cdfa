"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as its own embedding plus those of its character n-grams, both hashed. Every place that
the labelled texts use has an embedding that is trained, under weight decay; those that tell the labels
apart start with how much they do, the others near zero, and places that are in few texts have none,
so no rare word is learned by heart. Two gated recurrent layers read each window of words, forwards and
backwards; attention pools their states and a logistic unit scores the window. A text's score is that
of its highest window, over overlapping windows of the whole text; equal windows are worked out once.
Training alternates between finding each labelled text's highest window and fitting the network to
these windows; the network is the mean of those of the last steps. Sums over many rows run in one fixed
order, so the number of threads that multiply matrices changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import extended, fresh, letting_go, prepare, table

WINDOW, STRIDE = 40, 32
HIDDEN, EMBED, ATTEND = 8, 8, 8
#: Hashed places of words and of character n-grams.
WORD_PLACES, GRAM_PLACES = 1 << 15, 1 << 15
GRAMS = (3, 4, 5)
#: The bounded sample that the network is fitted to: labelled rows of each label, by a seeded order, and
#: as many of these as begin within so many bytes of text.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 32 << 20
#: A place has an embedding if it is in so many labelled texts and in so large a share of them, or if its share
#: of texts differs between the labels by so many standard errors; then it starts with the difference. All
#: start with so much noise.
LEAST_TEXTS, LEAST_SHARE, LEAST_Z, NOISE = 4, 0.01, 4.0, 0.01
#: Weight decay of embeddings and of all else, per unit of the learning rate.
DECAY, DECAY_REST = 3.0, 0.05
#: Weight of the summed n-grams beside the word.
GRAM_WEIGHT = 0.3
ROUNDS, STEPS, BATCH = 6, 30, 128
#: The share of the steps, the last ones, whose parameters are averaged.
AVERAGED = 0.5
SEED = 3
#: A task forgets its known words before they are more than this, but for those of one batch; only speed and memory depend on it.
KNOWN_WORDS = 100_000
#: Windows scored together: few enough that their products are of a size that no library splits over threads.
TOGETHER = 1024
_WORD = re.compile(r"\w+")
_F = np.float32
_WEIGHTS = np.random.default_rng(9).integers(0, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of each word, places of all n-grams (with word borders), and the n-grams' words."""
    marked = [f"<{w}>" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of, ends = np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes)
    mult = np.uint64(0x9E3779B97F4A7C15)
    mixed = (codes + np.uint64(1)) * mult
    mixed ^= mixed >> np.uint64(29)
    within = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    whole = np.add.reduceat(mixed * ((within.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)), ends - sizes) if len(words) else mixed
    places, owner = [], []
    for n in GRAMS:
        at = np.flatnonzero(within + n <= sizes[of])
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h = (h ^ mixed[at + k]) * np.uint64(0x94D049BB133111EB)
        places.append(((h >> np.uint64(40)) % np.uint64(GRAM_PLACES)).astype(np.int64))
        owner.append(of[at])
    word = ((whole * mult) >> np.uint64(40)) % np.uint64(WORD_PLACES)
    return word.astype(np.int64), np.concatenate(places), np.concatenate(owner)


def _ranges(owner: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted array owner of each wanted number in turn, and how many each has."""
    first, per = np.searchsorted(owner, wanted), np.searchsorted(owner, wanted, "right")
    per = per - first
    return np.repeat(first - np.cumsum(per) + per, per) + np.arange(per.sum()), per


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each different window and every window's number among these, told apart by a weighted sum."""
    _, one, back = np.unique((ids.astype(np.uint64) * _WEIGHTS).sum(axis=1), return_index=True, return_inverse=True)
    return one, back


def windows_of(n: int) -> np.ndarray:
    """First word of every window; together they cover all words."""
    return np.arange(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return _F(0.5) * np.tanh(_F(0.5) * x) + _F(0.5)


def _times(rows: np.ndarray, small: np.ndarray) -> np.ndarray:
    """The product of any number of rows with a small matrix, summed in one order whatever the threads."""
    return np.einsum("ri,ij->rj", rows, small)


class Network:
    """Parameters by name; words become rows of gate inputs, so a window costs recurrences only.

    Row 0 of the embeddings is that of all places without one.
    """

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        d, h, a = EMBED, HIDDEN, ATTEND
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(_F)
        self.p = {
            "word": np.zeros((1, EMBED), _F), "gram": np.zeros((1, EMBED), _F),
            "xf": draw(d, 3 * h), "xb": draw(d, 3 * h), "hf": draw(h, 3 * h), "hb": draw(h, 3 * h), "bf": np.zeros(3 * h, _F), "bb": np.zeros(3 * h, _F),
            "aw": draw(2 * h, a), "ab": np.zeros(a, _F), "av": draw(a), "ow": draw(2 * h), "ob": np.zeros(1, _F),
        }
        #: Row of each place in the embeddings, 0: none.
        self.row = {"word": np.zeros(WORD_PLACES, np.int64), "gram": np.zeros(GRAM_PLACES, np.int64)}
        self.level = 0.0

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embedding row of each word; rows of all n-grams that have one, and their words."""
        word, gram, of = _hashed(words)
        rows = self.row["gram"][gram]
        has = np.flatnonzero(rows)
        has = has[np.argsort(of[has], kind="stable")]
        return self.row["word"][word], rows[has], of[has]

    def inputs(self, features: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        word, gram, of = features
        out = self.p["word"][word]
        if len(gram):
            first = np.flatnonzero(np.append(True, np.diff(of) > 0))
            out[of[first]] += _F(GRAM_WEIGHT) * np.add.reduceat(self.p["gram"][gram], first)
        return out

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input to the gates of both directions, with a last row for padding, which keeps the state."""
        out = []
        for d in "fb":
            pad = np.zeros((1, 3 * HIDDEN), _F)
            pad[0, :HIDDEN] = 40
            out.append(np.concatenate([_times(x, self.p[f"x{d}"]) + self.p[f"b{d}"], pad]).astype(_F))
        return tuple(out)

    def states(self, gates: tuple[np.ndarray, np.ndarray], ids: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (step, window, 2 * hidden) of both directions over the windows' word rows ids."""
        n, h = ids.shape[0], HIDDEN
        out = np.zeros((WINDOW, n, 2 * h), _F)
        for k, d in enumerate("fb"):
            u, state = self.p[f"h{d}"], np.zeros((n, h), _F)
            for t in range(WINDOW) if k == 0 else range(WINDOW - 1, -1, -1):
                x, hu = gates[k][ids[:, t]], state @ u
                zr = _sigmoid(x[:, : 2 * h] + hu[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                new = np.tanh(x[:, 2 * h :] + r * hu[:, 2 * h :])
                after = new + z * (state - new)
                if keep is not None:
                    keep.append((k, t, state, z, r, new, hu[:, 2 * h :]))
                state = after
                out[t, :, k * h : (k + 1) * h] = state
        return out

    def pool(self, states: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, ...]:
        """Logit of each window, and what the way back needs; real: (window, step) is no padding."""
        act = np.tanh(states @ self.p["aw"] + self.p["ab"])
        e = np.where(real.T, act @ self.p["av"], _F(-1e9))
        e = np.exp(e - e.max(axis=0))
        share = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", share, states)
        return pooled @ self.p["ow"] + self.p["ob"][0], act, share, pooled

    def logits(self, gates: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> np.ndarray:
        pad, out = len(gates[0]) - 1, np.zeros(len(ids), _F)
        for i in range(0, len(ids), TOGETHER):
            part = ids[i : i + TOGETHER]
            real = part != pad
            real[:, 0] = True  # a text without words is one window of padding
            out[i : i + TOGETHER] = self.pool(self.states(gates, part), real)[0]
        return out

    def gradients(self, features: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over windows of word rows ids (one past the last word: padding)."""
        p, h, g = self.p, HIDDEN, {}
        x = self.inputs(features)
        gates, keep = self.gates(x), []
        real = ids != len(x)
        real[:, 0] = True
        states = self.states(gates, ids, keep)
        logit, act, share, pooled = self.pool(states, real)
        dl = (_sigmoid(logit) - y) / _F(len(y))
        g["ob"], g["ow"] = dl.sum(keepdims=True), pooled.T @ dl
        dpool = dl[:, None] * p["ow"]
        dshare = np.einsum("nh,tnh->tn", dpool, states)
        de = share * (dshare - (share * dshare).sum(axis=0))
        dstate = share[:, :, None] * dpool[None]
        g["av"] = np.einsum("tn,tna->a", de, act)
        dact = de[:, :, None] * p["av"] * (1 - act * act)
        g["aw"], g["ab"] = np.einsum("tnh,tna->ha", states, dact), dact.sum(axis=(0, 1))
        dstate = dstate + dact @ p["aw"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            du, dgate, back = np.zeros_like(p[f"h{d}"]), np.zeros_like(gates[k]), np.zeros((len(ids), h), _F)
            for _, t, state, z, r, new, hn in reversed([s for s in keep if s[0] == k]):
                dh = dstate[t, :, k * h : (k + 1) * h] + back
                dnew = dh * (1 - z) * (1 - new * new)
                dz = dh * (state - new) * z * (1 - z)
                dr = dnew * hn * r * (1 - r)
                drec = np.concatenate([dz, dr, dnew * r], axis=1)
                du += state.T @ drec
                back = dh * z + drec @ p[f"h{d}"].T
                np.add.at(dgate, ids[:, t], np.concatenate([dz, dr, dnew], axis=1))
            g[f"h{d}"], dgate = du, dgate[:-1]
            g[f"x{d}"], g[f"b{d}"] = np.einsum("ri,rj->ij", x, dgate), dgate.sum(axis=0)
            dx += _times(dgate, p[f"x{d}"].T)
        word, gram, of = features
        for name, rows, grad in (("word", word, dx), ("gram", gram, _F(GRAM_WEIGHT) * dx[of])):
            g[name] = np.zeros_like(p[name])
            np.add.at(g[name], rows, grad)
            g[name][0] = 0
        return g

    def choose(self, texts: list[np.ndarray], words: list[str], labels: np.ndarray, rng: np.random.Generator) -> None:
        """Give an embedding to the places that enough texts have, by the number of texts of each label that have them."""
        rows = [np.unique(t) for t in texts]
        word, gram, of = _hashed(words)
        order = np.argsort(of, kind="stable")
        n = np.bincount(labels, minlength=2)
        for name, size, values, owner in (("word", WORD_PLACES, word, np.arange(len(word))), ("gram", GRAM_PLACES, gram[order], of[order])):
            count = np.zeros((2, size))
            for i in range(0, len(rows), 100):
                part = np.concatenate(rows[i : i + 100])
                text = np.repeat(np.arange(len(rows[i : i + 100])), list(map(len, rows[i : i + 100])))
                at, per = _ranges(owner, part)
                pairs = np.unique(np.repeat(text, per) * size + values[at])
                np.add.at(count, (labels[i + pairs // size], pairs % size), 1)
            share = count.sum(axis=0) / n.sum()
            z = (count[1] / n[1] - count[0] / n[0]) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n[0] + 1 / n[1]))
            tied = np.abs(z) >= LEAST_Z
            chosen = np.flatnonzero((count.sum(axis=0) >= LEAST_TEXTS) & (tied | (share >= LEAST_SHARE)))
            self.row[name][chosen] = np.arange(1, len(chosen) + 1)
            self.p[name] = np.zeros((len(chosen) + 1, EMBED), _F)
            self.p[name][1:] = _F(NOISE) * rng.standard_normal((len(chosen), EMBED))
            self.p[name][1:, 0] += np.where(tied[chosen], np.clip(z[chosen] / 10, -2, 2), 0)

    def fit(self, texts: list[np.ndarray], words: list[str], labels: np.ndarray, seed: int = SEED) -> Network:
        """Fit to texts (as places in words) and labels of 0 and 1; without both labels nothing tells texts apart and all scores are low."""
        if not len(texts) or labels.min() == labels.max():
            self.level = 4.0
            self.p["ow"][:] = 0
            return self
        rng = np.random.default_rng(seed)
        self.choose(texts, words, labels, rng)
        features = self.features(words)
        ids, owner = stack(texts, len(words))
        one, back = distinct(ids)
        windows = ids[one]
        pos, neg = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
        told = np.append(np.abs(self.inputs(features)[:, 0]) > 0.3, False)
        mean, square, last, step = {}, {}, {}, 0
        begin = int((1 - AVERAGED) * ROUNDS * STEPS)
        for turn in range(ROUNDS):
            # Each text's highest window; to begin with the one with most words that tell the labels apart.
            scores = self.logits(self.gates(self.inputs(features)), windows)[back] if turn else told[ids].sum(axis=1)
            rank = np.lexsort((-scores, owner))
            best = rank[np.flatnonzero(np.append(True, np.diff(owner[rank]) > 0))]
            for _ in range(STEPS):
                some = np.concatenate([rng.choice(pos, BATCH // 2), rng.choice(neg, BATCH // 2)])
                step += 1
                rate = 0.02 * min(1.0, 2 * (1 - step / (ROUNDS * STEPS + 1)))
                used, local = np.unique(ids[best[some]], return_inverse=True)
                used = used[used < len(words)]
                at, per = _ranges(features[2], used)
                own = features[0][used], features[1][at], np.repeat(np.arange(len(used)), per)
                for k, grad in self.gradients(own, local.reshape(BATCH, WINDOW), labels[some].astype(_F)).items():
                    mean[k] = _F(0.9) * mean.get(k, _F(0)) + _F(0.1) * grad
                    square[k] = _F(0.99) * square.get(k, _F(0)) + _F(0.01) * grad * grad
                    self.p[k] *= _F(1 - rate * (DECAY if k in self.row else DECAY_REST))
                    self.p[k] -= _F(rate) * (mean[k] / _F(1 - 0.9**step)) / (np.sqrt(square[k] / _F(1 - 0.99**step)) + _F(1e-6))
                self.p["word"][0] = self.p["gram"][0] = 0
                if step > begin:
                    for k, v in self.p.items():
                        last[k] = last.get(k, _F(0)) + (v - last.get(k, _F(0))) / _F(step - begin)
        self.p.update(last)
        scores = self.logits(self.gates(self.inputs(features)), windows)[back]
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, owner, scores)
        self.level = cut_between(top[pos], top[neg])
        return self


def cut_between(pos: np.ndarray, neg: np.ndarray) -> float:
    """The level with the fewest errors, a clean text called toxic counting as two; the middle of ties."""
    levels = np.unique(np.concatenate([pos, neg]))
    middles = (levels[1:] + levels[:-1]) / 2 if len(levels) > 1 else levels
    errors = np.searchsorted(np.sort(pos), middles) + 2 * (len(neg) - np.searchsorted(np.sort(neg), middles))
    best = np.flatnonzero(errors == errors.min())
    return float((middles[best[0]] + middles[best[-1]]) / 2)


def stack(rows: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts (as word rows), padded, and the text of each."""
    starts = [windows_of(len(r)) for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(s) for s in starts])
    offsets = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate([*rows, np.full(1, pad)])
    at = np.concatenate(starts)[:, None] + np.arange(WINDOW)
    inside = at < np.diff(offsets)[owner][:, None]
    return np.where(inside, flat[np.minimum(at + offsets[owner][:, None], len(flat) - 1)], pad), owner


def numbers(texts: Iterable[str | None]) -> tuple[list[np.ndarray], list[str]]:
    """Texts as places in a list of all their words."""
    places: dict[str, int] = {}
    out = [np.fromiter((places.setdefault(w, len(places)) for w in words_of(t)), np.int64) for t in texts]
    return out, list(places)


class Scorer:
    """A network with the gate inputs of the words it has met; row 0 is any neutral word, one without an embedding."""

    def __init__(self, network: Network):
        self.network = network
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.gates = [g[:1] for g in self.network.gates(np.zeros((1, EMBED), _F))]
        self.pads = [g[1:] for g in self.network.gates(np.zeros((1, EMBED), _F))]

    def rows(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Rows of the texts' words, new words learned."""
        every = set().union(*texts)
        new = sorted(every.difference(self.known))
        if self.known and len(self.known) + len(new) > KNOWN_WORDS:
            self.forget()
            new = sorted(every)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            features = self.network.features(part)
            marked = features[0] > 0
            marked[features[2]] = True
            at = np.cumsum(marked) + len(self.gates[0]) - 1
            self.known.update(zip(part, np.where(marked, at, 0).tolist(), strict=True))
            made = self.network.gates(self.network.inputs(features))
            self.gates = [np.concatenate([g, m[:-1][marked]]) for g, m in zip(self.gates, made, strict=True)]
        get = self.known.__getitem__
        return [np.fromiter(map(get, w), np.int64, len(w)) for w in texts]

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Score of each whole text."""
        ids, owner = stack(self.rows([words_of(t) for t in texts]), -1)
        # Equal windows are worked out once; padding is the last row.
        one, back = distinct(ids)
        rows, local = np.unique(np.append(ids[one].ravel(), -1), return_inverse=True)
        local = (local[:-1].reshape(len(one), WINDOW) - 1) % len(rows)
        gates = tuple(np.concatenate([g[rows[1:]], pad]) for g, pad in zip(self.gates, self.pads, strict=True))
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, owner, self.network.logits(gates, local)[back])
        return 1 / (1 + np.exp(-np.clip(top - self.network.level, -500, 500)))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; one without an id is not, as no label names it."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES, seed: int = SEED) -> Network:
    """A network fitted to at most `rows` labelled documents of each label, none of them held out.

    The sample is the first rows by a seeded hash of doc_id, of each label as many as begin within
    `most` bytes of text; it is all of the corpus that the driver sees, one text at a time. Rows that
    repeat a doc_id count once, and the label 1 wins.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed))
    some = [known.filter(F.col("toxic") == k).orderBy(order, "doc_id").limit(rows) for k in (0, 1)]
    # A sample of a fixed number of ids.
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some[0].union(some[1])), "doc_id")
    found = found.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    before = Window.partitionBy("toxic").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("_before", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0))).filter(F.col("_before") < most)
    marks: list[int] = []

    def texts() -> Iterator[str | None]:
        for r in found.orderBy("doc_id").select("toxic", "text").toLocalIterator():
            marks.append(r["toxic"])
            yield r["text"]

    ids, words = numbers(texts())
    return Network(seed).fit(ids, words, np.array(marks, int), seed)


def score(docs: DataFrame, network: Network) -> DataFrame:
    """docs with `score` (0 to 1; `score_1` where docs has one) of every whole text.

    Null, empty and wordless texts are one window of padding and share a score. Rows, ties and other
    columns pass through; the score depends on the text alone.
    """
    prepare(docs.sparkSession)
    arg, out = fresh(docs, "_text", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(network)
        for b in batches:
            scores = scorer.score(b.column(b.num_columns - 1).to_pylist()) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], [*b.schema.names[:-1], out])

    return docs.withColumn(arg, F.col("text").cast("string")).mapInArrow(lambda batches: letting_go(run(batches)), extended(docs.schema, (out, "double")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
