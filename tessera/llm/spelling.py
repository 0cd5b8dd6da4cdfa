"""Spelling variants of the corpus' words by composition of automata.

Two words are near if one edit of one code point makes one of them the other. The near pairs of a vocabulary are what the
composition vocabulary acceptor o one-edit transducer o vocabulary acceptor accepts. It is enumerated per partition
of its initial states: before the edit both words spell the same prefix and are in one state of the acceptor, so a
partition holds the words that pass through one such state. If the edit comes early the words read backwards share a state, so
every word stands in partitions of its first half read forwards and of its second half read backwards, and each pair
belongs to exactly one of them. In a partition the rest of the words makes a minimised acceptor in one task; a partition that
is too large is cut again by halves of the rest, until what may differ is a single place.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, letting_go, materialize, prepare, table

#: Fixed values of the contract.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMAGE, LENGTH, COUNT, RATIO = 97, 5, 3, 2
#: Words of one partition's acceptor; larger partitions are cut again.
PARTITION = 20_000


class Acceptor:
    """Minimised acyclic acceptor of sorted distinct strings. A state is its number; equal rights share one."""

    def __init__(self, words: list[str]) -> None:
        self.out: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}
        open_: list[tuple[dict[str, int], bool]] = [({}, False)]

        def close(arcs: dict[str, int], final: bool) -> int:
            right = (final, *arcs.items())
            if right not in known:
                known[right] = len(self.out)
                self.out.append(arcs)
                self.final.append(final)
            return known[right]

        last = ""
        for word in words:
            shared = next((i for i, (x, y) in enumerate(zip(last, word, strict=False)) if x != y), min(len(last), len(word)))
            while len(open_) > shared + 1:
                state = close(*open_.pop())
                open_[-1][0][last[len(open_) - 1]] = state
            open_ += [({}, False) for _ in word[shared:]]
            open_[-1] = (open_[-1][0], True)
            last = word
        while len(open_) > 1:
            state = close(*open_.pop())
            open_[-1][0][last[len(open_) - 1]] = state
        self.start = close(*open_.pop())
        self._common: dict[tuple[int, int], list[tuple]] = {}
        self._edits: dict[int, list[tuple]] = {}

    def common(self, p: int, q: int) -> list[tuple]:
        """Strings that both states accept, as (letter, rest) or (): the composition after its edit, where both sides read the same."""
        done, stack = self._common, [(p, q) if p < q else (q, p)]
        while stack:
            key = stack[-1]
            if key in done:
                stack.pop()
                continue
            a, b = self.out[key[0]], self.out[key[1]]
            next_ = [(c, (min(a[c], b[c]), max(a[c], b[c]))) for c in sorted(a.keys() & b.keys())]
            if todo := [k for _, k in next_ if k not in done]:
                stack += todo
                continue
            done[key] = [()] * (self.final[key[0]] and self.final[key[1]]) + [(c, s) for c, k in next_ for s in done[k]]
        return done[(p, q) if p < q else (q, p)]

    def edits(self, p: int) -> list[tuple]:
        """Pairs of rests from one state whose first letters differ: replaced, or left out by the second.

        A letter left out of a run of equal ones is the run's last, so a pair has one way through.
        """
        if p not in self._edits:
            arcs = sorted(self.out[p].items())
            found = []
            for i, (c, to) in enumerate(arcs):
                found += [(c, "", s) for s in self.common(to, p) if not s or s[0] != c]
                found += [(c, d, s) for d, other in arcs[i + 1 :] for s in self.common(to, other)]
            self._edits[p] = found
        return self._edits[p]

    def pairs(self) -> Iterator[tuple[str, str]]:
        """Every pair of accepted strings that are one edit apart, once; of different lengths, the longer first."""
        walk = [("", self.start)]
        while walk:
            prefix, p = walk.pop()
            for c, d, rest in self.edits(p):
                end = []
                while rest:
                    end.append(rest[0])
                    rest = rest[1]
                end = "".join(end)
                yield prefix + c + end, prefix + d + end
            walk += [(prefix + c, to) for c, to in self.out[p].items()]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the vocabulary of docs (doc_id, text) with its counts.

    Words are runs of letters, A-Z lower-cased; where 97 divides the CRC-32 of `<doc_id>:<run>` (no id: nothing before
    the colon) one code point is left out. Words of under 5 code points or 3 occurrences are dropped. Null and empty texts
    have no words; repeated rows count again.
    """
    runs = F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(RUN), F.lit(0))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    rows = docs.select("doc_id", F.explode(runs).alias("run")).select("run", F.crc32(key.cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % DAMAGE == 0, cut).otherwise(F.col("run"))
    long = rows.select(word.alias("word")).filter(F.length("word") >= LENGTH)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COUNT)


def _partitions(rows: DataFrame) -> DataFrame:
    """Rows (word, a, z, least, strict) in the two partitions of their pairs, one half nearer to a single place.

    The words of a pair share their first a and last z letters; the shorter one has `least` letters between. If the edit
    stands after the first half of these, the pair belongs to the partition of words that share this half (read
    forwards), else to that of words that share the other half (read backwards); there a pair whose edit could as
    well stand at the half's end is left to the other: those are `strict`. `left` counts the shorter one's letters
    between in the new partition.
    """
    half = F.floor(F.col("least") / 2).cast("int")
    rest = F.col("least") - half
    ways = F.array(
        F.struct((F.col("a") + half).alias("a"), F.col("z"), rest.alias("left"), F.col("strict")),
        F.struct(F.col("a"), (F.col("z") + rest).alias("z"), half.alias("left"), F.lit(True).alias("strict")),
    )
    dealt = rows.select("word", F.explode(F.when(half > 0, ways).otherwise(F.slice(ways, 1, 1))).alias("way")).select("word", "way.*")
    shared = F.substring(F.col("word"), F.lit(1), F.col("a")), F.when(F.col("z") > 0, F.expr("right(word, z)")).otherwise("")
    return dealt.select("word", "a", "z", "left", "strict", F.concat_ws("|", "a", "z", "left", F.col("strict").cast("string"), *shared).alias("key"))


def _accepted(rows: DataFrame) -> DataFrame:
    """(x, y) of the rows of each key, a partition at a time in memory."""

    def pairs(words: list[str], a: int, z: int, left: int, strict: bool) -> Iterator[tuple[str, str]]:
        head, tail = words[0][:a], words[0][len(words[0]) - z :]
        for x, y in Acceptor(sorted({w[a : len(w) - z] for w in words})).pairs():
            if min(len(x), len(y)) == left and not (strict and x[:-1] == y):
                yield head + x + tail, head + y + tail

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(words: list[str], where: tuple) -> Iterator[pa.RecordBatch]:
            found = pairs(words, *where)
            while part := list(itertools.islice(found, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in part], pa.string()) for i in (0, 1)], names=["x", "y"])

        key, words, where = None, [], ()
        for b in batches:
            for k, word, *at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key:
                    if len(words) > 1:
                        yield from out(words, where)
                    key, words, where = k, [], tuple(at)
                words.append(word)
        if len(words) > 1:
            yield from out(words, where)

    return rows.select("key", "word", "a", "z", "left", "strict").repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: letting_go(run(b)), "x string, y string")


def near_pairs(words: DataFrame, partition: int = PARTITION) -> DataFrame:
    """(x, y): every two words of column `word` (distinct, not null) that are one edit apart, once.

    A round that leaves partitions of over `partition` words cuts them again by halves; with a single letter left a
    partition holds one word for each letter and for each two letters at most, so it fits.
    """
    prepare(words.sparkSession)
    n = F.length("word")
    rows = words.select("word", F.lit(0).alias("a"), F.lit(0).alias("z"), F.explode(F.array(n, n - 1)).alias("least"), F.lit(False).alias("strict"))
    found = []
    while True:
        placed = materialize(_partitions(rows))
        size = materialize(placed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
        fits = (F.col("size") <= partition) | (F.col("left") < 2)
        held = placed.join(size, "key")
        found.append(materialize(_accepted(held.filter(fits))))
        rows = held.filter(~fits).select("word", "a", "z", F.col("left").alias("least"), "strict")
        again = not rows.isEmpty()
        rows = materialize(rows) if again else rows
        discard(placed, size)
        if not again:
            return functools.reduce(DataFrame.unionByName, found)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form) of words that have a form: the last word on the way, each round twice as far."""
    links = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        far = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(links.join(far, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(links)
        links = moved
        if moved.filter("moved").isEmpty():
            return links.select("word", "root")


def variants(docs: DataFrame, partition: int = PARTITION) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the vocabulary of docs (word_counts).

    form: the near word of largest n, ties to the smallest in code-point order, if it has twice the word's n at least, else
    null; root: the last word when forms are followed, the word itself without one; n_near: near words; form_n: the
    form's n. No document, or no word that is frequent and long enough, gives no rows. Other columns of docs are ignored.
    """
    vocabulary = materialize(word_counts(docs.select("doc_id", "text")))
    pairs = near_pairs(vocabulary.select("word"), partition)
    near = pairs.select(F.explode(F.array(F.struct(F.col("x").alias("word"), F.col("y").alias("near")), F.struct(F.col("y").alias("word"), F.col("x").alias("near")))).alias("p")).select("p.*")
    known = near.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = materialize(known.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best")))
    joined = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.col1")).alias("near_n"))
    frequent = F.col("near_n") >= RATIO * F.col("n")
    formed = materialize(joined.select("word", "n", "n_near", F.when(frequent, F.col("near")).alias("form"), F.when(frequent, F.col("near_n")).alias("form_n")))
    found = formed.join(roots(formed.filter("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: CRC-32 of UTF-8 text in whole numbers; letters past ASCII here are of two bytes.
CRC = """list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}, ''), lambda x: CASE WHEN unicode(x) < 128
    THEN [unicode(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]
    ELSE [192::BIGINT + (unicode(x) >> 6), -1, -1, -1, -1, -1, -1, -1, -1, 128 + (unicode(x) & 63), -1, -1, -1, -1, -1, -1, -1, -1] END))),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, (a & 1) * 3988292384) END)"""

ORACLE_SQL = f"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS k FROM tokens GROUP BY ALL),
hashed AS (SELECT run, k, xor({CRC.format("coalesce(doc_id::VARCHAR, '') || ':' || run")}, 4294967295) AS h FROM counted),
damaged AS (
  SELECT CASE WHEN h % {DAMAGE} = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed),
vocabulary AS (SELECT word, sum(k)::BIGINT AS n FROM damaged WHERE length(word) >= {LENGTH} GROUP BY word HAVING sum(k) >= {COUNT}),
cuts AS (
  SELECT word, i, substring(word, 1, i) || substring(word, i + 2) AS cut
  FROM (SELECT word, unnest(range(length(word)))::INT AS i FROM vocabulary)),
shorter AS (SELECT DISTINCT c.word AS x, v.word AS y FROM cuts c JOIN vocabulary v ON v.word = c.cut),
near AS (
  SELECT x AS word, y AS near FROM shorter UNION ALL SELECT y, x FROM shorter
  UNION ALL SELECT a.word, b.word FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word),
ranked AS (
  SELECT r.word, r.near, v.n AS near_n, count(*) OVER (PARTITION BY r.word) AS n_near,
         row_number() OVER (PARTITION BY r.word ORDER BY v.n DESC, r.near) AS place
  FROM near r JOIN vocabulary v ON v.word = r.near),
formed AS (
  SELECT v.word, v.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= {RATIO} * v.n THEN r.near END AS form, CASE WHEN r.near_n >= {RATIO} * v.n THEN r.near_n END AS form_n
  FROM vocabulary v LEFT JOIN ranked r ON r.word = v.word AND r.place = 1),
steps AS (
  SELECT word, word AS at FROM formed UNION ALL SELECT s.word, f.form FROM steps s JOIN formed f ON f.word = s.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN steps s ON s.word = f.word JOIN formed l ON l.word = s.at AND l.form IS NULL
"""
