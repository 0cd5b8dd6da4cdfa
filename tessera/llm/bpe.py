"""Byte-level BPE by speculation and verification.

A greedy longest match proposes the tokens of each distinct word. Merging in rank order gives the
proposal exactly if no merge ever crosses a border between two neighbours, and that depends on the
two tokens alone. So every adjacent pair is tested, vectorised over pairs, and only words with a
failing pair are merged step by step.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import extended, fresh, letting_go, prepare, table

#: Fixed value: the published split of byte-level BPE before its merges.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+""")
#: The same for Latin text up to U+024F without the characters of _OTHER (numbers that aren't decimal
#: digits, controls that only Python counts as white space); the standard engine is the faster one.
_PLAIN = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
_OTHER = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]")
#: A task forgets its known words beyond this many words or bytes of text; only speed depends on it.
KNOWN_WORDS, KNOWN_BYTES = 500_000, 32 << 20
#: Longer words are merged by themselves.
LONG = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NEVER = np.int64(1 << 60)


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def words_of(text: str) -> list[str]:
    """The pieces that are merged by themselves."""
    return (PATTERN if _OTHER.search(text) else _PLAIN).findall(text)


class _Table:
    """Whole numbers by 64-bit key for vectorised lookup: open addressing, at most a quarter full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, absent: int):
        self.shift = np.uint64(62 - max(4, len(keys).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values, self.used = np.zeros(size, np.uint64), np.full(size, absent, np.int64), np.zeros(size, bool)
        self.mask, self.absent = size - 1, absent
        keys, at = keys.astype(np.uint64), self.slot(keys.astype(np.uint64))
        left = np.arange(len(keys))
        while len(left):
            # Of the keys at one free slot the first takes it; the others go on.
            free = left[~self.used[at[left]]]
            took = free[np.unique(at[free], return_index=True)[1]]
            self.used[at[took]], self.keys[at[took]], self.values[at[took]] = True, keys[took], values[took]
            left = np.setdiff1d(left, took, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self.slot(keys)
        same, used = self.keys[at] == keys, self.used[at]
        out = np.where(same & used, self.values[at], self.absent)
        more = np.flatnonzero(used & ~same)
        at = at[more]
        while len(more):
            at = (at + 1) & self.mask
            same, used = self.keys[at] == keys[more], self.used[at]
            out[more[same & used]] = self.values[at[same & used]]
            go = used & ~same
            more, at = more[go], at[go]
        return out


class ByteBpe:
    """A vocabulary in the tokenizers library's JSON form (byte level, no normalizer, no prefix space)."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        vocab, symbols = spec["model"]["vocab"], _byte_symbols()
        raw = {t: bytes(symbols[c] for c in t) for t in vocab}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = token_bytes(source)
        n = len(self.bytes)
        self.split_specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.of_byte = [vocab[c] for c, _ in sorted(symbols.items(), key=lambda x: x[1])]
        #: rank: when a token is made (-1: a byte); first, last: its two halves.
        self.rank, self.first, self.last = np.full(n, -1, np.int64), np.arange(n), np.arange(n)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            self.merge[x, y] = (r, made)
            self.rank[made], self.first[made], self.last[made] = r, x, y
        self.made = np.array([m for _, m in self.merge.values()], np.int64)
        self.pairs = _Table(np.array([x << 32 | y for x, y in self.merge], np.uint64), np.arange(len(self.merge)), int(_NEVER))
        self.prefixes, self.longest = self._prefix_table(vocab, raw)
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0

    @staticmethod
    def _prefix_table(vocab: dict[str, int], raw: dict[str, bytes]) -> tuple[_Table, int]:
        """Hashes of all prefixes of tokens with the token that is the prefix or -1 (no prefix: -2), and the longest."""
        found: dict[int, int] = {}
        base, mask = int(_BASE), (1 << 64) - 1
        for t, i in vocab.items():
            h = 0
            for c in raw[t]:
                h = (h * base + c + 1) & mask
                found.setdefault(h, -1)
            found[h] = i
        return _Table(np.array(list(found), np.uint64), np.array(list(found.values()), np.int64), -2), max(map(len, raw.values()))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of a then b, in rank order, leaves the border between them.

        Time is rank. Going back in time, the later-made of the two tokens at the border is undone
        (the right one on a tie, as the left of two equal merges comes first). A merge across the
        border breaks it if its time comes before either neighbour is used up.
        """
        ok, at = np.ones(len(a), bool), np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        used_x, used_y = np.full(len(a), _NEVER), np.full(len(a), _NEVER)
        while len(at):
            when = self._ranks(x, y)
            broken = (when < used_x) & (when <= used_y)
            ok[at[broken]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~broken & ((rx >= 0) | (ry >= 0))
            at, x, y, used_x, used_y, rx, ry = (v[go] for v in (at, x, y, used_x, used_y, rx, ry))
            left = rx > ry
            used_x, used_y = np.where(left, rx, used_x), np.where(left, used_y, ry)
            x, y = np.where(left, self.last[x], x), np.where(left, y, self.first[y])
        return ok

    def _pairs_ok(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible() of each adjacent pair, worked out once for equal ones."""
        keys, back = np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)
        return self.compatible(keys >> 32, keys & 0xFFFFFFFF)[back]

    def merge_exactly(self, word: bytes) -> list[int]:
        """Merge in rank order, leftmost first on ties."""
        ids: list[int] = [self.of_byte[c] for c in word]
        n, get = len(ids), self.merge.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if m := get((made, ids[after[j]])):
                    heapq.heappush(heap, (m[0], i, made, ids[after[j]], m[1]))
            if before[i] >= 0 and (m := get((ids[before[i]], made))):
                heapq.heappush(heap, (m[0], before[i], ids[before[i]], made, m[1]))
        return [t for t in ids if t >= 0]

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of every word: tokens in order, and the word of each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
        word = np.repeat(np.arange(len(words)), sizes)
        end = np.repeat(np.cumsum(sizes), sizes)
        token, size = np.full(len(text), -1, np.int64), np.ones(len(text), np.int64)
        at, h = np.arange(len(text)), np.zeros(len(text), np.uint64)
        for k in range(self.longest):
            more = at + k < end[at]
            at, h = at[more], h[more]
            if not len(at):
                break
            h = h * _BASE + text[at + k]
            got = self.prefixes.get(h)
            hit = got > -2
            at, h, got = at[hit], h[hit], got[hit]
            full = got >= 0
            token[at[full]], size[at[full]] = got[full], k + 1
        begins = np.zeros(len(text), bool)
        now = np.cumsum(sizes) - sizes
        now = now[sizes > 0]
        while len(now):
            begins[now] = True
            then = now + size[now]
            now = then[then < end[now]]
        return token[begins], word[begins]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each pre-split word."""
        raw = [w.encode() for w in words]
        short = [i for i, w in enumerate(raw) if len(w) <= LONG]
        out: list[bytes] = [b""] * len(raw)
        bad: set[int] = set(range(len(raw))).difference(short)
        if short:
            tokens, word = self.propose([raw[i] for i in short])
            same = word[1:] == word[:-1]
            ok = self._pairs_ok(tokens[:-1][same], tokens[1:][same])
            failing = np.zeros(len(short), bool)
            failing[word[1:][same][~ok]] = True
            ends = np.searchsorted(word, np.arange(len(short) + 1))
            packed = tokens.astype("<u4").tobytes()
            for k, (i, f) in enumerate(zip(short, failing, strict=True)):
                if f:
                    bad.add(i)
                else:
                    out[i] = packed[4 * ends[k] : 4 * ends[k + 1]]
        for i in [i for i in bad if len(raw[i]) > LONG]:
            out[i] = np.array(self.merge_exactly(raw[i]), "<u4").tobytes()
        rest = sorted((i for i in bad if len(raw[i]) <= LONG), key=lambda i: len(raw[i]))
        for k in range(0, len(rest), 2000):
            for i, ids in zip(rest[k : k + 2000], self.merge_many([raw[i] for i in rest[k : k + 2000]]), strict=True):
                out[i] = ids
        return out

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """merge_exactly() of many short words: in each round every word takes its next merge."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        most = int(sizes.max())
        col = np.arange(most)
        ids = np.full((len(words), most + 1), -1, np.int64)
        ids[:, :most][col < sizes[:, None]] = np.array(self.of_byte)[np.frombuffer(b"".join(words), np.uint8)]
        rank = self._ranks(ids[:, :-1], ids[:, 1:])
        live = np.arange(len(words))
        done = ids.copy()
        count = sizes.copy()
        while len(live):
            j = rank.argmin(axis=1)
            row = np.arange(len(live))
            go = rank[row, j] < _NEVER
            done[live[~go]] = ids[~go]
            live, ids, rank, j = live[go], ids[go], rank[go], j[go]
            if not len(live):
                break
            row = np.arange(len(live))
            made = self.made[rank[row, j]]
            count[live] -= 1
            shift = col[None, :] > j[:, None]
            ids[:, :-1] = np.where(shift, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            rank[:, :-1] = np.where(shift[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = _NEVER
            ids[row, j] = made
            rank[row, j] = self._ranks(made, ids[row, j + 1])
            before = j > 0
            rank[row[before], j[before] - 1] = self._ranks(ids[row[before], j[before] - 1], made[before])
        packed = done[:, :most][col < count[:, None]].astype("<u4").tobytes()
        ends = 4 * np.cumsum(count)
        return [packed[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]

    def _ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.pairs.get((x << 32 | y).view(np.uint64).ravel()).reshape(x.shape)

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Little-endian uint32 ids of each whole text; a special token's string becomes its id."""
        split: list[list] = []
        for text in texts:
            parts = self.split_specials.split(text or "") if self.split_specials else [text or ""]
            split.append([self.specials[p] if i % 2 else words_of(p) for i, p in enumerate(parts)])
        if len(self.known) > KNOWN_WORDS or self.known_bytes > KNOWN_BYTES:
            self.known, self.known_bytes = {}, 0
        new = list(set().union(*(p for s in split for p in s[::2])).difference(self.known))
        if new:
            self.known.update(zip(new, self.encode_words(new), strict=True))
            self.known_bytes += sum(map(len, new))
        get = self.known.__getitem__
        return [b"".join(b"".join(map(get, p)) if isinstance(p, list) else p.to_bytes(4, "little") for p in s) for s in split]

    def decode(self, packed: bytes) -> str:
        """Text of little-endian uint32 ids, special tokens included."""
        return decode(self.bytes, packed)


def token_bytes(source: bytes) -> list[bytes]:
    """The bytes of each token, special ones included; all that decoding needs."""
    spec, symbols = json.loads(source), _byte_symbols()
    found = {i: bytes(symbols[c] for c in t) for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return [found.get(i, b"") for i in range(max(found) + 1)]


def decode(tokens: list[bytes], packed: bytes) -> str:
    """Text of little-endian uint32 ids."""
    return b"".join(map(tokens.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


#: What a task has made of a vocabulary, until its end.
_LOADED: dict[tuple, ByteBpe | list[bytes]] = {}


def unload() -> None:
    _LOADED.clear()


def load(make, source: bytes, key: str):
    """make(source), once in each task."""
    if (make, key) not in _LOADED:
        _LOADED[make, key] = make(source)
    return _LOADED[make, key]


def _append(df: DataFrame, column: str, kind: str, name: str, run) -> DataFrame:
    """df with a column that run() makes of each Arrow column `column` (read as the type `kind`)."""
    prepare(df.sparkSession)
    (arg,) = fresh(df, "_arg")
    (out,) = fresh(df, name)
    made = "binary" if name == "ids" else "string"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array(run(b.column(b.num_columns - 1).to_pylist()), pa.binary() if made == "binary" else pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], got], [*b.schema.names[:-1], out])

    fed = df.withColumn(arg, F.col(f"`{column}`").cast(kind))
    return fed.mapInArrow(lambda batches: letting_go(each(batches), unload), extended(df.schema, (out, made)))


def _read(vocabulary: str) -> tuple[bytes, str]:
    with open(vocabulary, "rb") as f:
        source = f.read()
    return source, hashlib.sha256(source).hexdigest()


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """docs with `ids`: the whole text's token ids as little-endian uint32 in a binary.

    vocabulary: path of the JSON file, read on the driver and shipped with the job (its size is fixed).
    Null and empty texts have no ids. Rows, ties and other columns pass through; where docs already
    has a column `ids`, the new one is `ids_1`.
    """
    source, key = _read(vocabulary)
    return _append(docs, text, "string", "ids", lambda texts: load(ByteBpe, source, key).encode(texts))


def decode_documents(docs: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """docs with `decoded`: the text of packed ids (null: empty), special tokens included."""
    source, key = _read(vocabulary)

    def run(packed: list[bytes | None]) -> list[str]:
        tokens = load(token_bytes, source, key)
        return [decode(tokens, p or b"") for p in packed]

    return _append(docs, ids, "binary", "decoded", run)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode_documents(encode_documents(docs, path).drop("text"), path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
