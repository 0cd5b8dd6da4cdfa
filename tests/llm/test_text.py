"""BPE, quality rules, HTML."""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from catalogs import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, html, quality
from tessera.llm.common import materialize

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OURS = bpe.ByteBpe(open(PATH, "rb").read())


def ids(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_encode_and_decode_any_text(text):
    got = OURS.encode([text, None, text + "<|endoftext|>" + text])
    assert ids(got[0]) == LIBRARY.encode(text, add_special_tokens=False).ids and got[1] == b""
    assert ids(got[2]) == LIBRARY.encode(text + "<|endoftext|>" + text, add_special_tokens=False).ids
    assert OURS.decode(got[0]) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aeinrstth ", min_size=1, max_size=30))
def test_speculation_is_verified(word):
    raw = word.encode()
    want = OURS.merge_exactly(raw)
    assert ids(OURS.encode_words([word])[0]) == want == ids(OURS.merge_many([raw])[0])


def test_compatibility_is_that_of_merging():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50256, 3000), rng.integers(0, 2000, 3000)
    ok = OURS.compatible(a, b)
    assert [OURS.merge_exactly(OURS.bytes[x] + OURS.bytes[y]) == [x, y] for x, y in zip(a, b, strict=True)] == ok.tolist()


def test_long_words():
    for text in ("=" * 5000, "ab" * 3000, " " * 999 + "x", "a" * 65):
        assert ids(OURS.encode([text])[0]) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_bpe_of_odd_documents(odd, empty):
    both = bpe.decode_documents(bpe.encode_documents(odd, PATH), PATH, "ids_1").collect()
    assert len(both) == 11
    for r in both:
        assert ids(r.ids_1) == LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "") and r.ids == "x"
    assert bpe.encode_documents(empty, PATH).count() == 0


def plain_counts(text: str | None) -> tuple:
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {w for w in set(windows) if windows.count(w) > 1} if len(windows) < 5000 else None
    if again is None:
        seen: dict = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        again = {w for w, n in seen.items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in again for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_of_odd_documents(odd, empty):
    got = quality.judge(odd).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert len(got) == 11
    for r in got:
        want = plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)
    assert quality.judge(empty).count() == 0 == quality.filter_quality(empty).count()
    assert quality.filter_quality(odd).columns == odd.columns


def test_bins(spark):
    df = spark.range(0, 100_000, 7).select("id", quality.bin_of(F.col("id")).alias("b"))
    rows = df.withColumn("top", quality.bin_top(F.col("b"))).orderBy("id").collect()
    assert all(r.id <= r.top <= max(127, r.id * 65 / 64) for r in rows)
    assert all(a.b <= b.b for a, b in zip(rows, rows[1:], strict=False))


def sample(start: int, source: str, word: str, dots: int, rows: int = 60) -> list[tuple]:
    """Texts of different words of one length, with a few symbols in some."""
    return [(start + i, "en", source, " ".join(f"{word}{i}x{k}" for k in range(100)) + " #" * (i % (dots + 1))) for i in range(rows)]


def test_thresholds_follow_the_group(spark):
    """The same document is kept in one group and goes from another."""
    long, hashes = " ".join(f"a{'very' * 12}long{k}" for k in range(60)), " ".join(f"word{k}" for k in range(100)) + " #" * 40
    rows = [*sample(0, "plain", "word", 0), *sample(100, "dense", f"a{'very' * 9}long", 60)]
    rows += [(900, "en", "plain", long), (901, "en", "dense", long), (902, "en", "plain", hashes), (903, "en", "dense", hashes)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    got = {r.doc_id: r for r in quality.judge(docs, prior=5).collect()}
    assert [got[i].kept for i in (900, 901, 902, 903)] == [False, True, False, True]
    assert got[900].max_word_length < got[901].max_word_length and got[902].max_symbols < 40 and got[903].max_symbols is None
    assert all(r.kept for i, r in got.items() if i < 900)


def test_thresholds_are_those_of_plain_quantiles(spark):
    docs = spark.createDataFrame([*sample(0, "a", "word", 3), *sample(100, "b", "w", 9, 13), (200, None, "a", sample(0, "a", "other", 2, 2)[1][3])], "doc_id long, lang string, source string, text string")
    counted = materialize(quality.counts(docs))
    got = {(r.lang, r.source): r for r in quality.thresholds(quality.sketches(counted)).collect()}
    rows = counted.collect()
    assert len(got) == 3
    for (lang, source), r in got.items():
        for rule, (top, below, low, high, spread) in ((k, v) for k, v in quality.RULES.items() if len(v) > 2):
            def at(some: list, q: int, top=top, below=below) -> int:
                v = sorted(x[top] * 100 // max(x[below], 1) for x in some)
                v = v[max(0, -(-len(v) * q // 100) - 1)]
                shift = max(v.bit_length() - 7, 0)
                return ((v >> shift) + 1 << shift) - 1

            own, whole = [x for x in rows if (x.lang, x.source) == (lang, source)], [x for x in rows if x.lang == lang]
            a, b = ((len(own) * at(own, q) + 100 * at(whole, q)) // (len(own) + 100) for q in (low, high))
            assert r[f"max_{rule}"] == b + spread * max(b - a, 1)


def clusters(groups: dict, prior: int) -> dict:
    """The cut of each (lang, source) from its rates of symbols, by trying every place in plain Python."""
    def top(v: int) -> int:
        shift = max(v.bit_length() - 7, 0)
        return ((v >> shift) + 1 << shift) - 1

    out = {}
    for (lang, source), own in groups.items():
        whole = Counter(top(v) for (la, _), vs in groups.items() if la == lang for v in vs)
        mine = Counter(map(top, own))
        w = {v: mine[v] * 1000 + 1000 * prior * m // whole.total() for v, m in whole.items()}
        vs = sorted(v for v in w if w[v])
        x = {v: math.floor(100 * math.log1p(v)) for v in vs}
        n, mean = sum(w.values()), sum(w[v] * x[v] for v in vs) / sum(w.values())
        variance = sum(w[v] * (x[v] - mean) ** 2 for v in vs)
        best = (-1, 0, 0)
        for i in range(len(vs) - 1):
            parts = vs[: i + 1], vs[i + 1 :]
            within = 0
            for part in parts:
                m = sum(w[v] * x[v] for v in part) / sum(w[v] for v in part)
                within += sum(w[v] * (x[v] - m) ** 2 for v in part)
            if (variance - within) > best[0] + 1e-6 * n:
                best = (variance - within, vs[i], vs[i + 1])
        out[lang, source] = math.floor(math.sqrt((1 + best[1]) * (1 + best[2]))) - 1 if variance and best[0] >= 0.8 * variance else None
    return out


def test_symbols_are_cut_between_clusters(spark):
    """Junk of any share under a half is told from what the group usually has; a group without junk has its language's cut, one with an even spread none."""
    rng = np.random.default_rng(6)
    groups = {("en", "few"): [0] * 90 + [int(v) for v in rng.integers(30, 300, 10)], ("en", "many"): [int(v) for v in rng.integers(2, 9, 60)] + [int(v) for v in rng.integers(100, 400, 40)], ("en", "none"): [0] * 20, ("fr", "even"): list(range(60)), ("de", "one"): [0, 0, 0], (None, None): [0] * 49 + [60]}
    rows = [(i, *g, " ".join(f"w{k}" for k in range(100)) + "#" * v) for g, vs in groups.items() for i, v in enumerate(vs)]
    counted = materialize(quality.counts(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")))
    got = {(r.lang, r.source): r.max_symbols for r in quality.thresholds(quality.sketches(counted), 10).collect()}
    assert got == clusters(groups, 10)
    assert got["fr", "even"] is None is got["de", "one"] and 0 < got["en", "few"] < 30 and 8 <= got["en", "many"] < 100 and 0 < got["en", "none"] < 30 and got[None, None] < 60


def test_rows_of_one_id_have_their_own_verdict(spark):
    good, bad = " ".join(f"word{k}" for k in range(80)), "no words"
    rows = [(1, "en", "a", good), (1, "en", "a", bad), (None, "en", "a", good), (None, None, None, bad), (2, "en", "a", good), (2, "en", "a", good)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    assert sorted(map(tuple, quality.filter_quality(docs).collect()), key=str) == sorted([r for r in rows if r[3] == good], key=str)


def test_sketches_merge(spark, odd):
    counted = materialize(quality.counts(odd))
    parts = quality.sketches(counted.filter("doc_id < 4")).union(quality.sketches(counted.filter("not doc_id < 4 or doc_id is null")))
    merged = parts.groupBy("lang", "source", "rule", "bin").agg(F.sum("n").alias("n"))
    assert sorted(map(str, merged.collect())) == sorted(map(str, quality.sketches(counted).select(*merged.columns).collect()))


PAGE = """<html><head><title>x</title><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/a>one</a><li><a>two</a></ul></nav>
<div id="cookie-notice">We use cookies</div><article><h1>T&eacute;st &amp; <b>ti</b>tle</h1><p>First   long\n paragraph with text<br>and more of it, &nbsp; to be sure.<p>Short.
<ul><li>one</li><li>two</li></ul><form>mail <input> me</form><div class="post comments"><p>nice</p></div><aside>also</aside><p>Last paragraph with some more text.</article><footer>&copy; 1</footer></body>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE, "Tést & title\nFirst long paragraph with text and more of it, to be sure.\nShort.\none\ntwo\nLast paragraph with some more text."),
        (None, ""), ("", ""), ("<div class=ad>x</div>", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<<<>&#x110000;", "<<<>�"),
        ("<div id=menu><a>1</a><a>2</a></div><div><p>A long paragraph that is the content here.</p><p>x</p></div><div><a>y</a>|<a>z</a></div>", "A long paragraph that is the content here.\nx"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


LONG = "A long paragraph of the article, with enough words in it to be far above the ratio of the others. " * 3


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # Short containers before and between content are not lost.
        (f"<body><div><h1>Title</h1></div><div><p>{LONG}</p></div><div><p>Short.</p></div><div><p>{LONG}</p></div></body>", f"Title\n{LONG.strip()}\nShort.\n{LONG.strip()}"),
        # A teaser in an article does not hide the content around it.
        (f"<body><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div><a>1</a></div><div><a>2</a></div><div><a>3</a></div><div><a>4</a></div><article><b><i><a>Go</a></i></b></article></body>", "\n".join([LONG.strip()] * 3)),
        # Nor does a short article between long ones go.
        (f"<article><p>{LONG}</p></article><p>x</p><article><p>Short.</p></article><article><p>{LONG}</p><p>{LONG}</p></article>", f"{LONG.strip()}\nShort.\n{LONG.strip()}\n{LONG.strip()}"),
    ],
)
def test_main_text_by_ratios(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # A head without an end tag, before an element and before plain text.
        (f"<head><title>x</title><body><article><p>{LONG}</p></article>", LONG.strip()), ("<head><title>x</title>plain text", "plain text"),
        # Class words that say something else, or stand on the article itself.
        (f"<article class='share-price'><p id='skip'>{LONG}</p><div class='ad-hoc'>Some text.</div><div class='ad-box'>Buy!</div></article>", f"{LONG.strip()}\nSome text."),
        # A menu without a name, of links alone; a list of links in an article is its text, and its navigation is not.
        (f"<div><a href=1>One</a></div><div><a href=2>Two</a></div><div><a href=3>Three</a></div><div><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG.strip()}\n{LONG.strip()}"),
        (f"<article><p>{LONG}</p><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a><li><a href=4>Four</a></ul><nav><a href=6>Up</a></nav><p>Short.</p><p><a href=5>A link between</a></p><p>{LONG}</p></article>", f"{LONG.strip()}\nOne\nTwo\nThree\nFour\nShort.\nA link between\n{LONG.strip()}"),
        (f"<main><nav><p>Contents</p></nav><p>{LONG}</p></main>", LONG.strip()),
        # A marked item ends with the next one.
        (f"<article><p>{LONG}</p><ul><li class=advert>Buy!<li>kept</ul></article>", f"{LONG.strip()}\nkept"),
        (f"<article><p>{LONG}<script>var x = 1</script> and <span class=share>Share this</span> more</p></article>", f"{LONG.strip()} and more"),
        ("<p><a href=1>only a link</a></p>", "only a link"), ("<nav><a href=1>only a menu</a></nav>", ""),
        ("<div>" * 3000 + "deep" + "</span>" * 3000, "deep"),
    ],
)
def test_main_text_of_odd_pages(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    "inside",
    ["<svg><title>icon</title></svg>", "<button><div>Go</div></button>", "<span hidden><div>no</div><p>no</p></span>", "<video><p>no</p></video>", "<select><option>1<option>2</select>", "<noscript><p>no</p></noscript>", "<span class=ad><ul><li>no</ul></span>", "<template><table><tr><td>no</table></template>"],
)
def test_nothing_is_lost_around_what_is_marked(inside):
    """Blocks in a marked element neither end the line around it nor take its text along."""
    assert html.main_text(f"<p>Before {inside} after.</p><p>Next.</p>") == "Before after.\nNext."
    assert html.main_text(f"<article><ul><li>Before {inside} after.<li>Next.</ul></article>") == "Before after.\nNext."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><p>{LONG}</p></article><article><p>Short.</p></article>", f"{LONG.strip()}\nShort."),
        (f"<div>An opening.</div><div><p>{LONG}</p><p>{LONG}</p></div><div>A closing.</div>", "\n".join(["An opening.", LONG.strip(), LONG.strip(), "A closing."])),
        (f"<p>{LONG}</p><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><ul><li>Plain<li><a href=1>one</a></ul>", f"{LONG.strip()}\nPlain\none"),
        # Adverts, notices and comments inside of an article, by one word of their names.
        *[(f"<article><p>{LONG}</p><div class='{c}'><p>Gone.</p></div><p>End.</p></article>", f"{LONG.strip()}\nEnd.") for c in ("ad-slot", "ad_300x250", "google-ad", "adsbygoogle", "user-comments", "reader-comments", "cookie-policy")],
        (f"<article><p>{LONG}</p><p class='cookie-notice'>Gone.</p><span class='x google-ad'>Gone.</span> Stays.</article>", f"{LONG.strip()}\nStays."),
        (f"<article><p>{LONG}</p></article><section class='reader-comments'><article class=comment><p>Nice!</p></article></section>", LONG.strip()),
        # Not where the element holds the article, its title or most of the page.
        (f"<div class='with-sidebar-left'><article><p>{LONG}</p></article></div>", LONG.strip()),
        (f"<div class='no-comments-yet'><p>{LONG}</p></div><div>End.</div>", f"{LONG.strip()}\nEnd."),
        ("<div class='no-sidebar-here'><h1>Title</h1></div><div><p>Text of the page, longer than its title.</p></div>", "Title\nText of the page, longer than its title."),
        # Tags and comments that never end.
        ("<p>one</p><p>two <a href='x", "one\ntwo"), ("<p>a < b and 3 <4</p>", "a < b and 3 <4"), ("<p>one</p><!-- no end <p>two</p>", "one\nno end\ntwo"),
    ],
)
def test_nothing_else_is_dropped(page, text):
    assert html.main_text(page) == text


def tree(rng, depth: int) -> tuple[str, list[str]]:
    """A random element of blocks, and its visible lines as a second, plain reader of the same tree would give them."""
    word = lambda: f"w{rng.integers(0, 1000)}"
    kind = int(rng.integers(0, 7 if depth else 4))
    if kind < 2:
        text, inline = word(), rng.choice(["<b>{}</b>", "<a href=1>{}</a>", "<span>{}</span>", "{}"])
        gone = rng.choice(["", "<script>x</script>", "<svg><title>x</title></svg>", "<button><p>x</p></button>", "<span class=ad><div>x</div></span>"])
        other = word()
        return f"<p>{text} {gone} {inline.format(other)}</p>", [f"{text} {other}"]
    if kind == 2:
        return f"<{rng.choice(['aside', 'form', 'footer', 'nav'])}><p>{word()}</p></{'x'}>".replace("</x>", ""), []
    if kind == 3:
        items = [word() for _ in range(int(rng.integers(1, 4)))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", items
    parts = [tree(rng, depth - 1) for _ in range(int(rng.integers(1, 4)))]
    name = rng.choice(["div", "section", "blockquote"])
    return f"<{name}>" + "".join(p for p, _ in parts) + f"</{name}>", [x for _, lines in parts for x in lines]


@pytest.mark.parametrize("seed", range(60))
def test_against_a_second_reader(seed):
    rng = np.random.default_rng(seed)
    parts = [tree(rng, 3) for _ in range(6)]
    closed = [re.sub(r"<(aside|form|footer|nav)>(.*?</p>)", r"<\1>\2</\1>", p) for p, _ in parts]
    assert html.main_text(f"<body><nav><a href=1>x</a></nav><article>{''.join(closed)}</article><footer>x</footer></body>") == "\n".join(x for _, lines in parts for x in lines)


def test_stray_and_open_tags_cost_little():
    began = time.process_time()
    broken = ["<a <b ", "<!-- x> ", "<![CDATA[ ]>", "</a ", "<a x='", "<a x=\"> ", "<!a"]
    for page in (*(x * 20_000 for x in broken), "<b>" * 20_000 + "</i>" * 20_000, "<b><div>" + "<i>" * 20_000 + "</b>" * 20_000, "<div>" + "<i>" * 20_000 + "<hr>" * 20_000):
        html.main_text(page)
    assert time.process_time() - began < 10


def test_parting_has_the_least_variance():
    rng = np.random.default_rng(5)
    for _ in range(50):
        scores = rng.gamma(1, 30, int(rng.integers(2, 30)))
        x = np.log1p(scores)
        within = lambda c, x=x, scores=scores: sum(len(p) * p.var() for p in (x[scores < c], x[scores >= c]) if len(p))
        assert within(html.parting(scores)) == pytest.approx(min(within(c) for c in np.sort(scores)[1:]))


SENTENCES = st.lists(st.sampled_from(["The harbour was quiet before dawn, and nobody had come down to the boats.", "Prices fell again, said the board, though less than in the years before.", "He wrote three letters that winter and sent none of them to anyone at all."]), min_size=2, max_size=6).map(" ".join)
ASIDES = ["<nav><a href=1>Home</a> <a href=2>News</a></nav>", "<div class='cookie-notice'>We use cookies for what we do.</div>", "<div class=ad><p>Buy now and pay later, if at all.</p></div>", "<aside>More of this kind</aside>", "<ul><li><a href=1>A</a><li><a href=2>B</a><li><a href=3>C</a></ul>", "<form>Your mail <input><button>Go</button></form>", "<script>var x = '<p>text</p>'</script>"]


@settings(max_examples=150, deadline=None)
@given(st.lists(SENTENCES, min_size=2, max_size=6), st.lists(st.sampled_from(ASIDES), max_size=4), st.lists(st.sampled_from(ASIDES), max_size=4), st.sampled_from(["article", "main", "div", "section"]))
def test_made_pages(paragraphs, before, after, element):
    """Pages made of known parts: what comes out is the paragraphs, whatever stands around them."""
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    page = f"<html><head><title>t</title></head><body><header>Site</header>{''.join(before)}<{element}><h1>Title</h1>{body}</{element}>{''.join(after)}<div class=comments><p>Nice!</p></div><footer>End</footer></body></html>"
    assert html.main_text(page) == "\n".join(["Title", *paragraphs])


def test_extract(spark):
    df = spark.createDataFrame([(1, PAGE, "t"), (1, PAGE, "t"), (None, None, None)], "page_id long, html string, text string")
    got = html.extract(df).collect()
    assert [r.text for r in got] == ["t", "t", None] and got[0].text_1 == html.main_text(PAGE) == got[1].text_1 and got[2].text_1 == ""
    assert html.extract(df.limit(0)).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_queries(spark):
    assert sum(r.n_chars for r in html.query(spark, str(DATA)).collect()) > 10_000
    for r in bpe.query(spark, str(DATA)).join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id").collect():
        want = LIBRARY.encode(r.text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
