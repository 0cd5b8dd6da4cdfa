"""Quality rules with thresholds that follow the corpus, in DataFrame functions alone.

Each text has a few counts and four rates in per cent. A log-linear histogram of every rate, per language and source, is a
quantile sketch that merges by adding counts: bin edges are fixed, so partial sketches of any rows add up to the sketch of all
rows, on reruns too. Rates that every text has are cut at the group's upper quantile plus a multiple of its distance from
the lower one. Symbols, which most texts lack, are cut where the sketch falls into two clusters: at the middle, by logarithms, between the lower
and the upper one, if these tell nearly all of the variance; else not at all. Small groups are drawn to the merged sketch of their language. The documents
are then joined to their group's thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, fresh, materialize, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: rate: (numerator, denominator, lower and upper quantile in per cent, spread). Long words are rare in clean texts, so
#: quartiles, which a quarter of junk doesn't move; repetition is common in a few. Without quantiles a rate is cut between two clusters.
RULES = {
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines", 50, 99, 2),
    "repeats": ("n_repeat_words", "n_words", 50, 99, 2),
    "word_length": ("word_chars", "n_words", 25, 75, 8),
}
#: Share of the variance, in per cent, that two clusters tell where there are two: a single hump has about 65, an even spread 75.
TOLD = 80
#: A language's quantiles count as those of so many documents beside a group's own.
PRIOR = 100
#: Bins of each power of two; whole numbers below twice as many have a bin of their own.
BINS = 64


def bin_of(value: Column) -> Column:
    """Bin of a whole number from 0: exact below 2 * BINS, then BINS bins for each power of two."""
    shift = F.greatest(F.length(F.bin(value)) - (2 * BINS - 1).bit_length(), F.lit(0))
    return (shift * (2 * BINS) + F.call_function("shiftright", value, shift)).cast("long")


def bin_top(b: Column) -> Column:
    """Largest value of a bin."""
    return F.call_function("shiftleft", b % (2 * BINS) + 1, F.floor(b / (2 * BINS)).cast("int")) - 1


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text; a null text counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("t"))
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    rows = rows.select(
        "doc_id", "lang", "source",
        F.filter(F.split("t", SPACE), lambda w: w != "").alias("w"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).alias("chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).alias("symbols"),
        F.filter(F.split("t", "\n"), has_word).alias("lines"),
    )
    rows = rows.select(
        "doc_id", "lang", "source",
        F.size("w").cast("long").alias("n_words"),
        F.col("chars").cast("long").alias("word_chars"),
        F.col("symbols").cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.col("w")[i], F.col("w")[i + 1], F.col("w")[i + 2]))).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    # Positions of the windows found more than once, in order; sorted by (window, position) equal windows are neighbours.
    rows = rows.withColumn("h", F.when(F.size("h") > F.size(F.array_distinct("h")), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).otherwise(F.array().cast("array<struct<x:bigint,i:int>>")))
    again = F.filter("h", lambda e, k: (F.get("h", k - 1)["x"] == e["x"]).eqNullSafe(True) | (F.get("h", k + 1)["x"] == e["x"]).eqNullSafe(True))
    rows = rows.withColumn("p", F.sort_array(F.transform(again, lambda e: e["i"]))).drop("h")
    # A position covers three words, less what the next one covers again.
    covered = F.aggregate(F.transform("p", lambda p, k: F.least(F.coalesce(F.get("p", k + 1) - p, F.lit(3)), F.lit(3)).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.withColumn("n_repeat_words", covered).drop("p")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, rule, bin, n): mergeable sketches of all rates of what passes the base; two tables add up by sum of n.

    counted: counts() as written, or planning repeats its expressions many times over.
    """
    rates = F.array(*[F.struct(F.lit(k).alias("rule"), bin_of(rate(k)).alias("bin")) for k in RULES])
    return counted.filter(~base_failed()).select("lang", "source", F.explode(rates).alias("r")).groupBy("lang", "source", "r.rule", "r.bin").agg(F.count(F.lit(1)).alias("n"))


def rate(rule: str) -> Column:
    """Per cent, rounded down."""
    top, below, *_ = RULES[rule]
    return F.floor(F.col(top) * 100 / F.greatest(F.col(below), F.lit(1))).cast("long")


def _of_rule(values: int) -> Column:
    return F.coalesce(*[F.when(F.col("rule") == k, F.lit(v[values])) for k, v in RULES.items() if len(v) > 2])


def quantiles(sketch: DataFrame, group: list[str]) -> DataFrame:
    """(group, rule, n, low, high): documents and both quantiles of each rule of each group."""
    of = Window.partitionBy(*group, "rule")
    sums = sketch.withColumn("upto", F.sum("n").over(of.orderBy("bin"))).withColumn("total", F.sum("n").over(of))
    least = lambda i: bin_top(F.min(F.when(F.col("upto") * 100 >= F.col("total") * _of_rule(i), F.col("bin"))))
    return sums.groupBy(*group, "rule").agg(F.max("total").alias("n"), least(2).alias("low"), least(3).alias("high"))


def parted(sketch: DataFrame, rule: str, prior: int = PRIOR) -> DataFrame:
    """(lang, source, cut): the highest accepted rate of a rule where each group's sketch falls into two clusters; null where it doesn't.

    The language's merged sketch counts as `prior` documents beside the group's own. Of all places between two bins the one is
    taken at which two clusters have the least variance within them, by logarithms (whole hundredths of log(1 + rate)).
    """
    own = sketch.filter(F.col("rule") == rule)
    merged = own.groupBy("lang", "bin").agg(F.sum("n").alias("m"))
    merged = merged.withColumn("all", F.sum("m").over(Window.partitionBy("lang")))
    groups = own.select(F.col("lang").alias("_lang"), "source").distinct()
    bins = merged.join(groups, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")
    mine = own.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("bin").alias("_bin"), "n")
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("bin") == F.col("_bin"))
    weight = F.coalesce("n", F.lit(0)) * 1000 + F.floor(F.lit(1000 * prior) * F.col("m") / F.col("all")).cast("long")
    rows = bins.join(mine, same, "left").select("lang", "source", bin_top(F.col("bin")).alias("top"), weight.alias("w")).filter("w > 0")
    rows = rows.withColumn("x", F.floor(100 * F.log1p("top")).cast("long"))
    group = Window.partitionBy("lang", "source")
    upto = group.orderBy("top").rowsBetween(Window.unboundedPreceding, 0)
    sums = {"w": F.col("w"), "s": F.col("w") * F.col("x"), "q": F.col("w") * F.col("x") * F.col("x")}
    rows = rows.withColumns({f"{k}_all": F.sum(c).over(group) for k, c in sums.items()} | {f"{k}_low": F.sum(c).over(upto) for k, c in sums.items() if k != "q"} | {"next": F.lead("top").over(group.orderBy("top"))})
    a, b = F.col("w_low").cast("double"), (F.col("w_all") - F.col("w_low")).cast("double")
    apart = F.col("s_low") / a - (F.col("s_all") - F.col("s_low")) / b
    rows = rows.withColumn("told", F.when(F.col("next").isNotNull(), a * b / F.col("w_all") * apart * apart))
    best = rows.groupBy("lang", "source").agg(F.max(F.struct("told", (-F.col("top")).alias("top"), "next")).alias("at"), F.max("w_all").alias("w"), F.max("s_all").alias("s"), F.max("q_all").alias("q"))
    variance = F.col("q") - F.col("s").cast("double") * F.col("s") / F.col("w")
    middle = F.floor(F.sqrt((1 - F.col("at.top")) * (1 + F.col("at.next")))).cast("long") - 1
    return best.select("lang", "source", F.when(F.col("at.told") * 100 >= TOLD * variance, middle).alias("cut"))


def thresholds(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """One row per (lang, source) with the highest accepted rate of each rule, null where a rule has none.

    The language's quantiles, from its merged sketch, weigh as `prior` documents. The distance of the
    quantiles counts as one at least, the width of the narrowest bin.
    """
    merged = sketch.groupBy("lang", "rule", "bin").agg(F.sum("n").alias("n"))
    whole = quantiles(merged, ["lang"]).select(F.col("lang").alias("_lang"), F.col("rule").alias("_rule"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    own = quantiles(sketch, ["lang", "source"]).join(whole, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("rule") == F.col("_rule")))
    drawn = lambda c: F.floor((F.col("n") * F.col(c) + prior * F.col(f"_{c}")) / (F.col("n") + prior)).cast("long")
    both = own.withColumn("low", drawn("low")).withColumn("high", drawn("high"))
    cut = F.col("high") + _of_rule(4) * F.greatest(F.col("high") - F.col("low"), F.lit(1))
    cuts = both.select("lang", "source", "rule", cut.alias("cut"))
    for k, v in RULES.items():
        if len(v) == 2:
            cuts = cuts.filter(F.col("rule") != k).unionByName(parted(sketch, k, prior).select("lang", "source", F.lit(k).alias("rule"), "cut"))
    return cuts.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rule") == k, F.col("cut"))).alias(f"max_{k}") for k in RULES])


def judge(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """counts() with each group's thresholds, base_failed and kept.

    base_failed: fewer than 50 words, or over half of the words in repeated windows. kept: not
    base_failed and no rate above its threshold. Null, empty and wordless texts fail the base; a null
    language or source is a group of its own; equal rows are judged alike; a group whose texts all
    fail the base has no thresholds; an empty table gives no rows; further columns of docs are ignored.
    """
    counted = materialize(counts(docs))
    cuts = thresholds(sketches(counted), prior).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = counted.join(cuts, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")
    passed = F.lit(True)
    for k in RULES:
        passed = passed & F.coalesce(rate(k) <= F.col(f"max_{k}"), F.lit(True))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(passed, F.lit(False)))


def filter_quality(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """The rows of docs that judge() keeps, columns as they were.

    Rows are told apart by doc_id, language, source and the text's hash, so of different rows with one doc_id each has its own verdict.
    """
    key, mine = fresh(docs, "_key", "_mine")
    name = F.struct("doc_id", F.col("lang").cast("string").alias("l"), F.col("source").cast("string").alias("s"), F.xxhash64(F.col("text").cast("string")).alias("t"))
    named = docs.withColumn(mine, name)
    kept = judge(docs.select(name.alias("doc_id"), "lang", "source", "text"), prior).filter("kept").select(F.col("doc_id").alias(key)).distinct()
    return named.join(materialize(kept), F.col(mine).eqNullSafe(F.col(key)), "left_semi").drop(mine)


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    def rate(k: str) -> str:
        return f"({RULES[k][0]} * 100 // greatest({RULES[k][1]}, 1))"

    def bin_(v: str) -> str:
        shift = f"greatest(length(bin({v})) - {(2 * BINS - 1).bit_length()}, 0)"
        return f"({shift} * {2 * BINS} + ({v} >> {shift}::int))::bigint"

    def top(b: str) -> str:
        return f"((({b}) % {2 * BINS} + 1) << (({b}) // {2 * BINS})::int) - 1"

    def of_rule(i: int) -> str:
        return "CASE rule " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in RULES.items() if len(v) > 2) + " END"

    def quantiles(group: str, sketch: str) -> str:
        w = f"OVER (PARTITION BY {group}, rule"
        sums = f"SELECT *, sum(n) {w} ORDER BY bin) AS upto, sum(n) {w}) AS total FROM {sketch}"
        least = lambda i: top(f"min(CASE WHEN upto * 100 >= total * {of_rule(i)} THEN bin END)")
        return f"SELECT {group}, rule, max(total) AS n, {least(2)} AS low, {least(3)} AS high FROM ({sums}) GROUP BY {group}, rule"

    rules = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS rule, {bin_(rate(k))} AS bin FROM d WHERE NOT base_failed" for k in RULES)
    drawn = lambda c: f"((q.n * q.{c} + {PRIOR} * l.{c}) // (q.n + {PRIOR}))::bigint"
    cuts = ", ".join(f"max(CASE WHEN rule = '{k}' THEN high + {v[4]} * greatest(high - low, 1) END) AS max_{k}" for k, v in RULES.items() if len(v) > 2)
    passed = " AND ".join(f"coalesce({rate(k)} <= max_{k}, TRUE)" for k in RULES)

    def parted(k: str) -> str:
        """The CTE of a rule that is cut between two clusters."""
        group = "PARTITION BY lang, source"
        weighed = f"""SELECT l.lang, g.source, {top("l.bin")} AS top, coalesce(b.n, 0) * 1000 + floor({1000 * PRIOR} * l.m / l.all_)::bigint AS w
          FROM (SELECT lang, bin, sum(n) AS m, sum(sum(n)) OVER (PARTITION BY lang) AS all_ FROM b WHERE rule = '{k}' GROUP BY lang, bin) l
          JOIN (SELECT DISTINCT lang, source FROM b WHERE rule = '{k}') g ON g.lang IS NOT DISTINCT FROM l.lang
          LEFT JOIN b ON b.rule = '{k}' AND b.bin = l.bin AND b.lang IS NOT DISTINCT FROM l.lang AND b.source IS NOT DISTINCT FROM g.source"""
        summed = f"""SELECT *, sum(w) OVER ({group}) AS wa, sum(w * x) OVER ({group}) AS sa, sum(w * x * x) OVER ({group}) AS qa,
          sum(w) OVER ({group} ORDER BY top) AS wl, sum(w * x) OVER ({group} ORDER BY top) AS sl, lead(top) OVER ({group} ORDER BY top) AS nxt
          FROM (SELECT *, floor(100 * ln(1 + top))::bigint AS x FROM ({weighed}) WHERE w > 0)"""
        told = f"""SELECT *, CASE WHEN nxt IS NOT NULL THEN wl::double * (wa - wl)::double / wa * (sl / wl::double - (sa - sl) / (wa - wl)::double) * (sl / wl::double - (sa - sl) / (wa - wl)::double) END AS told FROM ({summed})"""
        return f"""SELECT lang, source, CASE WHEN told * 100 >= {TOLD} * (qa - sa::double * sa / wa) THEN floor(sqrt((1 + top) * (1 + nxt)))::bigint - 1 END AS max_{k}
          FROM ({told}) QUALIFY row_number() OVER ({group} ORDER BY told DESC NULLS LAST, top) = 1"""

    cut_off = {k: parted(k) for k, v in RULES.items() if len(v) == 2}
    splits = ",\n".join(f"p_{k} AS ({q})" for k, q in cut_off.items())
    joins = " ".join(f"LEFT JOIN p_{k} ON p_{k}.lang IS NOT DISTINCT FROM d.lang AND p_{k}.source IS NOT DISTINCT FROM d.source" for k in cut_off)
    more = ", ".join(f"p_{k}.max_{k}" for k in cut_off)
    return rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
a AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT doc_id, i, list_aggregate(w[i:i+2], 'string_agg', ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM a)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY doc_id),
c AS (SELECT a.doc_id, lang, source, len(w)::bigint AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols, len(lines)::bigint AS n_lines,
             (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines, coalesce(cov.n, 0)::bigint AS n_repeat_words
      FROM a LEFT JOIN cov ON cov.doc_id = a.doc_id),
d AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c),
b AS (SELECT lang, source, rule, bin, count(*) AS n FROM ({rules}) GROUP BY ALL),
q AS ({quantiles("lang, source", "b")}),
l AS ({quantiles("lang", "(SELECT lang, rule, bin, sum(n) AS n FROM b GROUP BY ALL)")}),
v AS (SELECT q.lang, q.source, q.rule, {drawn("low")} AS low, {drawn("high")} AS high FROM q JOIN l ON l.lang IS NOT DISTINCT FROM q.lang AND l.rule = q.rule),
x AS (SELECT lang, source, {cuts} FROM v GROUP BY ALL),
{splits},
f AS (SELECT d.*, x.* EXCLUDE (lang, source), {more} FROM d LEFT JOIN x ON x.lang IS NOT DISTINCT FROM d.lang AND x.source IS NOT DISTINCT FROM d.source {joins})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({passed}, FALSE) AS kept FROM f"""


ORACLE_SQL = _sql()
