"""URL filters by a temporal list join.

Dated entries (added, removed) become validity intervals of their key; a capture asks for its host,
the host's parent domains and its host with path prefixes, and an as-of join keeps what was active at
fetch time. Both sides meet on the key, so a list of any size works and no list is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table

#: Fixed values of the query's list, beside those that it takes from the pages: (key, date, action, reason). A key is a domain or a domain with a path.
LIST = (
    ("casino-win.example.com", "2024-01-15", "add", "gambling"),
    ("casino-win.example.com", "2024-09-01", "remove", "gambling"),
    ("casino-win.example.com", "2025-03-01", "add", "gambling"),
    ("cheap-pills.example.com", "2024-02-01", "add", "pharmacy"),
    ("free-bets.example.com", "2024-06-01", "add", "gambling"),
    ("free-bets.example.com", "2025-06-15", "remove", "gambling"),
    ("m.casino-win.example.com", "2024-01-01", "add", "mobile"),
    ("example.org/de", "2025-01-01", "add", "section"),
    ("example.org/de", "2025-02-01", "remove", "section"),
)
#: The query's fetch day: pages have no time of their own, so page_id deals them over these days.
FIRST_DAY, DAYS = "2024-01-01", 730
#: Most path parts of a key that the query lists; judge() takes the list's own depth.
PARTS = 3
#: One key in so many is listed, for one of so many reasons, and stays listed or off for so many days.
LISTED, REASONS, SPELL = 4, 5, 200


def intervals(entries: DataFrame) -> DataFrame:
    """(key, reason, valid_from, valid_to): from each addition to the key's next entry for the reason.

    entries: key, day, action ('add' or 'remove'), reason; the last of a day's entries by action
    counts, removal after addition; a null key or day takes no part.
    """
    one = entries.filter("key is not null and day is not null").groupBy(F.lower("key").alias("key"), "reason", "day").agg(F.max("action").alias("action"))
    then = F.lead("day").over(Window.partitionBy("key", "reason").orderBy("day"))
    return one.withColumn("valid_to", then).filter("action = 'add'").select("key", "reason", F.col("day").alias("valid_from"), "valid_to")


#: Scheme and user of a URL, its host (an address in brackets whole), what follows up to the path, and the path.
_START, _HOST, _REST, _PATH = r"(?i)^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?", r"(\[[^\]/?#]*\]|[^/?#:]*)", r"[^/?#]*", r"([^?#]*)"


def keys_of(url: Column, parts: int = PARTS) -> Column:
    """Every key that a URL falls under: host and parent domains, each alone and with leading path parts.

    Case is ignored throughout, and a dot at the host's end; an address of numbers has no parents.
    """
    host = F.rtrim(F.lower(F.regexp_extract(url, _START + _HOST, 1)), F.lit("."))
    labels = F.when(host.rlike(r"^\[|^[0-9.]+$"), F.array(host)).otherwise(F.split(host, r"\."))
    hosts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.filter(F.split(F.lower(F.regexp_extract(url, _START + _HOST + _REST + _PATH, 2)), "/"), lambda p: p != "")
    tails = F.transform(F.sequence(F.lit(0), F.least(F.size(path), F.lit(parts))), lambda n: F.array_join(F.concat(F.array(F.lit("")), F.slice(path, 1, n)), "/"))
    return F.when(host != "", F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(tails, lambda t: F.concat(h, t))))))


def judge(captures: DataFrame, entries: DataFrame, parts: int | None = None) -> DataFrame:
    """(capture_id, blocked, n_hits, reasons) of every capture (capture_id, url, fetched).

    A key matches where valid_from <= fetched < valid_to (open where null). Null, empty and malformed
    URLs and captures without a fetch day match nothing; captures that repeat an id are judged
    together; an empty list blocks nothing; other columns are ignored. Captures ask for as many path
    parts as the list's deepest key has, or for `parts`.
    """
    if parts is None:
        parts = entries.agg(F.max(F.size(F.split("key", "/")) - 1)).first()[0] or 0
    asked = captures.select("capture_id", "fetched", F.explode_outer(keys_of(F.col("url"), parts)).alias("key"))
    on = (asked["key"] == F.col("k.key")) & (asked["fetched"] >= F.col("k.valid_from")) & (F.col("k.valid_to").isNull() | (asked["fetched"] < F.col("k.valid_to")))
    # Written before it is joined, so both sides are plain exchanges and a host of many captures can be split.
    hit = asked.join(materialize(intervals(entries)).alias("k"), on, "left")
    return hit.groupBy("capture_id").agg((F.count("k.key") > 0).alias("blocked"), F.count("k.key").alias("n_hits"), F.array_join(F.array_sort(F.collect_set("k.reason")), ",").alias("reasons"))


def listed(spark) -> DataFrame:
    """The fixed entries."""
    values = ", ".join(f"('{k}', date '{d}', '{a}', '{r}')" for k, d, a, r in LIST)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(key, day, action, reason)")


def entries_of(captures: DataFrame) -> DataFrame:
    """(key, day, action, reason): a list over keys of the captures themselves, by a seeded rule.

    One key in four, of hosts, their parents and paths of up to three parts, is added on a day, removed after a spell and for every other key
    added again after another, so spells of different keys and reasons overlap.
    """
    key = captures.select(F.explode(keys_of(F.col("url"), PARTS)).alias("key")).distinct()
    part = lambda i: F.conv(F.substring(F.md5("key"), 1 + 6 * i, 6), 16, 10).cast("int")
    chosen = key.filter(part(0) % LISTED == 0)
    first, spell = F.date_add(F.lit(FIRST_DAY).cast("date"), part(1) % DAYS), 1 + part(2) % SPELL
    at = lambda day, action: F.struct(day.alias("day"), F.lit(action).alias("action"))
    steps = F.array(at(first, "add"), at(F.date_add(first, spell), "remove"), at(F.date_add(first, 2 * spell), "add"))
    steps = F.slice(steps, F.lit(1), F.when(part(3) % 2 == 0, 3).otherwise(2))
    return chosen.select("key", F.concat(F.lit("rule "), part(4) % REASONS).alias("reason"), F.explode(steps).alias("s")).select("key", "s.day", "s.action", "reason")


def query(spark, sf_dir: str) -> DataFrame:
    fetched = F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod("page_id", F.lit(DAYS)).cast("int"))
    captures = table(spark, sf_dir, "pages").select(F.col("page_id").alias("capture_id"), "url", fetched.alias("fetched"))
    entries = materialize(listed(spark).unionByName(entries_of(captures)))
    return judge(captures, entries).withColumnRenamed("capture_id", "page_id")


ORACLE_SQL = rf"""
WITH p AS (SELECT page_id, DATE '{FIRST_DAY}' + (page_id % {DAYS})::INT AS fetched, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host,
             list_filter(string_split(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '/'), lambda x: x <> '') AS path FROM pages),
l AS (SELECT *, string_split(host, '.') AS labels FROM p),
h AS (SELECT page_id, fetched, path, array_to_string(labels[i:], '.') AS host FROM (SELECT *, unnest(generate_series(1, greatest(len(labels) - 1, 1))) AS i FROM l)),
k AS (SELECT DISTINCT page_id, fetched, host || CASE WHEN n = 0 THEN '' ELSE '/' || array_to_string(path[1:n], '/') END AS key
      FROM (SELECT *, unnest(generate_series(0, least(len(path), {PARTS}))) AS n FROM h)),
n AS (SELECT key, [('0x' || substring(md5(key), 1 + 6 * i, 6))::BIGINT FOR i IN range(5)] AS n FROM (SELECT DISTINCT key FROM k)),
c AS (SELECT key, DATE '{FIRST_DAY}' + (n[2] % {DAYS})::INT AS first, (1 + n[3] % {SPELL})::INT AS spell, n[4] % 2 = 0 AS twice, 'rule ' || (n[5] % {REASONS}) AS reason FROM n WHERE n[1] % {LISTED} = 0),
e AS (SELECT key, reason, day, max(action) AS action FROM (
        SELECT * FROM (VALUES {", ".join(f"('{k}', DATE '{d}', '{a}', '{r}')" for k, d, a, r in LIST)}) t(key, day, action, reason)
        UNION ALL SELECT key, first, 'add', reason FROM c UNION ALL SELECT key, first + spell, 'remove', reason FROM c UNION ALL SELECT key, first + 2 * spell, 'add', reason FROM c WHERE twice) GROUP BY ALL),
v AS (SELECT key, reason, action, day AS valid_from, lead(day) OVER (PARTITION BY key, reason ORDER BY day) AS valid_to FROM e),
m AS (SELECT k.page_id, v.key, v.reason FROM k LEFT JOIN v ON v.key = k.key AND v.action = 'add' AND k.fetched >= v.valid_from AND (v.valid_to IS NULL OR k.fetched < v.valid_to))
SELECT page_id, count(key) > 0 AS blocked, count(key) AS n_hits, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons FROM m GROUP BY page_id"""
