"""Queries of streams by event time on the driver's events, which come in three parts: the older half, the newer half, and some of the older half much too late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.shared import folder, table
from tessera.streaming import sessions

#: Milliseconds of silence that end a session, and by which rows may come late.
GAP, DELAY = 6 * 3_600_000, 12 * 3_600_000
LATE = 97


def _run(spark: SparkSession, sf: str) -> tuple[list[dict], DataFrame]:
    """The parts one after the other through one query that is started anew for each; what each run tells, and all sessions."""
    rows = table(spark, sf, "events").select("event_id", "user_id", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))").alias("at"), "value")
    n = rows.count()
    late = (F.col("event_id") * 2 < n) & (F.col("event_id") % LATE == 0)
    parts = [(F.col("event_id") * 2 < n) & ~late, F.col("event_id") * 2 >= n, late]
    base, told = folder(spark), []
    for part in parts:
        rows.filter(part).write.mode("append").parquet(f"{base}/in")
        query = sessions.run_sessions(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/at", key="user_id", millis="at", value="value", gap=GAP, delay=DELAY)
        query.awaitTermination()
        told.append(sessions.counted(query))
    return told, spark.read.parquet(f"{base}/out")


def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of users that are over by the watermark; late rows change none."""
    return _run(spark, sf)[1].select("user_id", "first", "last", "rows", F.round("total", 2).alias("total"))


def late_events(spark: SparkSession, sf: str) -> DataFrame:
    """Rows read and rows too late of each run, and how many users still have an open session at the end."""
    told, _ = _run(spark, sf)
    return spark.createDataFrame([(i, t["read"], t["late"], t["open"] if i == 2 else None) for i, t in enumerate(told)], "run int, read long, late long, open long")


QUERIES = {f.__name__: f for f in (event_sessions, late_events)}

_SESSIONS = f"""rows_ AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms, coalesce(value, 0) AS value, CASE WHEN event_id * 2 >= count(*) OVER () THEN 1 WHEN event_id % {LATE} = 0 THEN 2 ELSE 0 END AS part FROM events),
steps AS (SELECT *, CASE WHEN ms > lag(ms) OVER (PARTITION BY user_id ORDER BY ms) + {GAP} THEN 1 ELSE 0 END AS new FROM rows_ WHERE part < 2 AND user_id IS NOT NULL),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms) AS k FROM steps),
spans AS (SELECT user_id, min(ms) AS first, max(ms) AS last, count(*) AS "rows", round(sum(value), 2) AS total FROM grouped GROUP BY user_id, k)"""
_OVER = f"last + {GAP} < (SELECT max(ms) - {DELAY} FROM rows_)"
ORACLE_SQL = {
    "event_sessions": f'WITH {_SESSIONS} SELECT user_id, first, last, "rows", total FROM spans WHERE {_OVER}',
    "late_events": f"WITH {_SESSIONS} SELECT part::INT AS run, count(*) AS read, count(*) FILTER (part = 2) AS late, CASE part WHEN 2 THEN (SELECT count(DISTINCT user_id) FROM spans WHERE NOT {_OVER}) END AS open FROM rows_ GROUP BY part",
}
