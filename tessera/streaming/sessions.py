"""Sessions of events by event time: rows of a key that follow each other within a gap, closed by the watermark.

The state is the open sessions; a timer closes each when the watermark has passed its end by the gap, so a key that is silent
leaves no state behind. Keys share a state by their hash: Spark hands each state to Python by itself, which costs milliseconds
whatever it holds, so there are BUCKETS of them, not one for each key, and the sessions of a bucket are joined as columns. Rows
later than the watermark are dropped by Spark before they reach the state and counted in the query's progress.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TIME, BUCKET = "_time", "_bucket"
#: States that the keys are dealt to; a checkpoint keeps to the number it began with.
BUCKETS = 512
SPAN = ("first", "last", "rows", "total")


def joined(spans: pd.DataFrame, gap: int) -> pd.DataFrame:
    """Spans (key, first, last, rows, total) of each key joined where the next begins no later than the gap after the last row."""
    if spans.empty:
        return spans
    key = pd.factorize(spans["key"], use_na_sentinel=False)[0]
    first, last, rows, total = (spans[c].to_numpy() for c in SPAN)
    order = np.lexsort((total, rows, last, first, key))
    key, first, last = key[order], first[order], last[order]
    latest = pd.Series(last).groupby(key).cummax().to_numpy()
    at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (first[1:] > latest[:-1] + gap)]))
    summed = [np.maximum.reduceat(last, at), np.add.reduceat(rows[order], at), np.add.reduceat(total[order], at)]
    return pd.DataFrame({"key": spans["key"].iloc[order[at]].reset_index(drop=True), **dict(zip(SPAN, [first[at], *summed], strict=True))})


def merged(spans: list[tuple[int, int, int, float]], gap: int) -> list[tuple[int, int, int, float]]:
    """Spans (first, last, rows, total) of one key, joined."""
    one = joined(pd.DataFrame(spans, columns=SPAN).assign(key=0), gap)
    return list(zip(*(one[c].tolist() for c in SPAN), strict=True))


def sessions(events: DataFrame, key: str, millis: str, value: str, gap: int, delay: int, buckets: int = BUCKETS) -> DataFrame:
    """(key, first, last, rows, total) of each session of a stream that is over.

    millis: a long column, milliseconds since 1970; gap and delay in milliseconds. Rows may come out of order by up to the delay: a
    session is given out when the watermark (the latest row less the delay) is past its last row by more than the gap, and
    later rows can't join it. Rows without key or time are dropped; a null value counts as zero.
    """
    kind = events.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), *[T.StructField(c, T.LongType()) for c in SPAN[:3]], T.StructField("total", T.DoubleType())])
    held = T.StructType([T.StructField("key", T.ArrayType(kind)), *[T.StructField(c, T.ArrayType(T.LongType())) for c in SPAN[:3]], T.StructField("total", T.ArrayType(T.DoubleType()))])

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spans = pd.DataFrame(dict(zip(("key", *SPAN), state.get, strict=True))) if state.exists else None
        new, n = [], 0
        for f in frames:
            if len(f):
                new.append(joined(pd.DataFrame({"key": f["key"], "first": f["t"], "last": f["t"], "rows": 1, "total": f["v"]}), gap))
                n += len(new[-1])
                # Joined once there are as many as before, so that a long bucket isn't gone through for each frame.
                if spans is not None and n >= len(spans):
                    spans, new, n = joined(pd.concat([spans, *new], ignore_index=True), gap), [], 0
                spans = new.pop() if spans is None else spans
        if new:
            spans = joined(pd.concat([spans, *new], ignore_index=True), gap)
        if spans is None:
            return
        now = state.getCurrentWatermarkMs()
        over = spans["last"] + gap < now
        open_ = spans[~over]
        if len(open_):
            state.update(tuple(open_[c].tolist() for c in ("key", *SPAN)))
            state.setTimeoutTimestamp(max(int(open_["last"].min()) + gap, now + 1))
        elif state.exists:
            state.remove()
        if over.any():
            yield spans[over].set_axis(out.names, axis=1)

    rows = events.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias(BUCKET), F.col(key).alias("key"), F.col(millis).cast("long").alias("t"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"), F.timestamp_millis(F.col(millis)).alias(TIME))
    timed = rows.filter(F.col("key").isNotNull() & F.col("t").isNotNull()).withWatermark(TIME, f"{delay} milliseconds")
    return timed.groupBy(BUCKET).applyInPandasWithState(step, out, held, "append", GroupStateTimeout.EventTimeTimeout)


def run_sessions(events: DataFrame, output: str, checkpoint: str, **how) -> StreamingQuery:
    """Append the sessions of what there is to a parquet folder; the checkpoint knows what is done, open sessions and the watermark."""
    query = sessions(events, **how).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(output)
    query._tessera_state = events.sparkSession, checkpoint
    return query


def open_keys(spark: SparkSession, checkpoint: str) -> int:
    """Keys that have an open session, from the states of the last batch; no two states have the same key."""
    held = spark.read.format("statestore").load(checkpoint).select(F.size(F.array_distinct("value.groupState.key")).alias("n"))
    return held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def counted(query: StreamingQuery) -> dict[str, int]:
    """Of a query of run_sessions, of its batches so far that Spark still tells: rows read, rows that came too late, keys that hold state at the end."""
    told = [p for p in query.recentProgress]
    state = [s for p in told for s in p["stateOperators"]]
    return {"read": sum(int(p["numInputRows"]) for p in told), "late": sum(int(s["numRowsDroppedByWatermark"]) for s in state), "open": open_keys(*query._tessera_state) if state and int(state[-1]["numRowsTotal"]) else 0}
