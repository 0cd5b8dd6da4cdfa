"""Sessions against a plain loop over sorted rows."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.streaming import sessions as s

GAP, DELAY = 1000, 5000
SCHEMA = "who string, at long, v double"
HOW = {"key": "who", "millis": "at", "value": "v", "gap": GAP, "delay": DELAY}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 9)), max_size=30), st.integers(0, 30))
def test_merged_in_any_order(rows, cut):
    """Merging in two steps, in whatever order, is merging at once."""
    spans = [(t, t, 1, v) for t, v in rows]
    whole = s.merged(spans, 3)
    assert s.merged([*s.merged(spans[cut:], 3), *spans[:cut]], 3) == whole
    assert sum(n for _, _, n, _ in whole) == len(rows) and all(a[1] + 3 < b[0] for a, b in zip(whole, whole[1:], strict=False))


def plain(rows, end: int) -> set:
    """Sessions that a watermark of `end` has closed."""
    out, by = set(), {}
    for who, at, v in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1])):
        by.setdefault(who, []).append((at, v or 0.0))
    for who, seen in by.items():
        group = []
        for at, v in [*seen, (1 << 60, 0.0)]:
            if group and at > group[-1][0] + GAP:
                if group[-1][0] + GAP < end:
                    out.add((who, group[0][0], group[-1][0], len(group), round(sum(x for _, x in group), 6)))
                group = []
            group.append((at, v))
    return out


def test_restarts_late_rows_and_expiry(spark, tmp_path):
    """Each run takes up the state of the one before; late rows are counted and change nothing; silent keys leave no state."""
    rng = np.random.default_rng(2)
    rows = [(f"u{rng.integers(0, 8)}", int(t), float(v)) for t, v in zip(np.sort(rng.integers(0, 60_000, 400)), rng.integers(0, 9, 400), strict=True)]
    parts = [rows[:150][::-1], [*rows[150:], (None, 100_000, 1.0), ("u1", None, 1.0), ("u2", 59_999, None)], [("late", 10, 1.0), ("u1", 500, 7.0)], [("end", 100_000, 0.0)]]
    told = []
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = s.run_sessions(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "at"), **HOW)
        q.awaitTermination()
        told.append(s.counted(q))
        got = [(r.who, r.first, r.last, r["rows"], round(r.total, 6)) for r in spark.read.schema("who string, first long, last long, rows long, total double").parquet(str(tmp_path / "out")).collect()]
        seen = [r for p in (0, 1, 3)[: i + 1 if i < 2 else i] for r in parts[p]]
        newest = max(r[1] for r in seen if r[0] is not None and r[1] is not None)
        assert len(got) == len(set(got)) and set(got) == plain(seen, newest - DELAY), i
    assert [t["late"] for t in told] == [0, 0, 2, 0]
    assert told[0]["open"] > 0 and told[3]["open"] == 1  # of the last part's own key


def test_states_are_fewer_than_keys(spark, tmp_path):
    """Python is handed a bounded number of states, not one for each key; open keys are still counted as keys."""
    rows = [(f"u{i}", at, 1.0) for i in range(400) for at in ((10, 5_000) if i % 2 else (10,))]
    spark.createDataFrame([*rows, ("end", 9_000, 0.0)], SCHEMA).write.parquet(str(tmp_path / "in"))
    q = s.run_sessions(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "at"), **HOW, buckets=16)
    q.awaitTermination()
    assert max(int(o["numRowsUpdated"]) for p in q.recentProgress for o in p["stateOperators"]) <= 16
    assert s.counted(q)["open"] == 201 and spark.read.parquet(str(tmp_path / "out")).agg({"rows": "sum"}).first()[0] == 400
