"""Bursts of a table are those of a loop over its events in order."""

import random

from pyspark.sql import functions as F

from stackroom.streaming import live as Y


def loop(rows, gap):
    out = []
    for at, path, flags in sorted(rows, key=lambda r: r[0]):
        if not out or at - out[-1][1] >= gap:
            out.append([at, at, 0, set(), False])
        b = out[-1]
        b[1], b[2], b[4] = at, b[2] + 1, b[4] or bool(flags & Y.DROPPED)
        b[3] |= {path} - {None}
    return sorted((a, z + gap, n, len(p), d) for a, z, n, p, d in out)


def test_bursts_as_a_loop(spark, monkeypatch):
    monkeypatch.setattr(Y, "SPAN", 3)
    rng = random.Random(5)
    at, rows = -3_000_000, []
    for i in range(400):
        at += rng.choice([0, 1, 700_000, 799_999, 799_999, 800_000, 801_000, 9_000_000])
        rows.append((at, rng.choice(["/a", "/b", "/c", None]), 2 if i % 50 == 0 else 256))
    events = spark.createDataFrame(rows, "at long, path string, flags int").select(F.timestamp_micros("at").alias("ts"), "path", "flags")
    out = Y.debounced(events)
    got = sorted(tuple(r) for r in out.select(F.unix_micros("start"), F.unix_micros("end"), "events", "paths", "dropped").collect())
    assert got == loop(rows, 800_000)
    assert Y.debounced(events.where("false")).count() == 0
    assert "session_window" not in out._jdf.queryExecution().toString()
