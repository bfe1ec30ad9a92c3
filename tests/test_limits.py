"""Rate limits against a plain scan of each identity."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tablewright.streaming import events as E
from tablewright.streaming import limits as L

START = dt.datetime(2024, 1, 1)


def made(seed):
    """Pauses, bursts, equal moments, moments exactly a window apart, and an identity with most events."""
    r = random.Random(seed)
    rows, i = [], 0
    for who in ["a", "b", "c", "hot"]:
        t = 0.0
        for _ in range(400 if who == "hot" else 40):
            t += r.choice([0, 0, 1, 5, 20, 60, 60, 61, 300]) if who != "hot" else r.choice([0, 1, 3, 7, 40])
            rows.append((i, who, START + dt.timedelta(seconds=t)))
            i += 1
    return rows + [(i, None, START), (i + 1, "d", None), (i + 2, "d", START)]


def us(ts):
    return (ts - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def by_identity(rows):
    out = {}
    for i, who, ts in sorted((x for x in rows if x[1] is not None and x[2] is not None), key=lambda x: (x[2], x[0])):
        out.setdefault(who, []).append((us(ts), i))
    return out


def plain_windows(rows, span):
    for who, events in by_identity(rows).items():
        start, n = None, 0
        for t, _ in events:
            if start is not None and t >= start + span:
                yield who, start, n
                start = None
            start, n = (t, 1) if start is None else (start, n + 1)
        yield who, start, n


def plain_log(rows, span, limit):
    for who, events in by_identity(rows).items():
        log = []
        for t, i in events:
            log = [q for q in log if t - q < span]
            if len(log) < limit:
                log.append(t)
                yield i, who, True, None
            else:
                yield i, who, False, max(1, (span - (t - log[0])) // 1_000_000)


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id long, who string, ts timestamp_ntz").repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_windows(spark, seed):
    rows = made(seed)
    got = L.first_event_windows(frame(spark, rows), "who", 60).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_windows(rows, 60_000_000))


@pytest.mark.parametrize("limit", [1, 3])
def test_log(spark, limit):
    rows = made(limit)
    got = L.admitted_log(frame(spark, rows), "who", 60, limit).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_log(rows, 60_000_000, limit))


def test_empty_and_bad_limit(spark):
    nothing = frame(spark, made(1)).where("false")
    assert L.first_event_windows(nothing, "who", 60).count() == 0 and L.admitted_log(nothing, "who", 60, 2).count() == 0
    with pytest.raises(ValueError):
        L.admitted_log(nothing, "who", 60, 0)


def test_streams_carry_state(spark, tmp_path):
    """Several micro-batches, each out of order within the lateness: what the watermark has passed equals the batch form."""
    rows = [r for r in made(5) if r[1] is not None and r[2] is not None]
    source = str(tmp_path / "in")
    rows.sort(key=lambda r: (r[2] + dt.timedelta(seconds=r[0] * 37 % 100), r[0]))
    for k in range(4):
        frame(spark, rows[k * len(rows) // 4:(k + 1) * len(rows) // 4]).coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    mark = us(max(r[2] for r in rows)) - 120_000_000
    for name, build, want in (
        ("w", lambda df: L.first_event_windows_stream(df, "who", 60, "2 minutes"), [w for w in plain_windows(rows, 60_000_000) if w[1] + 60_000_000 <= mark]),
        ("l", lambda df: L.admitted_log_stream(df, "who", 60, 3, "2 minutes"), [v for v in plain_log(rows, 60_000_000, 3) if {r[0]: us(r[2]) for r in rows}[v[0]] < mark])):
        out = str(tmp_path / name)
        E.run_to_end(build(E.read_events(spark, source, schema, "*.parquet")), out + "/ckpt", E.save_batch(out + "/data"))
        got = spark.read.parquet(out + "/data").drop("batch").withColumn("x", F.lit(0)).drop("x").collect()
        assert sorted(tuple(r) for r in got) == sorted(want)
