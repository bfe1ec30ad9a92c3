"""Stream forms against their batch forms on small sources."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablewright.streaming import events as E
from tablewright.streaming.keyed import KeyedTable


def test_callbacks_roll_jobs_forward(spark, tmp_path):
    at = [dt.datetime(2024, 1, 1, 10, m) for m in range(6)]
    rows = [(1, "a", at[0], "running", None, {"progress": "10"}), (1, "b", at[1], "completed", None, {"progress": "100", "intent_id": "hacked"}),
            (1, "b", at[1], "completed", None, {"progress": "100", "intent_id": "hacked"}), (2, "c", at[2], "complete", "boom", {"note": "x"})]
    df = spark.createDataFrame(rows, "job_id long, event_id string, ts timestamp_ntz, status string, error string, summary map<string,string>")
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    df.repartition(3).write.parquet(source)
    E.run_to_end(E.read_events(spark, source, df.schema, "*.parquet"), str(tmp_path / "ckpt"), E.roll_forward_into(log))
    jobs = spark.createDataFrame([(1, "queued", {"intent_id": "old"}), (2, "queued", None), (3, "queued", {"k": "v"})], "job_id long, status string, summary map<string,string>")
    got = {r.job_id: (r.status, r.summary) for r in E.rolled_forward(spark, log, jobs).collect()}
    assert got == {1: ("succeeded", {"intent_id": "old", "progress": "100", "status": "succeeded"}), 2: ("failed", {"note": "x", "status": "failed"}), 3: ("queued", {"k": "v"})}


def newest(rows):
    out = {}
    for k, ts, v in rows:
        out[k] = max(out.get(k, (ts, v)), (ts, v))
    return sorted((k, *x) for k, x in out.items())


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(1, 5, "x"), (1, 7, "y"), (2, 1, "z")]
    df = spark.createDataFrame(rows, "k long, ts long, v string")
    write = E.upsert_into(path, ["k"], ["ts"])
    write(df, 0)
    write(df.withColumn("ts", F.col("ts") + 100), 0)
    write(df.where("k = 2").withColumn("ts", F.col("ts") + 9), 1)
    assert sorted(tuple(r) for r in E.current(spark, path, ["k"], ["ts"]).select("k", "ts", "v").collect()) == [(1, 7, "y"), (2, 10, "z")]


def test_keyed_table_stays_small(spark, tmp_path):
    """Many batches over few keys: few segments, and reading costs about the live keys."""
    table, rows = KeyedTable(spark, str(tmp_path / "table"), ["k"], ["ts"]), []
    for batch in range(12):
        new = [(k, batch * 10 + k % 3, f"{batch}.{k}") for k in range(batch % 5, 40, 1 + batch % 4)]
        rows += new
        table.merge(spark.createDataFrame(new, "k long, ts long, v string"), batch)
        _, parts = table.segments()
        assert sum(n for _, n in parts) <= 2 * 40 + 40 and all(a[1] > 2 * b[1] for a, b in zip(parts, parts[1:]))
    assert sorted(tuple(r) for r in table.read().collect()) == newest(rows)
    assert table.clean() > 0
    assert sorted(tuple(r) for r in table.read().collect()) == newest(rows) and table.clean() == 0


def test_killed_before_the_swap(spark, tmp_path, monkeypatch):
    """A batch whose segment is written but not published is not there, and runs again as if for the first time."""
    table = KeyedTable(spark, str(tmp_path / "table"), ["k"], ["ts"])
    one, two = [(1, 1, "a"), (2, 1, "b")], [(2, 5, "c"), (3, 1, "d")]
    frame = lambda rows: spark.createDataFrame(rows, "k long, ts long, v string")
    table.merge(frame(one), 0)
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            table.merge(frame(two), 1)
    assert sorted(tuple(r) for r in table.read().collect()) == newest(one) and table.segments()[0] == 0
    table.merge(frame(two), 1)
    assert sorted(tuple(r) for r in table.read().collect()) == newest(one + two)


def test_late_rows_are_kept_aside(spark, tmp_path):
    """Rows behind the newest time of earlier batches by more than the bound go aside, also when a batch runs again."""
    path, at = str(tmp_path), lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    batches = [[(1, at(50)), (2, at(1))], [(3, at(39)), (4, at(40)), (5, None), (6, at(60))], [(7, at(49)), (8, at(51))]]
    kept = []
    sink = E.late_aside(path, "10 hours", lambda df, b: kept.append((b, sorted(r[0] for r in df.collect()))))
    for b in (0, 1, 1, 2):
        sink(spark.createDataFrame(batches[b], "id long, ts timestamp_ntz"), b)
    assert kept == [(0, [1, 2]), (1, [4, 5, 6]), (1, [4, 5, 6]), (2, [8])]
    assert sorted((r.id, r.batch) for r in E.late_rows(spark, path).collect()) == [(3, 1), (7, 2)]


def test_callback_words(spark):
    rows = [("complete", None, None, None), ("completed", " ", ["", None], None), ("succeeded", None, ["x"], "complete"), ("complete", "boom", None, "quarantined"), ("running", None, None, "Partial"),
            ("nonsense", None, None, "complete"), (None, None, None, None), ("awaiting_confirmation", "e", None, "other"), ("partial", None, None, "completed")]
    df = spark.createDataFrame(rows, "s string, e string, es array<string>, r string")
    got = [r[0] for r in df.select(E.callback_status(F.col("s"), F.col("e"), F.col("es"), F.col("r"))).collect()]
    assert got == ["succeeded", "succeeded", "failed", "failed", "failed", None, None, "awaiting_confirmation", "succeeded"]


def test_sessions_expire_by_buckets(spark, tmp_path):
    """State is kept for buckets of sessions; each session still ends by its own first time, in whatever batch that comes."""
    at = dt.datetime(2024, 1, 1, 10)
    minute = lambda m: at + dt.timedelta(minutes=m)
    big = (1 << 53) + 1
    batches = [[(i, minute(i % 7)) for i in range(3000)] + [(None, minute(3)), (big, minute(5)), (7, None)], [(5, minute(1)), (big, minute(4)), (9000, minute(95))], [(9001, minute(300))], [(5, minute(290))]]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    seen = []
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "session_id long, ts timestamp")
        df.coalesce(1).write.mode("append").parquet(source)
        E.run_to_end(E.expire_sessions(E.read_events(spark, source, df.schema), "1 hour"), str(tmp_path / "ckpt"), lambda df, b, i=i: df.write.parquet(f"{out}/{i}-{b}"))
        seen.append(spark.read.format("statestore").load(str(tmp_path / "ckpt")).count())
    assert 0 < seen[0] <= E.BUCKETS
    got = sorted(map(tuple, spark.read.parquet(f"{out}/*").collect()), key=str)
    first = {**{i: minute(i % 7) for i in range(3000)}, None: minute(3), big: minute(4), 9000: minute(95), 5: minute(1)}
    want = [(k, t + dt.timedelta(minutes=30), "quarantined") for k, t in first.items()]
    assert got == sorted(want, key=str)
