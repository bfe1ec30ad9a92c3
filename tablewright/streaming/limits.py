"""Rate limits per identity, in batch and as streams.

``first_event_windows``: a counter opens at an identity's first event, counts every event for the length of the window, and the first event at or after
its end opens the next one. ``admitted_log``: a log of the admitted events of the last window; an event that finds ``limit`` of them is rejected and does not enter it.

Both start afresh after a pause of a window or more, so time is cut into buckets of the window's length, each (identity, bucket) is counted on its own, and runs of
busy buckets without such a pause are independent. Events without identity or time are not limited and not reported.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.session import durable

SECOND = 1_000_000
HELD = "carry array<long>, at array<long>, ids array<long>"
LATENESS = "1 day"


def micros(ts: str = "ts") -> Column:
    """Microseconds since 1970 of a time without zone (or of UTC)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))


def _busy(moments: DataFrame, who: str, span: int) -> DataFrame:
    """One row for each identity and busy bucket: its first moment, whether it follows a pause, the first moment of the next bucket (null after a
    pause), and the bucket its run began in."""
    per = moments.groupBy(who, "_b").agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"))
    along = W.partitionBy(who).orderBy("_b")
    fresh = F.coalesce(F.col("_first") - F.lag("_last").over(along) >= span, F.lit(True))
    follows = F.lead("_first").over(along)
    marked = per.withColumn("_fresh", fresh).withColumn("_follows", F.when(follows - F.col("_last") < span, follows))
    return durable(marked.withColumn("_run", F.max(F.when(F.col("_fresh"), F.col("_b"))).over(along)))


def window_starts(moments: DataFrame, who: str, span: int) -> DataFrame:
    """(identity, _us) of the moments that open a window.

    Each moment points to the first one at or after its window's end, if no pause lies between. Pointers are doubled until none is left, and then the chains
    from the first moment of every run are marked from the longest jumps to the shortest, so an identity with very many windows is no task of its own.
    """
    per = _busy(moments, who, span)
    nothing = F.lit(None).cast("bigint")
    own = moments.select(who, "_b", F.col("_us").alias("_at"), F.col("_us").alias("_own"), nothing.alias("_from"))
    end = moments.select(who, (F.col("_b") + 1).alias("_b"), (F.col("_us") + span).alias("_at"), nothing.alias("_own"), F.col("_us").alias("_from"))
    onward = W.partitionBy(who, "_b").orderBy("_at").rangeBetween(0, W.unboundedFollowing)
    next_in = own.union(end).withColumn("_near", F.min("_own").over(onward)).where("_from IS NOT NULL").join(per.select(who, "_b", "_follows"), [who, "_b"], "left")
    jumps = [durable(next_in.select(who, F.col("_from").alias("_us"), F.coalesce("_near", "_follows").alias("_to")).where("_to IS NOT NULL"))]
    while True:
        further = jumps[-1].select(who, F.col("_us").alias("_to"), F.col("_to").alias("_next"))
        twice = durable(jumps[-1].join(further, [who, "_to"]).select(who, "_us", F.col("_next").alias("_to")))
        if not twice.limit(1).count():
            break
        jumps.append(twice)
    starts = per.where("_fresh").select(who, F.col("_first").alias("_us"))
    for jump in reversed(jumps):
        starts = durable(starts.unionByName(starts.join(jump, [who, "_us"]).select(who, F.col("_to").alias("_us"))))
    return starts


def first_event_windows(events: DataFrame, who: str, seconds: int) -> DataFrame:
    """identity, start_us and n of every window."""
    span = seconds * SECOND
    timed = events.select(who, micros().alias("_us")).where(F.col(who).isNotNull() & F.col("_us").isNotNull())
    moments = durable(timed.groupBy(who, "_us").agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", F.floor(F.col("_us") / span)))
    starts = window_starts(moments, who, span)
    # a moment's window opened in its own bucket or in the one before
    bucket = F.floor(F.col("_us") / span)
    opened = starts.select(who, F.explode(F.array(bucket, bucket + 1)).alias("_b"), "_us", F.col("_us").alias("_start"), F.lit(0).cast("bigint").alias("_n"), F.lit(0).alias("_kind"))
    counted = moments.select(who, "_b", "_us", F.lit(None).cast("bigint").alias("_start"), "_n", F.lit(1).alias("_kind"))
    back = W.partitionBy(who, "_b").orderBy("_us", "_kind").rowsBetween(W.unboundedPreceding, 0)
    placed = opened.unionByName(counted).withColumn("_start", F.last("_start", ignorenulls=True).over(back)).where("_kind = 1")
    return placed.groupBy(who, F.col("_start").alias("start_us")).agg(F.sum("_n").alias("n"))


def admitted_log(events: DataFrame, who: str, seconds: int, limit: int, key: str = "event_id") -> DataFrame:
    """key, identity, admitted and retry_after (whole seconds, at least 1; null if admitted) of every event, in order of time and key.

    The verdict on an event hangs on the last ``limit`` admitted ones, so a run without a pause is scanned in order with these as all its memory; runs are spread
    over tasks, and rows are read as a sorted stream, never gathered."""
    span = seconds * SECOND
    timed = events.select(key, who, micros().alias("_us")).where(F.col(who).isNotNull() & F.col("_us").isNotNull()).withColumn("_b", F.floor(F.col("_us") / span))
    runs = _busy(timed, who, span).select(who, "_b", "_run")
    kinds = {c: dict(events.dtypes)[c] for c in (key, who)}

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, log = None, deque()
        for batch in parts:
            ids, names, runs_, times = (batch.column(i) for i in range(4))
            admitted, wait = [], []
            for group, t in zip(zip(names.to_pylist(), runs_.to_pylist()), times.to_pylist()):
                if group != now:
                    now, log = group, deque()
                while log and t - log[0] >= span:
                    log.popleft()
                admitted.append(len(log) < limit)
                wait.append(None if admitted[-1] else max(1, (span - (t - log[0])) // SECOND))
                if admitted[-1]:
                    log.append(t)
            yield pa.RecordBatch.from_arrays([ids, names, pa.array(admitted, pa.bool_()), pa.array(wait, pa.int64())], [key, who, "admitted", "retry_after"])

    if limit < 1:
        raise ValueError("limit must be at least 1")
    ready = timed.join(runs, [who, "_b"]).select(key, who, "_run", "_us").repartition(who, "_run").sortWithinPartitions(who, "_run", "_us", key)
    return ready.mapInArrow(scan, f"{key} {kinds[key]}, {who} {kinds[who]}, admitted boolean, retry_after long")


def _in_order(events: DataFrame, who: str, key: str, lateness: str, schema: str, step: Callable, wakes: Callable) -> DataFrame:
    """Runs ``step(name, carry, [(us, id)], watermark)`` per identity on events that the watermark has passed, in order; it gives the new carry and rows.

    State: the carry, and events that the watermark has not passed. ``wakes(carry)`` is the event time of the next timer, or None."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(name, frames, state):
        carry, at, ids = ([list(x) for x in state.get] if state.exists else ([], [], []))
        for frame in frames:
            at += frame["_us"].tolist()
            ids += frame["_id"].tolist()
        mark = state.getCurrentWatermarkMs() * 1000
        waiting = sorted(zip(at, ids))
        ready = [e for e in waiting if e[0] < mark]
        waiting = waiting[len(ready):]
        carry, rows = step(name[0], carry, ready, mark)
        timers = [t for t in (waiting[0][0] if waiting else None, wakes(carry)) if t is not None]
        if timers:
            state.update((carry, [t for t, _ in waiting], [i for _, i in waiting]))
            state.setTimeoutTimestamp(max(min(timers) // 1000, mark // 1000) + 1)
        elif state.exists:
            state.remove()
        if rows:
            yield pd.DataFrame(rows, columns=names)

    timed = events.where(F.col(who).isNotNull()).withWatermark("ts", lateness).select(who, "ts", F.unix_micros("ts").alias("_us"), F.col(key).alias("_id"))
    return timed.groupBy(who).applyInPandasWithState(run, schema, HELD, "append", "EventTimeTimeout")


def first_event_windows_stream(events: DataFrame, who: str, seconds: int, lateness: str = LATENESS, key: str = "event_id") -> DataFrame:
    """Windows as the watermark passes their end; the counter of an identity is opened by an event and closed by a timer. ``key`` is a whole number."""
    span = seconds * SECOND

    def step(name, carry, ready, mark):
        rows = []
        for t, _ in ready:
            if carry and t >= carry[0] + span:
                rows.append((name, carry[0], carry[1]))
                carry = []
            carry = [carry[0], carry[1] + 1] if carry else [t, 1]
        if carry and carry[0] + span <= mark:
            rows.append((name, carry[0], carry[1]))
            carry = []
        return carry, rows

    kind = dict(events.dtypes)[who]
    return _in_order(events, who, key, lateness, f"{who} {kind}, start_us long, n long", step, lambda carry: carry[0] + span if carry else None)


def admitted_log_stream(events: DataFrame, who: str, seconds: int, limit: int, lateness: str = LATENESS, key: str = "event_id") -> DataFrame:
    """Verdicts as the watermark passes the events; the state holds at most ``limit`` admitted times of an identity."""
    span, second = seconds * SECOND, SECOND

    def step(name, carry, ready, mark):
        rows = []
        for t, i in ready:
            carry = [c for c in carry if t - c < span]
            fits = len(carry) < limit
            rows.append((i, name, fits, None if fits else max(1, (span - (t - carry[0])) // second)))
            if fits:
                carry = [*carry, t]
        return [c for c in carry if mark - c < span], rows

    kinds = dict(events.dtypes)
    return _in_order(events, who, key, lateness, f"{key} {kinds[key]}, {who} {kinds[who]}, admitted boolean, retry_after long", step, lambda carry: carry[-1] + span if carry else None)
