"""Event handling as Structured Streaming, each operator beside its batch form.

Watermark policy: an event may be a day late by default. The batch forms see every row and are what the
stream results are compared with.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.convert import merge_json_maps
from tablewright.operators.kpi import STATUSES, normalized_status
from tablewright.operators.ordered import orderable
from tablewright.operators.rows import first_per_key
from tablewright.streaming.keyed import KeyedTable, latest

LATENESS = "1 day"
SESSION_MINUTES = 30

# State words an agent may send, and the job state each stands for.
CALLBACK_STATUS = {"complete": "succeeded", "completed": "succeeded", "succeeded": "succeeded", "failed": "failed", "partial": "failed",
                   "quarantined": "quarantined", "callback_failed": "callback_failed", "declined": "declined"}

# End states that a payload may report about itself.
REPORTED = {"failed": "failed", "partial": "failed", "quarantined": "quarantined", "complete": "succeeded", "completed": "succeeded", "succeeded": "succeeded"}

# Keys of a job summary that a callback never changes.
PROTECTED_KEYS = (
    "canonical_intent", "canonical_intent_schema_version", "canonical_intent_status", "intent_id", "intent_revision", "intent_hash",
    "parent_intent_id", "grounded_at", "capability_version", "intent_extractor_version", "intent_normalizer_version",
    "intent_grounding_version", "intent_created_at", "original_instruction", "data_profile", "profile_status", "file_fingerprint",
    "profiler_version",
)


def read_events(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_batch: int = 1) -> DataFrame:
    """File stream; event time must be a timestamp with zone for watermarks."""
    raw = (spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder))
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_end(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process everything there is and stop."""
    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def save_batch(path: str) -> Callable[[DataFrame, int], None]:
    """Sink that writes each micro-batch to its own partition: running a batch again replaces it."""
    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


# -- each event once ------------------------------------------------------------------------------------------------

def once(events: DataFrame, key: str = "event_id", lateness: str = LATENESS) -> DataFrame:
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])


def once_batch(events: DataFrame, key: str = "event_id") -> DataFrame:
    """First arrival of each event id; copies of a hot id collapse before the shuffle."""
    return first_per_key(events, [key], [F.asc("ts"), *[F.asc(c) for c in orderable(events, [key, "ts"])]])


# -- latest row per key ---------------------------------------------------------------------------------------------

def upsert_into(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """Keeps the newest row per key in a compacted table (``keyed.KeyedTable``); ``current`` reads it. A batch that runs twice changes nothing."""
    def write(df: DataFrame, batch: int) -> None:
        KeyedTable(df.sparkSession, path, keys, order).merge(df, batch)

    return write


def current(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    return KeyedTable(spark, path, keys, order).read()


# -- late rows --------------------------------------------------------------------------------------------------------

def late_aside(path: str, lateness: str, write: Callable[[DataFrame, int], None], ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """Sink in front of another: rows older than the watermark (newest time of all earlier batches, less ``lateness``) go to a side table, the
    rest to ``write``. The newest time so far is kept with each batch, so a batch that runs again is split in the same way."""
    def split(df: DataFrame, batch: int) -> None:
        spark, seen = df.sparkSession, None
        if batch:
            seen = spark.read.parquet(f"{path}/seen/batch={batch - 1}").first()[0]
        df.persist()
        try:
            late = F.coalesce(F.col(ts) < F.lit(seen) - F.expr(f"INTERVAL {lateness}"), F.lit(False)) if seen is not None else F.lit(False)
            df.where(late).write.mode("overwrite").parquet(f"{path}/late/batch={batch}")
            write(df.where(~late), batch)
            newest = F.greatest(F.max(ts), F.lit(seen).cast(df.schema[ts].dataType)).alias("seen")
            df.agg(newest).write.mode("overwrite").parquet(f"{path}/seen/batch={batch}")
        finally:
            df.unpersist()

    return split


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """What ``late_aside`` kept back, with the number of the batch it came in."""
    return spark.read.parquet(f"{path}/late").withColumn("batch", F.col("batch").cast("bigint"))


# -- job state from callbacks -----------------------------------------------------------------------------------------

def callback_status(status: Column, error: Column, errors: Column | None = None, reported: Column | None = None) -> Column:
    """Job state of a callback, null for an unknown or missing word: such a callback is rejected.

    One that claims success but carries an error, or any entry in its ``errors`` list, has failed. ``reported`` is the status inside
    the callback's own payload; where it names an end state and no error overrides, it decides.
    """
    known = {**{w: w for w in STATUSES}, **CALLBACK_STATUS}
    mapped = F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.trim(F.lower(status)))
    broken = F.coalesce(F.trim(error), F.lit("")) != ""
    if errors is not None:
        broken = broken | F.coalesce(F.exists(errors, lambda e: F.coalesce(F.trim(e), F.lit("")) != ""), F.lit(False))
    state = F.when((mapped == "succeeded") & broken, "failed")
    if reported is not None:
        own = F.try_element_at(F.create_map(*[F.lit(x) for kv in REPORTED.items() for x in kv]), F.trim(F.lower(reported)))
        state = state.when(mapped.isNotNull() & own.isNotNull(), own)
    return state.otherwise(mapped)


def callback_entries(callbacks: DataFrame, job: str = "job_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """What callbacks (job_id, ts, event_id, status, error, summary map) say, one row for each thing: the state under ``=``, a summary key
    under ``k`` and its name. Optional columns: ``errors`` (array) and ``reported`` (the payload's own status). Callbacks with an unknown status say nothing."""
    more = [F.col(c) if c in callbacks.columns else None for c in ("errors", "reported")]
    known = callbacks.withColumn("_state", callback_status(F.col("status"), F.col("error"), *more)).where("_state IS NOT NULL")
    states = known.select(job, *order, F.lit("=").alias("entry"), F.col("_state").alias("value"))
    keys = known.select(job, *order, F.explode("summary").alias("_k", "value")).select(job, *order, F.concat(F.lit("k"), "_k").alias("entry"), "value")
    return states.unionByName(keys)


def with_entries(jobs: DataFrame, entries: DataFrame, job: str = "job_id") -> DataFrame:
    """Jobs (job_id, status, summary map) with the newest entries (one row per job and entry) applied."""
    state = F.col("entry") == "="
    pair = F.when(~state, F.struct(F.substring("entry", 2, 1 << 30).alias("k"), F.col("value").alias("v")))
    said = entries.groupBy(job).agg(F.max(F.when(state, F.col("value"))).alias("_status"), F.max(F.when(state, F.col("ts"))).alias("completed_at"), F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("_new"))
    joined = jobs.join(said, job, "left")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    merged = merge_json_maps(F.coalesce("summary", empty), F.coalesce("_new", empty), PROTECTED_KEYS)
    status = F.coalesce("_status", "status")
    with_status = merge_json_maps(merged, F.create_map(F.lit("status"), status), ())
    return joined.select(job, status.alias("status"), F.when(F.col("_status").isNotNull(), with_status).otherwise(F.col("summary")).alias("summary"), "completed_at")


def roll_forward(jobs: DataFrame, callbacks: DataFrame, job: str = "job_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Jobs after all callbacks. The state comes from the last callback; of the summary each key keeps its last value, so the fold over the callbacks of
    a job is a grouped maximum per entry, and a job with very many callbacks needs no single task."""
    newest = callback_entries(callbacks, job, order).groupBy(job, "entry").agg(F.max_by(F.struct("ts", "value"), F.struct(*order)).alias("_n"))
    return with_entries(jobs, newest.select(job, "entry", "_n.ts", "_n.value"), job)


ENTRY = ["job_id", "entry"], ["ts", "event_id"]


def roll_forward_into(path: str) -> Callable[[DataFrame, int], None]:
    """Stream sink for callbacks: folded into a compacted table of the newest entries, which callbacks received again do not change."""
    fold = upsert_into(path, *ENTRY)
    return lambda df, batch: fold(callback_entries(df), batch)


def rolled_forward(spark: SparkSession, path: str, jobs: DataFrame) -> DataFrame:
    """State of the jobs after everything received; reads live entries only."""
    return with_entries(jobs, current(spark, path, *ENTRY))


# -- trend ------------------------------------------------------------------------------------------------------------

def daily_trend(events: DataFrame, status: str = "event_type", lateness: str = LATENESS) -> DataFrame:
    day = F.window("ts", "1 day")
    counted = events.withWatermark("ts", lateness).groupBy(day, status).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), status, "n")


def daily_trend_batch(events: DataFrame, status: str = "event_type") -> DataFrame:
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), status).agg(F.count(F.lit(1)).alias("n"))


# -- session expiry -----------------------------------------------------------------------------------------------------

BUCKETS = 1024  # of session ids: a call of the state function takes a bucket, as a call for each session costs more than its work
EXPIRED = "none boolean, id long, us long"
HELD = "sessions binary"  # rows of SESSION
SESSION = [("none", "?"), ("id", "<i8"), ("start", "<i8"), ("due", "<i8")]  # id unless it is null, start in microseconds, timeout in milliseconds


def expire_sessions(sessions: DataFrame, lateness: str = LATENESS, minutes: int = SESSION_MINUTES, buckets: int = BUCKETS) -> DataFrame:
    """Stream of sessions (session_id, ts) to stream of expired ones. State per session is its id and two times, kept together for a bucket of ids.

    The start of a session is held; when event time passes its fixed deadline it goes to quarantine. Rows without a time open nothing. A batch
    writes the buckets it touches anew, so ``buckets`` should follow the number of open sessions if there are many millions.
    """
    span = minutes * 60_000_000
    names = [n for n, _ in SESSION]

    def expire(key, frames, state):  # nested, so that it travels to the executors by value
        rows = pd.DataFrame(np.frombuffer(state.get[0] if state.exists else b"", dtype=SESSION)).assign(fresh=False)
        mark = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            new = [f.groupby(["none", "id"], as_index=False).agg(start=("us", "min")) for f in frames]
            rows = pd.concat([rows, *[f.assign(due=np.int64(0), fresh=True) for f in new]])
            rows = rows.groupby(["none", "id"], as_index=False).agg(start=("start", "min"), due=("due", "max"), fresh=("fresh", "any"))
            rows["due"] = rows["due"].where(~rows["fresh"], ((rows["start"] + span) // 1000).clip(lower=mark + 1))
        over = ~rows["fresh"] & (rows["due"] < mark)
        held, out = rows[~over], rows[over]
        if len(held):
            state.update((held[names].to_records(index=False).astype(SESSION).tobytes(),))
            state.setTimeoutTimestamp(max(int(held["due"].min()), mark, 1))
        elif state.exists:
            state.remove()
        if len(out):
            yield pd.DataFrame({"none": out["none"], "id": out["id"], "us": out["start"] + span})

    none = F.col("session_id").isNull().alias("none")
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(buckets)).alias("bucket")
    timed = sessions.where("ts IS NOT NULL").withWatermark("ts", lateness)
    grouped = timed.select(bucket, "ts", none, F.coalesce(F.col("session_id").cast("bigint"), F.lit(0)).alias("id"), F.unix_micros("ts").alias("us")).groupBy("bucket")
    out = grouped.applyInPandasWithState(expire, EXPIRED, HELD, "append", "EventTimeTimeout")
    return out.select(F.when(~F.col("none"), F.col("id")).alias("session_id"), F.timestamp_micros("us").alias("expired_at"), F.lit("quarantined").alias("state"))


def expire_sessions_batch(sessions: DataFrame, now: str) -> DataFrame:
    deadline = F.min("ts") + F.expr(f"interval {SESSION_MINUTES} minutes")
    ends = sessions.groupBy("session_id").agg(deadline.alias("expired_at"))
    return ends.where(F.col("expired_at") < F.lit(now).cast("timestamp_ntz")).withColumn("state", F.lit("quarantined"))


# -- bursts ---------------------------------------------------------------------------------------------------------------

def bursts(events: DataFrame, who: str, window: str, limit: int, slide: str | None = None, lateness: str = LATENESS) -> DataFrame:
    """Windows with more than ``limit`` events of one identity: tumbling, or sliding with a slide."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    counted = events.withWatermark("ts", lateness).groupBy(who, span).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    return counted.select(who, F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")


def bursts_batch(events: DataFrame, who: str, seconds: int, limit: int) -> DataFrame:
    """Every moment at which one identity has more than ``limit`` events in the last ``seconds``.

    Events of one identity and moment are counted first. Time is cut into buckets of the window length and each
    count is also handed to the next bucket as context, so a hot identity spreads over as many tasks as it has
    busy buckets and no window looks further back than one bucket.
    """
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    span = seconds * 1_000_000
    counted = events.select(who, micros.alias("_us")).groupBy(who, "_us").agg(F.count(F.lit(1)).alias("_n"))
    bucket = F.floor(F.col("_us") / span)
    spread = counted.select(who, "_us", "_n", F.explode(F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own")), F.struct((bucket + 1).alias("b"), F.lit(False).alias("own")))).alias("_s"))
    back = W.partitionBy(who, "_s.b").orderBy("_us").rangeBetween(-(span - 1), 0)
    seen = spread.withColumn("n", F.sum("_n").over(back)).where(F.col("_s.own") & (F.col("n") > limit))
    return seen.select(who, F.col("_us").alias("at_us"), "n")


# -- routing ----------------------------------------------------------------------------------------------------------------

def route(status: Column) -> Column:
    """needs_review for quarantined work, dead_letter for failed work, else none."""
    state = normalized_status(status)
    return F.when(state == "quarantined", "needs_review").when(state.isin("failed", "callback_failed"), "dead_letter")


def routed_batch(events: DataFrame, key: str = "event_id") -> DataFrame:
    return once_batch(events, key).withColumn("route", route(F.col("status"))).where(F.col("route").isNotNull())


def route_into(path: str) -> Callable[[DataFrame, int], None]:
    """Stream sink for events already made unique by ``once``: one folder per route."""
    def write(df: DataFrame, batch: int) -> None:
        routed = df.withColumn("route", route(F.col("status"))).where(F.col("route").isNotNull())
        routed.write.mode("overwrite").partitionBy("route").parquet(f"{path}/batch={batch}")

    return write


def live_alerts(alerts: DataFrame, key: str = "event_id", top: int | None = 500) -> DataFrame:
    """Newest state of each alert, newest first."""
    newest = latest(alerts, [key], ["ts"]).orderBy(F.desc("ts"), F.desc(key))
    return newest.limit(top) if top else newest
