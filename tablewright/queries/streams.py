"""Event handling (X01-X08): batch forms beside streams run to the end over the same events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.queries.base import query, table
from tablewright.session import shared_folder
from tablewright.streaming import events as E
from tablewright.streaming import limits as L

UNORDERED = "4000 days"  # the written files come in no order of time, so nothing in them may count as late
DOUBLE = "SELECT event_id, ts, user_id, event_type FROM events UNION ALL SELECT event_id, ts + INTERVAL 10 MINUTE, user_id, 'again' FROM events"


def doubled(spark, sf):
    """Every event arrives twice, ten minutes apart."""
    df = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    return df.union(df.select("event_id", F.col("ts") + F.expr("interval 10 minutes"), "user_id", F.lit("again")))


def stream(spark, sf, df=None):
    """The events table as a file stream (a derived table is written first)."""
    if df is None:
        return E.read_events(spark, sf, table(spark, sf, "events").schema, "events.parquet")
    folder = shared_folder(spark)
    df.repartition(6, "event_id").write.parquet(folder)
    return E.read_events(spark, folder, df.schema, files_per_batch=2)  # several micro-batches, so that state is carried


def drained(spark, df, mode="append"):
    out = shared_folder(spark)
    E.run_to_end(df, f"{out}/checkpoint", E.save_batch(f"{out}/data"), mode)
    return spark.read.parquet(f"{out}/data").drop("batch")


@query("x01_once", "SELECT event_id, event_type FROM events")
def once(spark, sf):
    return E.once_batch(doubled(spark, sf)).select("event_id", "event_type")


@query("x01_once_stream", "SELECT event_id, user_id FROM events")
def once_stream(spark, sf):
    unique = E.once(stream(spark, sf, doubled(spark, sf)), lateness=UNORDERED)
    return drained(spark, unique).select("event_id", "user_id")


def parts_stream(spark, df, part, n=3):
    """A derived table as a stream of ``n`` micro-batches: the rows whose ``part`` is 0, then 1, and so on, each a file of its own."""
    folder = shared_folder(spark)
    marked = df.withColumn("_part", part)
    for k in range(n):  # one after the other: files are read in the order they were written
        marked.where(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(folder)
    return E.read_events(spark, folder, df.schema)


def by_time(df, n=3):
    """Number of the slice of the table's time that a row falls in."""
    lo, hi = df.agg(F.min(L.micros()), F.max(L.micros())).first()
    return F.floor((L.micros() - lo) * n / (hi - lo + 1))


LATE = """WITH e AS (SELECT *, event_id % 3 AS batch FROM events), m AS (SELECT batch, max(ts) AS t FROM e GROUP BY 1),
w AS (SELECT batch, max(t) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 10 DAY AS mark FROM m),
s AS (SELECT e.*, coalesce(ts < mark, false) AS late FROM e JOIN w USING (batch))
"""


def split_late(spark, sf):
    """Three micro-batches over the whole span of time: rows ten days behind the newest of earlier ones go aside."""
    df = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    out = shared_folder(spark)
    E.run_to_end(parts_stream(spark, df, F.col("event_id") % 3), f"{out}/checkpoint", E.late_aside(out, "10 days", E.save_batch(f"{out}/data")))
    return spark.read.parquet(f"{out}/data").drop("batch"), E.late_rows(spark, out)


@query("x01_late", LATE + "SELECT event_id, batch FROM s WHERE late")
def late(spark, sf):
    return split_late(spark, sf)[1].select("event_id", "batch")


@query("x04_late_counts", LATE + "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) FILTER (NOT late) AS n, count(*) FILTER (late) AS late FROM s GROUP BY 1, 2")
def late_counts(spark, sf):
    """The trend of what came in time, and beside it what came too late."""
    kept, aside = (E.daily_trend_batch(df) for df in split_late(spark, sf))
    both = kept.join(aside.withColumnRenamed("n", "late"), ["day", "event_type"], "full")
    return both.select("day", "event_type", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("late", F.lit(0)).alias("late"))


LATEST = """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""


@query("x02_upsert_latest", LATEST)
def upsert(spark, sf):
    return E.latest(table(spark, sf, "events").drop("props"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("x02_upsert_latest_stream", LATEST)
def upsert_stream(spark, sf):
    out = shared_folder(spark)
    E.run_to_end(stream(spark, sf).drop("props"), f"{out}/checkpoint", E.upsert_into(f"{out}/data", ["user_id", "event_type"], ["ts", "event_id"]))
    return E.current(spark, f"{out}/data", ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


STATUS = "CASE event_type WHEN 'click' THEN 'completed' WHEN 'view' THEN 'Partial' WHEN 'error' THEN 'quarantined' WHEN 'signup' THEN 'running' ELSE 'complete' END"
ERROR = "CASE WHEN event_id % 4 = 0 THEN 'broken' ELSE ' ' END"


ROLLED = f"""
WITH c AS (SELECT user_id AS job_id, ts, event_id, {STATUS} AS status, {ERROR} AS error, event_type FROM events),
m AS (SELECT *, CASE WHEN status IN ('completed', 'complete') THEN CASE WHEN trim(error) <> '' THEN 'failed' ELSE 'succeeded' END WHEN status = 'Partial' THEN 'failed' ELSE status END AS state FROM c),
l AS (SELECT job_id, state, ts, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS rn FROM m),
e AS (SELECT job_id, string_agg(concat('last_', event_type, '=', event_id), ',' ORDER BY event_type) AS t FROM (SELECT job_id, event_type, event_id, row_number() OVER (PARTITION BY job_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM m) WHERE rn = 1 GROUP BY 1)
SELECT l.job_id, state AS status, concat('intent_id=old,', t, ',status=', state) AS summary, strftime(ts, '%Y-%m-%d %H:%M:%S') AS completed_at FROM l JOIN e USING (job_id) WHERE rn = 1"""


def jobs_and_callbacks(spark, sf):
    ev = table(spark, sf, "events")
    summary = F.create_map(F.concat(F.lit("last_"), F.col("event_type")), F.col("event_id").cast("string"), F.lit("intent_id"), F.lit("new"), F.lit("status"), F.lit("x"))
    callbacks = ev.select(F.col("user_id").alias("job_id"), "ts", "event_id", F.expr(STATUS).alias("status"), F.expr(ERROR).alias("error"), summary.alias("summary"))
    jobs = ev.select(F.col("user_id").alias("job_id")).distinct().select(
        "job_id", F.lit("queued").alias("status"), F.create_map(F.lit("intent_id"), F.lit("old"), F.lit("status"), F.lit("queued")).alias("summary"))
    return jobs, callbacks


def shown_jobs(out):
    pairs = F.array_sort(F.transform(F.map_entries("summary"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return out.select("job_id", "status", F.array_join(pairs, ",").alias("summary"), F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss").alias("completed_at"))


@query("x03_roll_forward", ROLLED)
def roll_forward(spark, sf):
    return shown_jobs(E.roll_forward(*jobs_and_callbacks(spark, sf)))


@query("x03_roll_forward_stream", ROLLED)
def roll_forward_stream(spark, sf):
    jobs, callbacks = jobs_and_callbacks(spark, sf)
    out = shared_folder(spark)
    E.run_to_end(stream(spark, sf, callbacks), f"{out}/checkpoint", E.roll_forward_into(f"{out}/data"))
    return shown_jobs(E.rolled_forward(spark, f"{out}/data", jobs))


TREND = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"


@query("x04_daily_trend", TREND)
def trend(spark, sf):
    return E.daily_trend_batch(table(spark, sf, "events"))


@query("x04_daily_trend_stream", TREND)
def trend_stream(spark, sf):
    """Update mode into a keyed table: each micro-batch logs only the counts it changed, and counts only grow."""
    out = shared_folder(spark)
    events = stream(spark, sf, table(spark, sf, "events").drop("props"))
    E.run_to_end(E.daily_trend(events, lateness=UNORDERED), f"{out}/checkpoint", E.upsert_into(f"{out}/data", ["day", "event_type"], ["n"]), "update")
    return E.current(spark, f"{out}/data", ["day", "event_type"], ["n"])


@query("x05_session_expiry", """
SELECT event_id AS session_id, strftime(ts + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS expired_at, 'quarantined' AS state FROM events
WHERE event_type = 'view' AND ts + INTERVAL 30 MINUTE < TIMESTAMP '2024-01-20'""")
def expiry(spark, sf):
    views = table(spark, sf, "events").where("event_type = 'view'").select(F.col("event_id").alias("session_id"), "ts")
    return E.expire_sessions_batch(views, "2024-01-20").withColumn("expired_at", F.date_format("expired_at", "yyyy-MM-dd HH:mm:ss"))


@query("x05_session_expiry_stream", """
SELECT event_id AS session_id, strftime(ts + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS expired_at, 'quarantined' AS state FROM events
WHERE event_type = 'view' AND epoch_ms(ts + INTERVAL 30 MINUTE) < (SELECT epoch_ms(max(ts) - INTERVAL 1 HOUR) FROM events WHERE event_type = 'view')""")
def expiry_stream(spark, sf):
    """Only sessions whose deadline the watermark has passed come out; the rest is still open."""
    sessions = stream(spark, sf).where("event_type = 'view'").select(F.col("event_id").alias("session_id"), "ts")
    out = drained(spark, E.expire_sessions(sessions, "1 hour"))
    return out.withColumn("expired_at", F.date_format("expired_at", "yyyy-MM-dd HH:mm:ss"))


@query("x06_bursts_tumbling", """
SELECT user_id, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 2""")
def tumbling(spark, sf):
    return E.bursts(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "1 hour", 2)


@query("x06_bursts_sliding", """
SELECT user_id, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n
FROM (SELECT user_id, unnest(list_transform([0, 1, 2, 3, 4, 5], lambda i: time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 10 MINUTE * i)) AS w FROM events) GROUP BY 1, 2 HAVING count(*) > 2""")
def sliding(spark, sf):
    return E.bursts(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "1 hour", 2, "10 minutes")


TUMBLING = """
SELECT user_id, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 2"""


@query("x06_bursts_tumbling_stream", TUMBLING)
def tumbling_stream(spark, sf):
    out = shared_folder(spark)
    E.run_to_end(E.bursts(stream(spark, sf), "user_id", "1 hour", 2), f"{out}/checkpoint", E.upsert_into(f"{out}/data", ["user_id", "window_start"], ["n"]), "update")
    return E.current(spark, f"{out}/data", ["user_id", "window_start"], ["n"])


@query("x06_bursts_log", """
SELECT user_id, at_us, n FROM (SELECT user_id, at_us, cast(count(*) OVER (PARTITION BY user_id ORDER BY at_us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS n
  FROM (SELECT user_id, epoch_us(ts) AS at_us FROM events)) WHERE n > 2 GROUP BY 1, 2, 3""")
def log(spark, sf):
    return E.bursts_batch(table(spark, sf, "events"), "user_id", 3600, 2)


SPAN = 6 * 3600


def first_windows(closed=""):
    return f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, epoch_us(ts) AS us FROM events),
w AS (SELECT user_id, min(us) AS s FROM e GROUP BY 1
  UNION ALL SELECT e.user_id, min(e.us) FROM w JOIN e ON e.user_id = w.user_id AND e.us >= w.s + {SPAN}000000 GROUP BY e.user_id)
SELECT w.user_id, s AS start_us, count(*) AS n FROM w JOIN e ON e.user_id = w.user_id AND e.us >= s AND e.us < s + {SPAN}000000 {closed} GROUP BY 1, 2 HAVING count(*) > 2"""


def admitted(passed=""):
    return f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
q AS (SELECT event_id, user_id, us, rn, [us] AS log, true AS admitted, cast(NULL AS BIGINT) AS retry_after FROM e WHERE rn = 1
  UNION ALL SELECT event_id, user_id, us, rn, CASE WHEN len(k) < 2 THEN list_append(k, us) ELSE k END, len(k) < 2, CASE WHEN len(k) >= 2 THEN greatest(1, ({SPAN}000000 - (us - k[1])) // 1000000) END
  FROM (SELECT e.*, list_filter(q.log, lambda t: e.us - t < {SPAN}000000) AS k FROM q JOIN e ON e.user_id = q.user_id AND e.rn = q.rn + 1))
SELECT event_id, user_id, admitted, retry_after FROM q {passed}"""


MARK = "(SELECT epoch_ms(max(ts) - INTERVAL 1 HOUR) * 1000 FROM events)"


@query("x06_bursts_first", first_windows())
def first(spark, sf):
    return L.first_event_windows(table(spark, sf, "events"), "user_id", SPAN).where("n > 2")


@query("x06_bursts_first_stream", first_windows(f"AND s + {SPAN}000000 <= {MARK}"))
def first_stream(spark, sf):
    """Windows that the watermark has closed; the rest is still open."""
    df = table(spark, sf, "events").select("event_id", "ts", "user_id")
    return drained(spark, L.first_event_windows_stream(parts_stream(spark, df, by_time(df)), "user_id", SPAN, "1 hour")).where("n > 2")


@query("x06_admitted", admitted())
def admitted_batch(spark, sf):
    return L.admitted_log(table(spark, sf, "events"), "user_id", SPAN, 2)


@query("x06_admitted_stream", admitted(f"WHERE us < {MARK}"))
def admitted_stream(spark, sf):
    df = table(spark, sf, "events").select("event_id", "ts", "user_id")
    return drained(spark, L.admitted_log_stream(parts_stream(spark, df, by_time(df)), "user_id", SPAN, 2, "1 hour"))


ROUTED = f"""SELECT event_id, CASE WHEN s IN ('failed') THEN 'dead_letter' ELSE 'needs_review' END AS route FROM (
  SELECT event_id, CASE event_type WHEN 'view' THEN 'failed' WHEN 'error' THEN 'quarantined' ELSE 'other' END AS s FROM events) WHERE s <> 'other'"""


def with_status(df):
    return df.withColumn("status", F.when(F.col("event_type") == "view", "partial").when(F.col("event_type") == "error", "rejected").otherwise("running"))


@query("x07_routes", ROUTED)
def routes(spark, sf):
    return E.routed_batch(with_status(doubled(spark, sf))).select("event_id", "route")


@query("x07_routes_stream", ROUTED)
def routes_stream(spark, sf):
    """The copies carry the type of the original here, so that either may come first."""
    df = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    twice = df.union(df)
    out = shared_folder(spark)
    E.run_to_end(with_status(E.once(stream(spark, sf, twice), lateness=UNORDERED)), f"{out}/checkpoint", E.route_into(f"{out}/data"))
    return spark.read.parquet(f"{out}/data").select("event_id", "route")


@query("x08_live_alerts", "SELECT event_id, 'again' AS event_type FROM events ORDER BY ts + INTERVAL 10 MINUTE DESC, event_id DESC LIMIT 500")
def alerts(spark, sf):
    return E.live_alerts(doubled(spark, sf)).select("event_id", "event_type")


@query("x08_live_alerts_stream", "SELECT event_id, 'again' AS event_type FROM events ORDER BY ts + INTERVAL 10 MINUTE DESC, event_id DESC LIMIT 500")
def alerts_stream(spark, sf):
    out = shared_folder(spark)
    E.run_to_end(stream(spark, sf, doubled(spark, sf)), f"{out}/checkpoint", E.upsert_into(f"{out}/data", ["event_id"], ["ts"]))
    return E.live_alerts(E.current(spark, f"{out}/data", ["event_id"], ["ts"])).select("event_id", "event_type")
