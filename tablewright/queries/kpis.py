"""Job filters and KPIs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import kpi as K
from tablewright.queries.base import query, table, view
from tablewright.queries.cleaning import STATUS_SQL

JOBS = ("jobs",)
WAITING = "status IN ('pending', 'queued', 'quarantined') AND coalesce(payload_status, '') IN ('pending_agent_availability', 'rejected')"
DERIVED = f"CASE WHEN {WAITING} THEN 'quarantined' ELSE {STATUS_SQL} END"


def jobs(spark, sf):
    return view(spark, sf, "jobs")


@query("f22_job_search", "SELECT id, file_name, status FROM jobs WHERE (contains(lower(file_name), '_42') OR contains(lower(output_format), '_42')) AND status = 'failed'", uses=JOBS)
def job_search(spark, sf):
    from tablewright.operators.filters import search_rows

    return search_rows(jobs(spark, sf), "_42", ["file_name", "output_format"]).where("status = 'failed'").select("id", "file_name", "status")


@query("f23_ilike_alerts", "SELECT event_id, event_type FROM events WHERE event_type ILIKE '%URCH%' AND value >= 50")
def ilike(spark, sf):
    from tablewright.operators.filters import alerts_like

    return alerts_like(table(spark, sf, "events"), "event_type", "URCH", "value", 50).select("event_id", "event_type")


@query("f24_own_rows", "SELECT id, status FROM jobs WHERE user_id = 77", uses=JOBS)
def own_rows(spark, sf):
    return K.scoped(jobs(spark, sf), "employee", 77).select("id", "status")


@query("f24_team_rows", "SELECT id, status FROM jobs WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)", uses=JOBS)
def team_rows(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("manager_id"))
    return K.scoped(jobs(spark, sf), "manager", 3, users).select("id", "status")


@query("f25_period", "SELECT id FROM jobs WHERE uploaded_at >= TIMESTAMP '1997-03-01' AND uploaded_at <= TIMESTAMP '1997-06-30'", uses=JOBS)
def period(spark, sf):
    return K.in_period(jobs(spark, sf), "uploaded_at", "1997-03-01", "1997-06-30").select("id")


@query("f26_quarantined", f"""
SELECT id, status, payload_status FROM jobs WHERE ({STATUS_SQL}) = 'quarantined'
  OR (({STATUS_SQL}) = 'queued' AND coalesce(payload_status, '') IN ('pending_agent_availability', 'rejected'))""", uses=JOBS)
def quarantined(spark, sf):
    return jobs(spark, sf).where(K.is_quarantined(F.col("status"), F.col("payload_status"))).select("id", "status", "payload_status")


@query("f27_expired_sessions", "SELECT event_id, user_id FROM events WHERE event_type = 'view' AND ts + INTERVAL 30 MINUTE < TIMESTAMP '2024-01-15'")
def expired(spark, sf):
    return K.expired_sessions(table(spark, sf, "events").where("event_type = 'view'"), "ts", "2024-01-15").select("event_id", "user_id")


@query("a19_status_counts", f"SELECT {DERIVED} AS status, count(*) AS jobs FROM jobs GROUP BY 1", uses=JOBS)
def status_counts(spark, sf):
    return K.status_counts(jobs(spark, sf))


def n_of(*states):
    return f"count(*) FILTER (s IN ({', '.join(repr(s) for s in states)}))"


@query("a20_totals", f"""
SELECT count(*) AS uploads, {n_of('queued')} AS queued, {n_of('planning')} AS planning, {n_of('running')} AS running, {n_of('succeeded')} AS succeeded,
  {n_of('failed', 'callback_failed')} AS failed, {n_of('quarantined')} AS quarantined, {n_of('callback_failed')} AS callback_failed,
  {n_of('awaiting_schema_approval')} AS awaiting_schema_approval, {n_of('awaiting_confirmation')} AS awaiting_confirmation, {n_of('declined')} AS declined,
  {n_of('queued', 'planning')} AS pending, round({n_of('succeeded')} / count(*) * 100, 1) AS completion_rate FROM (SELECT {DERIVED} AS s FROM jobs)""", uses=JOBS)
def totals(spark, sf):
    return K.totals(jobs(spark, sf))


@query("a21_average_duration", "SELECT round(avg(epoch(completed_at) - epoch(uploaded_at)), 4) AS average_seconds FROM jobs", uses=JOBS)
def average_duration(spark, sf):
    return K.average_duration(jobs(spark, sf)).select(F.round("average_seconds", 4).alias("average_seconds"))


@query("a22_format_counts", "SELECT coalesce(output_format, 'Unknown') AS output_format, count(*) AS jobs FROM jobs GROUP BY 1", uses=JOBS)
def format_counts(spark, sf):
    return K.format_counts(jobs(spark, sf))


TREND = f"""
SELECT cast(uploaded_at AS DATE) AS day, s AS status, count(DISTINCT id) AS uploads, count(l_orderkey) AS records
FROM (SELECT id, uploaded_at, {DERIVED} AS s FROM jobs) LEFT JOIN lineitem ON l_orderkey = id GROUP BY 1, 2"""


def day_text(df):
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("a23_daily_trend", f"SELECT strftime(day, '%Y-%m-%d') AS day, status, uploads, records FROM ({TREND}) ORDER BY 1, 2 LIMIT 90", uses=JOBS)
def daily_trend(spark, sf):
    return day_text(K.daily_trend(jobs(spark, sf), table(spark, sf, "lineitem"), "l_orderkey", groups=90))


def bucket(*states):
    return f"cast(coalesce(sum(uploads) FILTER (status IN ({', '.join(repr(s) for s in states)})), 0) AS BIGINT)"


@query("a24_trend_by_day", f"""
SELECT strftime(day, '%Y-%m-%d') AS day, cast(sum(uploads) AS BIGINT) AS uploads, cast(sum(records) AS BIGINT) AS records,
  {', '.join(f'{bucket(s)} AS {s}' for s in K.STATUSES if s not in ('failed', 'awaiting_clarification'))},
  {bucket('failed', 'callback_failed')} AS failed, {bucket('succeeded')} AS complete, {bucket('quarantined')} AS awaiting_agent,
  {bucket('queued', 'planning')} AS pending, {bucket('running')} AS processing FROM ({TREND}) GROUP BY 1""", uses=JOBS)
def trend_by_day(spark, sf):
    return day_text(K.trend_by_day(K.daily_trend(jobs(spark, sf), table(spark, sf, "lineitem"), "l_orderkey")))


DONE = "status IN ('succeeded', 'complete', 'success')"


@query("a25_workload", f"""
SELECT cast(user_id AS string) AS owner, count(*) AS jobs, count(*) FILTER ({DONE}) AS completed, strftime(max(uploaded_at), '%Y-%m-%d') AS latest,
  concat(cast(floor(count(*) FILTER ({DONE}) / count(*) * 100 + 0.5) AS BIGINT), '%') AS success_rate
FROM jobs GROUP BY 1 ORDER BY jobs DESC, owner LIMIT 6""", uses=JOBS)
def workload(spark, sf):
    return K.workload(jobs(spark, sf), "user_id").withColumn("latest", F.date_format("latest", "yyyy-MM-dd"))


@query("a26_average_minutes", f"""
SELECT cast(floor(avg(greatest(0, floor((epoch(completed_at) - epoch(uploaded_at)) / 60 + 0.5))) + 0.5) AS BIGINT) AS average_minutes
FROM jobs WHERE {DONE} AND completed_at IS NOT NULL""", uses=JOBS)
def average_minutes(spark, sf):
    return K.average_minutes(jobs(spark, sf))


@query("a27_period_counts", f"""
SELECT count(*) FILTER (uploaded_at >= DATE '2001-07-20') AS jobs_today, count(*) FILTER (uploaded_at >= DATE '2001-07-14') AS jobs_this_week,
  count(*) FILTER (uploaded_at >= DATE '2001-07-01') AS jobs_this_month, cast(floor(count(*) FILTER ({DONE}) / count(*) * 100 + 0.5) AS BIGINT) AS completion_rate,
  count(*) FILTER ({DONE}) AS complete, count(*) FILTER (status IN ('running', 'processing')) AS running,
  count(*) FILTER (status IN ('quarantined', 'rejected')) AS quarantined, count(*) FILTER (status IN ('failed', 'partial')) AS failed FROM jobs""", uses=JOBS)
def period_counts(spark, sf):
    return K.period_counts(jobs(spark, sf), "2001-07-20")


@query("a28_agent_totals", """
SELECT cast(sum(n) AS BIGINT) AS invocations, count(*) FILTER (n > 620) AS active, count(*) FILTER (n <= 580) AS degraded,
  count(*) FILTER (s_nationkey IS NOT NULL AND s_acctbal > 0) AS assigned, count(*) FILTER (NOT (s_nationkey IS NOT NULL AND s_acctbal > 0)) AS unassigned
FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey""")
def agent_totals(spark, sf):
    agents = K.matches_per_key(table(spark, sf, "supplier"), table(spark, sf, "lineitem"), "s_suppkey", "l_suppkey", "n")
    ok = F.col("s_nationkey").isNotNull() & (F.col("s_acctbal") > 0)
    return agents.agg(F.sum("n").alias("invocations"), F.count_if(F.col("n") > 620).alias("active"), F.count_if(F.col("n") <= 580).alias("degraded"),
                      F.count_if(ok).alias("assigned"), F.count_if(~ok).alias("unassigned"))


FIRST, SECOND = "l_returnflag = 'R'", "CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_linestatus = 'F' END"


@query("a29_agreement", f"""
SELECT verdict, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (
  SELECT CASE WHEN b IS NULL THEN 'unavailable' WHEN a = b THEN 'agree' ELSE 'disagree' END AS verdict FROM (SELECT {FIRST} AS a, {SECOND} AS b FROM lineitem)) GROUP BY 1""")
def agreement(spark, sf):
    return K.agreement(table(spark, sf, "lineitem"), F.expr(FIRST), F.expr(SECOND))


@query("a30_event_counters", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def counters(spark, sf):
    from tablewright.operators.rows import count_per_key

    return count_per_key(table(spark, sf, "events"), "event_type")


@query("a31_largest_count", """
SELECT id, greatest(coalesce(n, 0), id % 7, coalesce(CASE WHEN id % 3 = 0 THEN id % 11 END, 0)) AS total_rows
FROM jobs LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = id""", uses=JOBS)
def largest_count(spark, sf):
    stored = K.matches_per_key(jobs(spark, sf).select("id"), table(spark, sf, "lineitem"), "id", "l_orderkey", "stored")
    reported = F.when(F.col("id") % 3 == 0, F.col("id") % 11)
    return stored.select("id", F.greatest(F.col("stored"), F.col("id") % 7, F.coalesce(reported, F.lit(0))).alias("total_rows"))


@query("a32_ambiguity_score", """
SELECT l_orderkey, round(avg(CASE WHEN l_discount > 0 THEN l_discount * 10 WHEN l_tax > 0.04 THEN 0.5 ELSE 0 END), 6) AS score
FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""")
def ambiguity(spark, sf):
    confidence = F.when(F.col("l_discount") > 0, F.col("l_discount") * 10).when(F.col("l_tax") > 0.04, 0.5).otherwise(0.0)
    open_refs = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    return K.ambiguity(open_refs, "l_orderkey", confidence)


LOGS = """SELECT l_orderkey AS id, l_shipdate AS happened, CASE l_linenumber % 4 WHEN 0 THEN 'upload created' WHEN 1 THEN 'upload approved' WHEN 2 THEN 'job retried' ELSE 'upload declined' END AS action,
  CASE l_partkey % 2 WHEN 0 THEN 'workflow_created' ELSE concat('part ', cast(l_partkey AS string)) END AS detail FROM {lineitem}"""


@query("d08_timeline", f"""
SELECT id, strftime(happened, '%Y-%m-%d %H:%M') AS happened, action, detail FROM (
  SELECT id, uploaded_at AS happened, 'upload created' AS action, file_name AS detail FROM jobs
  UNION ALL SELECT id, dispatched_at, 'agent dispatched', 'queue' FROM jobs WHERE dispatched_at IS NOT NULL
  UNION ALL SELECT id, CASE WHEN s = 'awaiting_confirmation' THEN uploaded_at ELSE completed_at END, CASE WHEN s = 'succeeded' THEN 'workflow completed' WHEN s IN ('failed', 'callback_failed', 'declined') THEN 'workflow failed'
      WHEN s = 'awaiting_confirmation' THEN 'interpretation review requested' WHEN s = 'quarantined' THEN 'workflow quarantined' END, s
    FROM (SELECT *, {STATUS_SQL} AS s FROM jobs) WHERE completed_at IS NOT NULL AND s IN ('succeeded', 'failed', 'callback_failed', 'declined', 'awaiting_confirmation', 'quarantined')
  UNION ALL SELECT l.id, happened, action, detail FROM ({LOGS.replace('{lineitem}', 'lineitem')}) l JOIN jobs j ON j.id = l.id
    WHERE NOT (action = 'upload created' AND (detail = 'workflow_created' OR detail = file_name)) AND NOT (action IN ('upload approved', 'upload declined') AND completed_at IS NOT NULL))""",
       uses=JOBS)
def timeline(spark, sf):
    logs = spark.sql(LOGS, lineitem=table(spark, sf, "lineitem"))
    return K.timeline(jobs(spark, sf), logs).withColumn("happened", F.date_format("happened", "yyyy-MM-dd HH:mm"))
