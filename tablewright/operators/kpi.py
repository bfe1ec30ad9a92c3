"""Job-table KPIs: canonical status, scoped rows, totals, trends, workload, history, timeline.

A jobs table has id, user_id, status, payload_status, uploaded_at, completed_at and more; a records table has
many rows per job. Records are always counted per job before they meet the jobs, so a job with very many
records costs one row in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Job states, their older spellings, and the payload states that mean "waiting for an agent".
STATUSES = (
    "queued", "planning", "running", "succeeded", "failed", "quarantined", "callback_failed",
    "awaiting_schema_approval", "awaiting_confirmation", "declined", "awaiting_clarification",
)
STATUS_ALIASES = {
    "pending": "queued", "processing": "running", "complete": "succeeded", "success": "succeeded",
    "partial": "failed", "rejected": "quarantined",
}
WAITING_PAYLOADS = ("pending_agent_availability", "rejected")
FAILED_STATUSES = ("failed", "callback_failed", "declined")


def normalized_status(status: Column) -> Column:
    key = F.trim(F.lower(status))
    pairs = [F.lit(x) for kv in STATUS_ALIASES.items() for x in kv]
    return F.when(key.isNull() | (key == ""), "queued").otherwise(
        F.coalesce(F.try_element_at(F.create_map(*pairs), key), key))


def derived_status(status: Column, payload: Column) -> Column:
    """Status with the payload taken into account: waiting for an agent counts as quarantined."""
    waiting = status.isin("pending", "queued", "quarantined") & F.coalesce(payload, F.lit("")).isin(*WAITING_PAYLOADS)
    return F.when(waiting, "quarantined").otherwise(normalized_status(status))


def is_quarantined(status: Column, payload: Column) -> Column:
    state = normalized_status(status)
    note = F.coalesce(F.trim(F.lower(payload)), F.lit(""))
    return (state == "quarantined") | ((state == "queued") & note.isin(*WAITING_PAYLOADS))


def validity(status: Column) -> Column:
    """valid / pending / invalid by status; quarantined work waiting for approval is pending."""
    state = normalized_status(status)
    return (
        F.when(state.isin("failed", "callback_failed"), "invalid")
        .when(state.isin("running", "awaiting_schema_approval"), "pending")
        .otherwise("valid")
    )


def in_period(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Both ends optional and inclusive."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end))
    return df


def scoped(jobs: DataFrame, role: str, me: int, users: DataFrame | None = None) -> DataFrame:
    """Own rows for an employee, rows of the team for a manager, all rows for others."""
    if role == "employee":
        return jobs.where(F.col("user_id") == me)
    if role == "manager":
        team = users.where(F.col("manager_id") == me).select(F.col("id").alias("user_id"))
        return jobs.join(team, "user_id", "left_semi")
    return jobs


def matches_per_key(left: DataFrame, right: DataFrame, left_key: str, right_key: str, out: str) -> DataFrame:
    """Left rows with the number of matching right rows, zero for none; the right side is counted first."""
    counts = right.groupBy(F.col(right_key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    joined = left.join(counts, F.col(left_key) == F.col("_k"), "left")
    return joined.withColumn(out, F.coalesce(F.col("_n"), F.lit(0))).drop("_k", "_n")


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy(derived_status(F.col("status"), F.col("payload_status")).alias("status")).agg(F.count(F.lit(1)).alias("jobs"))


def _one(state: str) -> Column:
    return F.count_if(F.col("_status") == state)


def totals(jobs: DataFrame) -> DataFrame:
    """One row with every bucket of the KPI header and the completion rate in percent."""
    df = jobs.withColumn("_status", derived_status(F.col("status"), F.col("payload_status")))
    return df.agg(
        F.count(F.lit(1)).alias("uploads"), _one("queued").alias("queued"), _one("planning").alias("planning"),
        _one("running").alias("running"), _one("succeeded").alias("succeeded"),
        F.count_if(F.col("_status").isin("failed", "callback_failed")).alias("failed"),
        _one("quarantined").alias("quarantined"), _one("callback_failed").alias("callback_failed"),
        _one("awaiting_schema_approval").alias("awaiting_schema_approval"),
        _one("awaiting_confirmation").alias("awaiting_confirmation"), _one("declined").alias("declined"),
        F.count_if(F.col("_status").isin("queued", "planning")).alias("pending"),
        F.coalesce(F.bround(F.try_divide(_one("succeeded"), F.count(F.lit(1))) * 100, 1), F.lit(0.0)).alias("completion_rate"),
    )


def duration_seconds(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end).cast("double")


def average_duration(jobs: DataFrame) -> DataFrame:
    done = jobs.where(F.col("completed_at").isNotNull())
    return done.agg(F.coalesce(F.avg(duration_seconds(F.col("uploaded_at"), F.col("completed_at"))), F.lit(0.0)).alias("average_seconds"))


def completion_minutes(jobs: DataFrame) -> Column:
    """Minutes per finished job, rounded half up and never negative."""
    seconds = duration_seconds(F.col("uploaded_at"), F.col("completed_at"))
    return F.greatest(F.lit(0.0), F.floor(seconds / 60 + 0.5).cast("double"))


def average_minutes(jobs: DataFrame) -> DataFrame:
    done = jobs.where((normalized_status(F.col("status")) == "succeeded") & F.col("completed_at").isNotNull())
    mean = F.avg(completion_minutes(done))
    return done.agg(F.coalesce(F.floor(mean + 0.5), F.lit(0)).cast("bigint").alias("average_minutes"))


def format_counts(jobs: DataFrame) -> DataFrame:
    return (
        jobs.groupBy(F.coalesce("output_format", F.lit("Unknown")).alias("output_format"))
        .agg(F.count(F.lit(1)).alias("jobs")).orderBy(F.desc("jobs"), "output_format")
    )


def daily_trend(jobs: DataFrame, records: DataFrame, record_key: str, groups: int | None = None) -> DataFrame:
    """Uploads and records per day and status, by day; ``groups`` keeps the first groups of the report."""
    counted = matches_per_key(jobs, records, "id", record_key, "_records")
    trend = counted.groupBy(
        F.to_date("uploaded_at").alias("day"), derived_status(F.col("status"), F.col("payload_status")).alias("status")
    ).agg(F.count(F.lit(1)).alias("uploads"), F.sum("_records").alias("records"))
    return trend.orderBy("day", "status").limit(groups) if groups else trend


def trend_by_day(trend: DataFrame) -> DataFrame:
    """One wide row per day; missing states are zero and some buckets add two states."""
    states = [s for s in STATUSES if s != "awaiting_clarification"]
    wide = trend.groupBy("day").agg(
        F.sum("uploads").alias("uploads"), F.sum("records").alias("records"),
        *[F.coalesce(F.sum(F.when(F.col("status") == s, F.col("uploads"))), F.lit(0)).alias(f"_{s}") for s in states])
    plain = [s for s in states if s != "failed"]
    return wide.select(
        "day", "uploads", "records", *[F.col(f"_{s}").alias(s) for s in plain],
        (F.col("_failed") + F.col("_callback_failed")).alias("failed"), F.col("_succeeded").alias("complete"),
        F.col("_quarantined").alias("awaiting_agent"), (F.col("_queued") + F.col("_planning")).alias("pending"),
        F.col("_running").alias("processing"))


def workload(jobs: DataFrame, owner: str, top: int | None = 6) -> DataFrame:
    """Jobs, finished jobs, latest upload and success rate per owner, busiest first."""
    done = F.count_if(normalized_status(F.col("status")) == "succeeded")
    n = F.count(F.lit(1))
    rows = jobs.groupBy(F.coalesce(F.col(owner).cast("string"), F.lit("Unknown owner")).alias("owner")).agg(
        n.alias("jobs"), done.alias("completed"), F.max("uploaded_at").alias("latest"),
        F.concat(F.floor(done / n * 100 + 0.5).cast("string"), F.lit("%")).alias("success_rate"))
    return rows.orderBy(F.desc("jobs"), "owner").limit(top) if top else rows


def period_counts(jobs: DataFrame, today: str) -> DataFrame:
    """Jobs of today, of the last seven days and of this month, seen from a given day."""
    day = F.lit(today).cast("date")
    at = F.to_date("uploaded_at")
    state = normalized_status(F.col("status"))
    done = F.count_if(state == "succeeded")
    return jobs.agg(
        F.count_if(at >= day).alias("jobs_today"), F.count_if(at >= F.date_sub(day, 6)).alias("jobs_this_week"),
        F.count_if(at >= F.trunc(day, "month")).alias("jobs_this_month"),
        F.coalesce(F.floor(F.try_divide(done, F.count(F.lit(1))) * 100 + 0.5), F.lit(0)).cast("bigint").alias("completion_rate"),
        done.alias("complete"), F.count_if(state == "running").alias("running"),
        F.count_if(state == "quarantined").alias("quarantined"), F.count_if(state == "failed").alias("failed"))


def filled_days(df: DataFrame, day: str, value: str) -> DataFrame:
    """Every day between the first and the last, missing ones with zero."""
    spine = df.agg(F.min(day).alias("_a"), F.max(day).alias("_b")).select(
        F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias(day))
    return spine.join(df, day, "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def version_history(jobs: DataFrame) -> DataFrame:
    """Version number of each job within its lineage, from 1 in upload order, by way of the block-wise numbering."""
    from tablewright.operators.ordered import number_rows

    rooted = jobs.select("id", F.coalesce("parent_id", "id").alias("root_id"), "uploaded_at")
    return number_rows(rooted, ["uploaded_at", "id"], ["root_id"], tie=[], out="version")


def next_version(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy(F.coalesce("parent_id", "id").alias("root_id")).agg((F.count(F.lit(1)) + 1).alias("next_version"))


def timeline(jobs: DataFrame, logs: DataFrame, ordered: bool = False) -> DataFrame:
    """Events of each job: created, dispatched, then completed / failed / in review from its own columns, plus its log
    rows that do not repeat those. ``ordered`` sorts by job and time, rows without a time first."""
    own = jobs.withColumn("_state", normalized_status(F.col("status")))
    created = own.select("id", F.col("uploaded_at").alias("happened"), F.lit("upload created").alias("action"), F.col("file_name").alias("detail"))
    sent = own.where(F.col("dispatched_at").isNotNull()).select(
        "id", F.col("dispatched_at").alias("happened"), F.lit("agent dispatched").alias("action"), F.lit("queue").alias("detail"))
    state = F.col("_state")
    review = state.isin("awaiting_confirmation", "awaiting_clarification")
    verdict = (
        F.when(state == "succeeded", "workflow completed").when(state.isin(*FAILED_STATUSES), "workflow failed")
        .when(review, "interpretation review requested").when(state == "quarantined", "workflow quarantined")
    )
    at = F.when(review, F.col("uploaded_at")).otherwise(F.col("completed_at"))
    closing = own.where(F.col("completed_at").isNotNull()).select(
        "id", at.alias("happened"), verdict.alias("action"), state.alias("detail")).where("action IS NOT NULL")
    noted = logs.join(own.select("id", "file_name", "completed_at"), "id")
    repeat = (F.col("action") == "upload created") & ((F.col("detail") == "workflow_created") | (F.col("detail") == F.col("file_name")))
    repeat = repeat | (F.col("action").isin("upload approved", "upload declined") & F.col("completed_at").isNotNull())
    kept = noted.where(~F.coalesce(repeat, F.lit(False))).select("id", "happened", "action", "detail")
    events = created.unionByName(sent).unionByName(closing).unionByName(kept)
    return events.orderBy("id", F.asc_nulls_first("happened"), "action", "detail") if ordered else events


def expired_sessions(sessions: DataFrame, started: str, now: str, minutes: int = 30) -> DataFrame:
    """Open sessions whose time is over at ``now``."""
    return sessions.where(F.col(started) + F.expr(f"interval {int(minutes)} minutes") < F.lit(now).cast("timestamp_ntz"))


def agreement(df: DataFrame, first: Column, second: Column) -> DataFrame:
    """(verdict, n, share): how often two verdicts agree, disagree, or the second is missing."""
    verdict = F.when(second.isNull(), "unavailable").when(first == second, "agree").otherwise("disagree")
    counts = df.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / counts.agg(F.sum("n")).scalar(), 6))  # three verdicts at most


def ambiguity(references: DataFrame, key: str, confidence: Column) -> DataFrame:
    """Mean confidence of the best candidates over the unresolved references of each key; no candidate counts as 0."""
    return references.groupBy(key).agg(F.round(F.avg(F.coalesce(confidence, F.lit(0.0))), 6).alias("score"))
