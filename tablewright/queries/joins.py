"""Joins over the job tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import kpi as K
from tablewright.operators.rows import first_per_key
from tablewright.queries.base import query, table, view

JOBS = ("jobs",)


@query("j01_inner_join_records", """
SELECT output_format, count(*) AS records FROM lineitem JOIN jobs ON l_orderkey = id
WHERE uploaded_at >= TIMESTAMP '1996-01-01' GROUP BY 1""", uses=JOBS)
def inner_join(spark, sf):
    jobs = K.in_period(view(spark, sf, "jobs"), "uploaded_at", "1996-01-01").select("id", "output_format")
    per_job = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return per_job.join(jobs, per_job.l_orderkey == jobs.id).groupBy("output_format").agg(F.sum("n").alias("records"))


@query("j01_inner_join_rows", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, status FROM lineitem JOIN jobs ON l_orderkey = id WHERE amount > 400000""", uses=JOBS)
def inner_rows(spark, sf):
    jobs = view(spark, sf, "jobs").where("amount > 400000").select("id", "status")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return lines.join(jobs, lines.l_orderkey == jobs.id).drop("id")


@query("j02_outer_join_count", "SELECT c_custkey, count(o_orderkey) AS jobs FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1")
def outer_join(spark, sf):
    users = table(spark, sf, "customer").select("c_custkey")
    failed = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_custkey")
    return K.matches_per_key(users, failed, "c_custkey", "o_custkey", "jobs")


@query("j03_preaggregated_join", """
SELECT id, status, coalesce(n, 0) AS records FROM jobs LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = id""", uses=JOBS)
def preaggregated(spark, sf):
    return K.matches_per_key(view(spark, sf, "jobs").select("id", "status"), table(spark, sf, "lineitem"), "id", "l_orderkey", "records")


@query("j04_semi_join", """
SELECT id, user_id, status FROM jobs WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)""", uses=JOBS)
def semi_join(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("manager_id"))
    return K.scoped(view(spark, sf, "jobs"), "manager", 7, users).select("id", "user_id", "status")


@query("j05_self_join_team", """
SELECT e.c_custkey, m.c_name AS manager_name, coalesce(t.n, 0) AS team_size FROM customer e
LEFT JOIN customer m ON m.c_custkey = e.c_nationkey LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) t ON t.c_nationkey = e.c_custkey""")
def self_join(spark, sf):
    staff = table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("bigint").alias("manager_id"))
    managers = staff.select(F.col("c_custkey").alias("manager_id"), F.col("c_name").alias("manager_name"))
    with_manager = staff.join(managers, "manager_id", "left")
    return K.matches_per_key(with_manager, staff.select("manager_id"), "c_custkey", "manager_id", "team_size").select("c_custkey", "manager_name", "team_size")


@query("j06_failure_reasons", """
SELECT id, status, reason_at, reason_part FROM (
  SELECT j.id, CASE status WHEN 'partial' THEN 'failed' ELSE status END AS status, j.uploaded_at, strftime(l_shipdate, '%Y-%m-%d') AS reason_at, l_partkey AS reason_part,
    row_number() OVER (PARTITION BY j.id ORDER BY l_shipdate DESC, l_partkey DESC) AS rn
  FROM jobs j JOIN lineitem ON l_orderkey = j.id WHERE status IN ('failed', 'callback_failed', 'declined'))
WHERE rn = 1 ORDER BY uploaded_at DESC, id LIMIT 5""", uses=JOBS)
def failure_reasons(spark, sf):
    """The latest comment of each failed job, for the five latest jobs that have one."""
    jobs = view(spark, sf, "jobs").where(F.col("status").isin("failed", "callback_failed", "declined"))
    comments = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max(F.struct("l_shipdate", "l_partkey")).alias("c"))
    top = jobs.join(comments, jobs.id == comments.l_orderkey).orderBy(F.desc("uploaded_at"), "id").limit(5)
    return top.select("id", K.normalized_status(F.col("status")).alias("status"), F.date_format("c.l_shipdate", "yyyy-MM-dd").alias("reason_at"),
                      F.col("c.l_partkey").alias("reason_part"))


@query("j08_filled_days", """
WITH d AS (SELECT cast(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'error' AND value > 60 GROUP BY 1)
SELECT strftime(s.day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n
FROM (SELECT unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS day) s LEFT JOIN d ON d.day = s.day""")
def filled_days(spark, sf):
    daily = table(spark, sf, "events").where("event_type = 'error' AND value > 60").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return K.filled_days(daily, "day", "n").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")
