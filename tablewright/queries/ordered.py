"""Running values, sorting, top-k, leaders and gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import aggregate as A
from tablewright.operators import kpi
from tablewright.operators import ordered as R
from tablewright.operators import rows as S
from tablewright.operators.quality import uncovered_spans
from tablewright.queries.base import query, table, view

EVENT_VALUE = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE cast(round(value * 100) AS bigint) END"


def cents(spark, sf):
    """Events with whole cents and a gap at every seventh id."""
    return table(spark, sf, "events").select("event_id", "user_id", "ts", F.expr(EVENT_VALUE).alias("cents"))


@query("w01_running_total", f"""
SELECT event_id, CASE WHEN cents IS NOT NULL THEN cast(sum(cents) OVER (ORDER BY ts, event_id) AS bigint) END AS running
FROM (SELECT event_id, ts, {EVENT_VALUE} AS cents FROM events)""")
def running_total(spark, sf):
    return R.running_total(cents(spark, sf), "cents", ["ts"], tie=["event_id"], out="running").select("event_id", "running")


@query("w01_running_total_by_user", f"""
SELECT event_id, CASE WHEN cents IS NOT NULL THEN cast(sum(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bigint) END AS running
FROM (SELECT event_id, user_id, ts, {EVENT_VALUE} AS cents FROM events)""")
def running_total_by_user(spark, sf):
    return R.running_total(cents(spark, sf), "cents", ["ts"], ["user_id"], ["event_id"], "running").select("event_id", "running")


PCT = """
SELECT event_id, CASE WHEN prev <> 0 THEN round((cur - prev) / prev, 9) END AS change FROM (
  SELECT event_id, cur, lag(cur) OVER ({p} ORDER BY ts, event_id) AS prev FROM (
    SELECT event_id, user_id, ts, last_value(cents IGNORE NULLS) OVER ({p} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cur
    FROM (SELECT event_id, user_id, ts, {v} AS cents FROM events)))"""


@query("w02_percentage_change", PCT.format(p="", v=EVENT_VALUE))
def percentage_change(spark, sf):
    out = R.percentage_change(cents(spark, sf), "cents", ["ts"], tie=["event_id"], out="change")
    return out.select("event_id", F.round("change", 9).alias("change"))


@query("w02_percentage_change_by_user", PCT.format(p="PARTITION BY user_id", v=EVENT_VALUE))
def percentage_change_by_user(spark, sf):
    out = R.percentage_change(cents(spark, sf), "cents", ["ts"], ["user_id"], ["event_id"], "change")
    return out.select("event_id", F.round("change", 9).alias("change"))


@query("w03_entity_columns", """
SELECT name AS entity_column FROM (
  SELECT 'c_name' AS name, count(DISTINCT c_name) AS d, count(*) AS n FROM customer
  UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment), count(*) FROM customer)
WHERE d > 1 AND d < n * 0.5""")
def entity_columns(spark, sf):
    df = table(spark, sf, "customer")
    names = A.entity_columns(df, ["c_custkey", "c_acctbal"])
    present = df.agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    return present.select(F.explode(F.array(*[F.lit(n) for n in names]).cast("array<string>")).alias("entity_column"))


@query("w04_version_history", """
SELECT id, coalesce(parent_id, id) AS root_id, row_number() OVER (PARTITION BY coalesce(parent_id, id) ORDER BY uploaded_at, id) AS version
FROM jobs""", uses=("jobs",))
def version_history(spark, sf):
    return kpi.version_history(view(spark, sf, "jobs")).select("id", "root_id", "version")


@query("w04_next_version", "SELECT coalesce(parent_id, id) AS root_id, count(*) + 1 AS next_version FROM jobs GROUP BY 1", uses=("jobs",))
def next_version(spark, sf):
    return kpi.next_version(view(spark, sf, "jobs"))


@query("w05_latest_per_key", """
SELECT user_id, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_per_key(spark, sf):
    df = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    return S.first_per_key(df, ["user_id"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("w06_first_reason", """
SELECT conv_id, turn, role FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn FROM conversations WHERE role = 'assistant') WHERE rn = 1""")
def first_reason(spark, sf):
    df = table(spark, sf, "conversations").where("role = 'assistant'")
    return S.first_per_key(df, ["conv_id"], [F.asc("turn"), F.asc("role"), F.asc("text")]).select("conv_id", "turn", "role")


@query("w07_record_numbers", """
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS record_index FROM events""")
def record_numbers(spark, sf):
    df = table(spark, sf, "events").select("user_id", "event_id", "ts")
    return R.number_rows(df, ["ts"], ["user_id"], ["event_id"], "record_index").drop("ts")


@query("w08_leaders", """
WITH r AS (SELECT l_orderkey, concat(l_partkey, ':', l_suppkey, ':', l_linenumber) AS name, l_quantity / 50 AS score,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity / 50 DESC, l_partkey, l_suppkey, l_linenumber) AS rn FROM lineitem)
SELECT a.l_orderkey, a.name AS leader, a.score AS leader_score, b.name AS runner_up, b.score AS runner_up_score,
  round(a.score - coalesce(b.score, 0), 6) AS margin, b.name IS NOT NULL AND round(a.score - coalesce(b.score, 0), 6) <= 0.05 AS ambiguous
FROM (SELECT * FROM r WHERE rn = 1) a LEFT JOIN (SELECT * FROM r WHERE rn = 2) b USING (l_orderkey)""")
def leaders(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_quantity") / 50).alias("score"))
    return S.leaders(df, "l_orderkey", ["l_partkey", "l_suppkey", "l_linenumber"], "score", 0.05)


SPANS_SQL = """
SELECT doc_id, s AS span_start, least(s + 20 + (s * 7 + doc_id) % 120, n_chars) AS span_end
FROM (SELECT doc_id, n_chars, unnest(generate_series(13, n_chars, 97)) AS s FROM documents)"""


@query("w09_uncovered_spans", f"""
WITH spans AS ({SPANS_SQL}), b AS (
  SELECT doc_id, span_start, coalesce(max(span_end) OVER (PARTITION BY doc_id ORDER BY span_start, span_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM spans
  UNION ALL SELECT d.doc_id, d.n_chars, coalesce(m.e, 0) FROM documents d LEFT JOIN (SELECT doc_id, max(span_end) AS e FROM spans GROUP BY 1) m USING (doc_id))
SELECT b.doc_id, reached AS gap_start, span_start AS gap_end FROM b JOIN documents d ON d.doc_id = b.doc_id
WHERE span_start > reached AND regexp_matches(substring(d.text, reached + 1, span_start - reached), '\\S')""")
def gaps(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    starts = docs.where("n_chars >= 13").select("doc_id", "n_chars", F.explode(F.expr("sequence(13, n_chars, 97)")).alias("span_start"))
    spans = starts.select("doc_id", "span_start", F.expr("least(span_start + 20 + (span_start * 7 + doc_id) % 120, n_chars)").alias("span_end"))
    return uncovered_spans(docs, spans, "doc_id")


@query("o01_sort_rows", "SELECT id, segment, balance FROM sheet ORDER BY segment ASC NULLS LAST, balance DESC NULLS LAST, id", uses=("sheet",))
def sort_rows(spark, sf):
    return S.sort_rows(view(spark, sf, "sheet").select("id", "segment", "balance"), [("segment", "asc"), ("balance", "desc"), ("id", "asc")])


@query("o02_limit_after_filter", "SELECT id, balance FROM sheet WHERE balance > 0 ORDER BY id LIMIT 25", uses=("sheet",))
def limit_after_filter(spark, sf):
    from tablewright.operators.filters import Condition, filter_rows

    return filter_rows(view(spark, sf, "sheet"), [Condition("balance", "gt", 0)], select=["id", "balance"], limit=25, order=["id"])


@query("o03_latest_rows", "SELECT id, user_id, status FROM jobs ORDER BY uploaded_at DESC, id DESC LIMIT 100", uses=("jobs",))
def latest_rows(spark, sf):
    return S.latest_rows(view(spark, sf, "jobs"), ["uploaded_at", "id"]).select("id", "user_id", "status")


_NUM = r"CASE WHEN regexp_matches(trim(quantity_text), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') THEN cast(quantity_text AS double) END"


@query("o04_page_by_any_column", f"""
SELECT id, balance_text FROM sheet
ORDER BY ({_NUM.replace('quantity_text', 'balance_text')}) IS NULL NULLS FIRST, {_NUM.replace('quantity_text', 'balance_text')} NULLS FIRST, lower(balance_text) NULLS FIRST, id
LIMIT 25 OFFSET 50""", uses=("sheet",))
def page(spark, sf):
    return S.page(view(spark, sf, "sheet").select("id", "balance_text"), "balance_text", 2, 25, tie=["id"])


@query("o05_custom_order", """
SELECT s_suppkey, state FROM (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'degraded' WHEN 2 THEN 'idle' ELSE 'lost' END AS state FROM supplier)
ORDER BY CASE state WHEN 'degraded' THEN 0 WHEN 'idle' THEN 1 WHEN 'active' THEN 2 ELSE 3 END, s_suppkey""")
def custom_order(spark, sf):
    state = F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'degraded' WHEN 2 THEN 'idle' ELSE 'lost' END").alias("state")
    df = table(spark, sf, "supplier").select("s_suppkey", state)
    return df.orderBy(S.custom_order(F.col("state"), ["degraded", "idle", "active"]), "s_suppkey")


@query("o06_top_by_invocations", "SELECT l_suppkey, count(*) AS invocations FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
def top_by_invocations(spark, sf):
    return S.count_per_key(table(spark, sf, "lineitem"), "l_suppkey", "invocations", top=6)


@query("o07_frequent_values", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 5")
def frequent_values(spark, sf):
    return S.top_values(table(spark, sf, "lineitem"), "l_partkey", 5)


@query("o07_rare_values", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n, p_brand LIMIT 5")
def rare_values(spark, sf):
    return S.top_values(table(spark, sf, "part"), "p_brand", 5, rare=True)
