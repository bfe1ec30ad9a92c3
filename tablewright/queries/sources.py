"""Scans, file facts, sinks, records.

The given tables are Parquet, so Spark first writes them in the format under test into a fresh shared folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.queries.base import query, table, view
from tablewright.session import durable, shared_folder
from tablewright.sources import files as R
from tablewright.sources import sinks as W

NA = "CASE c_custkey % 6 WHEN 0 THEN 'NA' WHEN 1 THEN 'n/a' WHEN 2 THEN 'NaN' WHEN 3 THEN concat('a, \"b\" ', c_mktsegment) ELSE c_mktsegment END"
NA_SQL = "CASE WHEN c_custkey % 6 < 3 THEN NULL WHEN c_custkey % 6 = 3 THEN concat('a, \"b\" ', c_mktsegment) ELSE c_mktsegment END"


def delimited(spark, sf, sep):
    folder = shared_folder(spark)
    df = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.expr(NA).alias("segment"))
    df.write.option("header", True).option("sep", sep).option("escape", '"').csv(folder)
    return R.read_delimited(spark, folder, ["id", "segment"], sep)


@query("s01_csv_scan", f"SELECT cast(c_custkey AS string) AS id, {NA_SQL} AS segment FROM customer")
def csv_scan(spark, sf):
    return delimited(spark, sf, ",")


@query("s02_tsv_scan", f"SELECT cast(c_custkey AS string) AS id, {NA_SQL} AS segment FROM customer")
def tsv_scan(spark, sf):
    return delimited(spark, sf, "\t")


@query("s01_reordered_header", f"SELECT cast(c_custkey AS string) AS id, {NA_SQL} AS segment, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name FROM customer")
def reordered_header(spark, sf):
    """Columns stand in the files in another order than they are asked for, with one more between them."""
    folder = shared_folder(spark)
    df = table(spark, sf, "customer").select(F.expr(NA).alias("segment"), F.col("c_nationkey"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN c_name END").alias("name"), F.col("c_custkey").cast("string").alias("id"))
    df.write.option("header", True).option("escape", '"').csv(folder)
    return R.read_delimited(spark, folder, ["id", "segment", "name"])


CELL = "concat(c_name, CASE c_custkey % 5 WHEN 0 THEN '{0}second \"line\"' WHEN 1 THEN ', one' WHEN 2 THEN '{0}{0}\"{0}' WHEN 3 THEN '' ELSE ' 5\" pipe' END)"


@query("s01_multiline_cells", f"""
SELECT cast(c_custkey AS string) AS id, {CELL.replace("{0}", "' || chr(10) || '")} AS note, c_mktsegment AS segment FROM customer""")
def multiline_cells(spark, sf):
    """Cells with line ends, quotes and separators make the round trip; two files' headers differ in order."""
    folder = shared_folder(spark)
    df = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.expr(CELL.replace("{0}", "\\n")).alias("note"), F.col("c_mktsegment").alias("segment"))
    odd = F.col("id").cast("bigint") % 2 == 1
    plain = {"header": True, "escape": "\"", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.where(odd).repartition(2).write.options(**plain).csv(folder)
    df.where(~odd).select("segment", "note", "id").write.mode("append").options(**plain, quoteAll=True).csv(folder)
    return R.read_delimited(spark, folder, ["id", "note", "segment"], multiline=True)


def json_folder(spark, sf, wrapped):
    """Documents of at most 500 rows each, one per file."""
    folder = shared_folder(spark)
    rows = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", F.floor(F.col("p_partkey") / 500).alias("bucket"))
    body = F.to_json(F.collect_list(F.struct("p_partkey", "p_name", "p_size")))
    doc = F.concat(F.lit('{"title": "parts", "rows": '), body, F.lit("}")) if wrapped else body
    rows.groupBy("bucket").agg(doc.alias("value")).write.partitionBy("bucket").text(folder)
    return f"{folder}/bucket=*"


PART = "p_partkey bigint, p_name string, p_size bigint"
PART_SQL = "SELECT p_partkey, p_name, cast(p_size AS BIGINT) AS p_size FROM part"


@query("s03_json_array_scan", PART_SQL)
def json_array(spark, sf):
    return R.read_json_table(spark, json_folder(spark, sf, False), PART)


@query("s03_json_object_scan", PART_SQL)
def json_object(spark, sf):
    return R.read_json_table(spark, json_folder(spark, sf, True), PART)


@query("s03_first_list", PART_SQL)
def json_first_list(spark, sf):
    """Of several lists the first non-empty one with objects, in the order of the document; names in another order; no schema given."""
    folder = shared_folder(spark)
    rows = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", F.floor(F.col("p_partkey") / 500).alias("bucket"))
    body = F.to_json(F.collect_list(F.struct("p_partkey", "p_name", "p_size")))
    doc = F.concat(F.lit('{"title": "x", "none": [], "tags": ["a"], "zeta": '), body, F.lit(', "alpha": [{"p_partkey": -1}], "meta": {"n": 1}}'))
    rows.groupBy("bucket").agg(doc.alias("value")).write.partitionBy("bucket").text(folder)
    return R.read_json_table(spark, f"{folder}/bucket=*").select("p_partkey", "p_name", "p_size")


@query("s04_text_scan", r"""
SELECT raw_text, count(*) AS n, true AS numbered FROM (SELECT trim(regexp_replace(unnest(string_split_regex(text, '\r\n|\n|\r')), '^\s+|\s+$', '', 'g')) AS raw_text FROM conversations) WHERE raw_text <> '' GROUP BY 1""")
def text_scan(spark, sf):
    folder = shared_folder(spark)
    table(spark, sf, "conversations").select("text").write.text(folder)
    lines = R.read_lines(spark, folder)
    dense = lines.groupBy("file").agg((F.max("line_number") == F.count(F.lit(1))) & (F.count_distinct("line_number") == F.count(F.lit(1)))).toDF("file", "ok")
    all_dense = dense.agg(F.bool_and("ok")).scalar()
    return lines.groupBy("raw_text").agg(F.count(F.lit(1)).alias("n")).withColumn("numbered", all_dense)


@query("s05_delimited_row_count", "SELECT count(*) AS row_count FROM orders")
def row_count(spark, sf):
    folder = shared_folder(spark)
    table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").write.option("header", True).csv(folder)
    return R.count_delimited_rows(spark, folder)


@query("s06_preview", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS row_count FROM orders ORDER BY o_orderkey LIMIT 50")
def preview(spark, sf):
    return R.preview(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 50, ["o_orderkey"])


@query("s07_file_facts")
def file_facts(spark, sf):
    return R.file_facts(spark, f"{sf}/*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("file"), "size_bytes", "fingerprint")


@query("s08_drift_check", """
SELECT 'region' AS part, CASE WHEN EXISTS (SELECT r_regionkey, r_name FROM region EXCEPT SELECT r_regionkey, r_name FROM region) THEN 'changed' ELSE 'same' END AS verdict
UNION ALL SELECT 'orders', CASE WHEN EXISTS (SELECT o_orderkey, o_orderstatus FROM orders EXCEPT SELECT o_orderkey, lower(o_orderstatus) FROM orders) THEN 'changed' ELSE 'same' END
UNION ALL SELECT 'part', CASE WHEN EXISTS (SELECT 1 FROM part) THEN 'missing' END""")
def drift(spark, sf):
    """Two listings of written tables; between them one is written again as it was, one changed, and one leaves the list."""
    folder = shared_folder(spark)
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    regions = table(spark, sf, "region").select("r_regionkey", "r_name")

    def facts(names):
        return durable(R.folder_facts(R.file_facts(spark, [f"{folder}/{n}/part-*" for n in names])))

    regions.write.csv(f"{folder}/region")
    orders.write.csv(f"{folder}/orders")
    table(spark, sf, "part").select("p_partkey", "p_name").write.csv(f"{folder}/part")
    before = facts(["region", "orders", "part"])
    regions.write.mode("overwrite").csv(f"{folder}/region")
    orders.withColumn("o_orderstatus", F.lower("o_orderstatus")).write.mode("overwrite").csv(f"{folder}/orders")
    out = R.drifted(before, facts(["region", "orders"]))
    return out.select(F.element_at(F.split("path", "/"), -1).alias("part"), "verdict")


@query("s09_csv_sink", "SELECT cast(event_id AS string) AS event_id, event_type, CASE WHEN event_id % 10 > 2 THEN cast(value AS string) END AS value FROM events")
def csv_sink(spark, sf):
    from tablewright.queries.cleaning import ODD

    folder = shared_folder(spark)
    W.write_csv(table(spark, sf, "events").withColumn("value", F.expr(ODD)).select("event_id", "event_type", "value"), folder)
    return R.read_delimited(spark, folder, ["event_id", "event_type", "value"])


@query("s10_json_sink", "SELECT event_id, event_type, CASE WHEN event_id % 10 > 2 THEN value END AS value, 'Events' AS title FROM events")
def json_sink(spark, sf):
    from tablewright.queries.cleaning import ODD

    folder = shared_folder(spark)
    W.write_json(table(spark, sf, "events").withColumn("value", F.expr(ODD)).select("event_id", "event_type", "value"), folder, "Events")
    title = spark.read.schema("title string").json(f"{folder}/metadata")
    return spark.read.schema("event_id bigint, event_type string, value double").json(f"{folder}/data").withColumn("title", title.scalar())


@query("s11_text_sink", """
SELECT 'head' AS part, unnest(['Nations', '=======', '', concat(lpad('n_nationkey', greatest(w1, 11)::INTEGER, ' '), ' ', lpad('n_name', greatest(w2, 6)::INTEGER, ' '))]) AS value
FROM (SELECT max(length(cast(n_nationkey AS string))) AS w1, max(length(n_name)) AS w2 FROM nation)
UNION ALL SELECT 'data', concat(lpad(cast(n_nationkey AS string), greatest(w1, 11)::INTEGER, ' '), ' ', lpad(n_name, greatest(w2, 6)::INTEGER, ' ')) AS value
FROM nation, (SELECT max(length(cast(n_nationkey AS string))) AS w1, max(length(n_name)) AS w2 FROM nation)""")
def text_sink(spark, sf):
    folder = shared_folder(spark)
    W.write_text(table(spark, sf, "nation").select("n_nationkey", "n_name"), folder, "Nations")
    head, data = (spark.read.text(f"{folder}/{p}").select(F.lit(p).alias("part"), "value") for p in ("head", "data"))
    return head.unionByName(data)


@query("s12_audit_bundle", """
SELECT 'cleaned_data' AS part, count(*) AS n FROM orders UNION ALL SELECT 'filtered_data', count(*) FILTER (o_orderstatus = 'F') FROM orders
UNION ALL SELECT 'audit_log', count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'warnings', count(*) FILTER (o_totalprice > 200000) FROM orders
UNION ALL SELECT 'column_mapping', 0""")
def bundle(spark, sf):
    folder = shared_folder(spark)
    orders = table(spark, sf, "orders")
    log = orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows_out")).select(
        F.lit("user_requested").alias("step_kind"), F.concat(F.lit("keep "), "o_orderstatus").alias("operation"), F.col("rows_out").alias("rows_in"), "rows_out")
    warnings = orders.where("o_totalprice > 200000").select(F.concat(F.lit("large order "), F.col("o_orderkey").cast("string")).alias("warning"))
    parts = W.write_bundle(folder, orders.select("o_orderkey", "o_orderstatus"), orders.where("o_orderstatus = 'F'"), audit_log=log, warnings=lambda: warnings)
    out = None
    for p in parts:
        one = spark.read.parquet(f"{folder}/{p}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("s13_audit_shape", """
SELECT CASE WHEN l_returnflag = 'R' THEN 'internal_preparation' ELSE 'user_requested' END AS step_kind, CASE WHEN l_returnflag = 'R' THEN 'filter_prep' END AS origin,
  l_orderkey AS step, concat('["', l_returnflag, '","', l_linestatus, '"]') AS input_columns, NULL AS reason FROM lineitem
UNION ALL SELECT 'user_requested', 'user', event_id, NULL, event_type FROM events""")
def audit_shape(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "filter_prep").alias("origin"), F.col("l_orderkey").alias("step"), F.array("l_returnflag", "l_linestatus").alias("input_columns"))
    notes = table(spark, sf, "events").select(F.lit("user").alias("origin"), F.col("event_id").alias("step"), F.col("event_type").alias("reason"))
    return R.shape_audit(lines, notes)


@query("s14_to_records", """
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS record_index, concat('{"event_id":', event_id, ',"event_type":"', event_type, '"}') AS payload FROM events""")
def to_records(spark, sf):
    return R.to_records(table(spark, sf, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type"])


PAYLOAD = """CASE o_orderkey % 5
  WHEN 0 THEN concat('{"cleaned_data": [{"a": ', cast(o_orderkey AS string), ', "b": "x", "_private": 1}, {"a": 7, "b": "', o_orderstatus, '"}], "records": [{"a": 1, "b": "no"}]}')
  WHEN 1 THEN concat('{"cleaned_preview": [{"a": ', cast(o_orderkey AS string), ', "b": "p"}], "record_count": 1}')
  WHEN 2 THEN concat('{"cleaned_preview": [{"a": ', cast(o_orderkey AS string), ', "b": "short"}], "record_count": 9}')
  WHEN 3 THEN concat('{"rows": [{"a": ', cast(o_orderkey AS string), ', "b": null}], "data": [{"a": 0, "b": "no"}]}')
  ELSE '{"status": "empty"}' END"""


@query("s15_from_records", """
SELECT o_orderkey, 1::BIGINT AS record_index, o_orderkey AS a, CASE o_orderkey % 5 WHEN 0 THEN 'x' WHEN 1 THEN 'p' END AS b FROM orders WHERE o_orderkey % 5 IN (0, 1, 3)
UNION ALL SELECT o_orderkey, 2, 7, o_orderstatus FROM orders WHERE o_orderkey % 5 = 0""")
def from_records(spark, sf):
    results = table(spark, sf, "orders").select("o_orderkey", F.expr(PAYLOAD).alias("payload"))
    return R.from_records(results, "o_orderkey", "payload", "a: bigint, b: string")


@query("s16_job_table_scan", "SELECT o_orderkey, o_custkey FROM orders")
def job_table(spark, sf):
    return R.read_job_table(spark, "orders", folder=sf).select("o_orderkey", "o_custkey")
