"""Chart data and result contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import charts as C
from tablewright.operators.charts import Field
from tablewright.queries.base import query, table, view


@query("r01_chart_sum", "SELECT o_orderpriority, round(sum(cast(o_totalprice AS decimal(18,2)))::double, 2) AS value FROM orders GROUP BY 1")
def chart_sum(spark, sf):
    return C.chart_data(table(spark, sf, "orders"), "o_orderpriority", "sum", "o_totalprice").withColumn("value", F.round("value", 2))


@query("r01_chart_count", "SELECT segment, count(*) AS value FROM sheet WHERE segment IS NOT NULL GROUP BY 1", uses=("sheet",))
def chart_count(spark, sf):
    return C.chart_data(view(spark, sf, "sheet"), "segment")


ROLES = """SELECT l_orderkey, {array}(CASE WHEN l_linenumber % 3 = 0 THEN 'measure' ELSE 'none' END, CASE WHEN l_partkey % 4 = 0 THEN 'category' WHEN l_partkey % 4 = 1 THEN 'dimension' ELSE 'none' END,
  CASE WHEN l_suppkey % 5 = 0 THEN 'time' ELSE 'none' END) AS roles, CASE WHEN l_linenumber % 3 = 0 THEN 1 + l_partkey % 2 ELSE 0 END AS numeric_measures,
  CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'auto' ELSE 'pie' END AS wanted FROM {lineitem}"""
SHAPE_SQL = """CASE WHEN list_contains(roles, 'time') THEN 'time_series' WHEN list_contains(roles, 'category') AND list_contains(roles, 'measure') THEN 'categorical_series'
  WHEN list_contains(roles, 'dimension') AND numeric_measures > 0 THEN 'histogram_bins' WHEN numeric_measures = 2 AND NOT list_contains(roles, 'category') THEN 'scatter_points' ELSE 'scalar' END"""
ROLES_SQL = ROLES.replace("{array}", "list_value").replace("{lineitem}", "lineitem")


def shaped(spark, sf):
    df = spark.sql(ROLES.replace("{array}", "array"), lineitem=table(spark, sf, "lineitem"))
    return df.withColumn("shape", C.data_shape(F.col("roles"), F.col("numeric_measures")))


@query("r02_data_shape", f"SELECT {SHAPE_SQL} AS shape, count(*) AS n FROM ({ROLES_SQL}) GROUP BY 1")
def shape(spark, sf):
    return shaped(spark, sf).groupBy("shape").agg(F.count(F.lit(1)).alias("n"))


@query("r03_chart_choice", f"""
SELECT CASE WHEN wanted = 'pie' THEN 'pie' ELSE CASE {SHAPE_SQL} WHEN 'time_series' THEN 'line' WHEN 'categorical_series' THEN 'bar' WHEN 'histogram_bins' THEN 'histogram' WHEN 'scatter_points' THEN 'scatter' ELSE 'bar' END END AS chart,
  count(*) AS n FROM ({ROLES_SQL}) GROUP BY 1""")
def choice(spark, sf):
    return shaped(spark, sf).groupBy(C.chart_for(F.col("shape"), F.col("wanted")).alias("chart")).agg(F.count(F.lit(1)).alias("n"))


@query("r04_chart_checks", """
SELECT 'line' AS chart, count(DISTINCT o_orderdate) >= 2 AS valid, CASE WHEN count(DISTINCT o_orderdate) < 2 THEN 'line_incompatible_insufficient_x_values' END AS reason FROM orders
UNION ALL SELECT 'bar', count(*) > 0, NULL FROM orders
UNION ALL SELECT 'pie', min(o_totalprice) >= 0 AND count(DISTINCT o_custkey) <= 12, CASE WHEN min(o_totalprice) < 0 THEN 'pie_incompatible_negative_values' WHEN count(DISTINCT o_custkey) > 12 THEN 'pie_incompatible_too_many_categories' END FROM orders
UNION ALL SELECT 'pie', false, 'pie_incompatible_aggregation_required' FROM orders HAVING count(*) > 0
UNION ALL SELECT 'scatter', count(*) >= 2, CASE WHEN count(*) < 2 THEN 'scatter_incompatible_insufficient_rows' END FROM orders
UNION ALL SELECT 'histogram', count(o_totalprice) > 0, NULL FROM orders
UNION ALL SELECT 'line', false, 'line_incompatible_invalid_x_role' FROM orders HAVING count(*) > 0""")
def checks(spark, sf):
    df = table(spark, sf, "orders")
    day, user = Field("o_orderdate", "time", "datetime"), Field("o_custkey", "category", "integer")
    status = Field("o_orderstatus", "category", "string")
    owner = Field("o_custkey", "category", "string")
    price, summed = Field("o_totalprice", "measure", "float"), Field("o_totalprice", "measure", "float", aggregation="sum")
    cases = [
        ("line", [day, price], {"x": "o_orderdate", "y": "o_totalprice"}), ("bar", [status, price], {"x": "o_orderstatus", "y": "o_totalprice"}),
        ("pie", [owner, summed], {"category": "o_custkey", "value": "o_totalprice"}), ("pie", [status, price], {"category": "o_orderstatus", "value": "o_totalprice"}),
        ("scatter", [price, user], {"x": "o_totalprice", "y": "o_custkey"}), ("histogram", [price], {}), ("line", [status, price], {"x": "o_orderstatus", "y": "o_totalprice"})]
    out = None
    for chart, fields, encoding in cases:
        one = C.check_chart(df, chart, fields, encoding)
        out = one if out is None else out.unionByName(one)
    return out


@query("r05_axes", """
SELECT count(*) AS "rows", 'line' AS chart, 'o_orderdate' AS x, 'o_totalprice' AS y FROM orders UNION ALL SELECT count(*), 'bar', 'o_orderstatus', 'o_totalprice' FROM orders
UNION ALL SELECT count(*), 'pie', 'o_orderstatus', 'o_totalprice' FROM orders UNION ALL SELECT count(*), 'scatter', 'o_orderstatus', 'o_totalprice' FROM orders""")
def axes(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    fields = [f if f.id != "o_orderkey" else Field(f.id, "identifier", "integer") for f in C.table_fields(df)]
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    chosen = [(c, list((C.choose_axes(fields, c) or {}).values())) for c in ("line", "bar", "pie", "scatter")]
    picks = F.array(*[F.struct(F.lit(c).alias("chart"), F.lit(a[0]).alias("x"), F.lit(a[1]).alias("y")) for c, a in chosen])
    return rows.select("rows", F.inline(picks))


@query("r06_payload_rows", """
SELECT event_id, CASE WHEN event_id % 10 > 2 THEN value END AS value, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts FROM events ORDER BY event_id LIMIT 1000""")
def payload(spark, sf):
    from tablewright.queries.cleaning import ODD

    df = table(spark, sf, "events").withColumn("value", F.expr(ODD)).select("event_id", "value", "ts")
    return C.payload_rows(df, ["event_id"])


@query("r07_slice_shares", "SELECT event_type, count(*) AS value, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percent FROM events GROUP BY 1")
def slice_shares(spark, sf):
    return C.shares(C.chart_data(table(spark, sf, "events"), "event_type"), "value")
