"""Row filters (F01-F21) and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import predicates as P
from tablewright.functions import text as X
from tablewright.operators.aggregate import grouped
from tablewright.operators.filters import Aggregate, Condition, filter_rows, search_rows
from tablewright.queries.base import query, table, view

WS = r"'^\s+|\s+$', '', 'g'"
WORDS = "trim(regexp_replace(lower(segment), '[^a-z0-9]+', ' ', 'g'))"
COMPACT = "regexp_replace(lower(segment), '[^a-z0-9]+', '', 'g')"


@query("e00_clean_filter_sum", f"""
SELECT lower(regexp_replace(s.segment, {WS})) AS segment, round(sum(cast(o.o_totalprice AS decimal(18,2))), 2)::double AS total_amount
FROM sheet s JOIN orders o ON o.o_custkey = s.id
WHERE {COMPACT.replace('segment', 's.segment')} IN ('building', 'machinery')
GROUP BY 1 ORDER BY 1""", uses=("sheet",))
def flagship(spark, sf):
    sheet = view(spark, sf, "sheet").select("id", "segment")
    clean = sheet.withColumn("segment", F.lower(X.strip_ws(F.col("segment"))))
    kept = filter_rows(clean, [Condition("segment", "in", ["Building", "machinery"])])
    orders = table(spark, sf, "orders").select("o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"))
    joined = orders.join(kept, orders.o_custkey == kept.id)
    return grouped(joined, "sum", ["segment"], "o_totalprice", "total_amount").withColumn(
        "total_amount", F.col("total_amount").cast("double")).orderBy("segment")


def sheet_filter(name, conditions, where, view_name="sheet", cols="id, segment", **kw):
    @query(name, f"SELECT {cols} FROM {view_name} WHERE {where}", uses=(view_name,) if view_name == "sheet" else ())
    def run(spark, sf):
        df = view(spark, sf, view_name) if view_name == "sheet" else table(spark, sf, view_name)
        return filter_rows(df, conditions, **kw).select(*[c.strip() for c in cols.split(",")])


C = Condition
sheet_filter("f01_eq", [C("segment", "eq", " building ")], "lower(trim(segment)) = 'building'")
sheet_filter("f02_neq", [C("segment", "neq", "building")], "segment IS NULL OR lower(trim(segment)) <> 'building'")
LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity"
sheet_filter("f03_gt", [C("l_quantity", ">", 40)], "l_quantity > 40", "lineitem", LINE)
sheet_filter("f04_gte", [C("l_quantity", "at_least", 40)], "l_quantity >= 40", "lineitem", LINE)
sheet_filter("f05_lt", [C("l_quantity", "below", 3)], "l_quantity < 3", "lineitem", LINE)
sheet_filter("f06_lte", [C("balance", "lte", 500)], "balance <= 500", cols="id, balance")
sheet_filter("f07_contains", [C("segment", "contains", "L-D")], "contains(lower(segment), 'l-d')")
sheet_filter("f08_not_contains", [C("segment", "not_contains", "build")], "NOT coalesce(contains(lower(segment), 'build'), false)")
sheet_filter("f09_starts_with", [C("balance_text", "starts_with", "$")], "starts_with(lower(balance_text), '$')", cols="id, balance_text")
sheet_filter("f10_ends_with", [C("balance_text", "ends_with", "usd")], "suffix(lower(balance_text), 'usd')", cols="id, balance_text")
sheet_filter("f11_between", [C("l_extendedprice", "between", 1000, 20000)], "l_extendedprice BETWEEN 1000 AND 20000", "lineitem",
             "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice")
IN = f"({WORDS} IN ('building', 'house hold') OR {COMPACT} IN ('building', 'household'))"
sheet_filter("f12_in", [C("segment", "in", ["Building", "house hold"])], IN)
sheet_filter("f13_not_in", [C("segment", "not_in", ["Building", "house hold"])], f"NOT coalesce({IN}, false)")
sheet_filter("f14_is_null", [C("segment", "missing")], "segment IS NULL")
sheet_filter("f15_is_not_null", [C("segment", "is_not_null")], "segment IS NOT NULL")
sheet_filter("f17_and", [C("segment", "contains", "m"), C("balance", "gt", 2000)],
             "contains(lower(segment), 'm') AND balance > 2000", cols="id, segment, balance")
sheet_filter("f17_or", [C("segment", "eq", "furniture"), C("balance", "lt", 0)],
             "lower(trim(segment)) = 'furniture' OR balance < 0", cols="id, segment, balance", logic="or")
sheet_filter("f18_drop_mode", [C("segment", "contains", "m"), C("balance", "gt", 2000)],
             "NOT coalesce(coalesce(contains(lower(segment), 'm'), false) AND coalesce(balance > 2000, false), false)",
             cols="id, segment, balance", mode="drop")


@query("f16_normalized_text", f"""
SELECT id, segment,
  coalesce(contains({WORDS}, 'mach') OR contains({COMPACT}, 'mach'), false) AS has_part,
  coalesce(starts_with({WORDS}, 'auto m') OR starts_with({COMPACT}, 'autom'), false) AS has_start,
  coalesce(suffix({WORDS}, 'ture') OR suffix({COMPACT}, 'ture'), false) AS has_end
FROM sheet""", uses=("sheet",))
def normalized_text(spark, sf):
    c = F.col("segment")
    return view(spark, sf, "sheet").select(
        "id", "segment", P.text_match(c, ["Mach"], "contains").alias("has_part"),
        P.text_match(c, ["Auto-M"], "starts_with").alias("has_start"), P.text_match(c, ["TURE"], "ends_with").alias("has_end"))


MONEY_SQL = "try_cast(trim(regexp_replace(balance_text, '[$€£¥,]', '', 'g')) AS double)"


@query("f19_above_average_of_group", f"""
SELECT id, balance_text FROM sheet
WHERE {MONEY_SQL} > (SELECT avg({MONEY_SQL}) FROM sheet WHERE lower(trim(gender)) = 'female')""", uses=("sheet",))
def above_group_average(spark, sf):
    limit = Aggregate("avg", "balance_text", "gender", "female")
    return filter_rows(view(spark, sf, "sheet"), [C("balance_text", "gt", limit)]).select("id", "balance_text")


@query("f19_below_median", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem
WHERE l_quantity < (SELECT median(l_quantity) FROM lineitem)""")
def below_median(spark, sf):
    df = table(spark, sf, "lineitem")
    return filter_rows(df, [C("l_quantity", "lt", Aggregate("median", "l_quantity"))],
                       select=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"])


_SPELLED = """CASE event_id % 9 WHEN 0 THEN 'At least' WHEN 1 THEN '<>' WHEN 2 THEN ' one_of ' WHEN 3 THEN 'Missing' WHEN 4 THEN 'between'
  WHEN 5 THEN 'more-than' WHEN 6 THEN 'below' WHEN 7 THEN 'IS' ELSE event_type END"""


@query("f20_operator_synonyms", f"""
SELECT CASE spelled WHEN 'at_least' THEN 'gte' WHEN '<>' THEN 'neq' WHEN 'one_of' THEN 'in' WHEN 'missing' THEN 'is_null'
  WHEN 'between' THEN 'between' WHEN 'more_than' THEN 'gt' WHEN 'below' THEN 'lt' WHEN 'is' THEN 'eq' END AS operator,
  count(*) AS n
FROM (SELECT regexp_replace(trim(lower({_SPELLED})), '[\\s\\-]+', '_', 'g') AS spelled FROM events)
GROUP BY 1""")
def operator_synonyms(spark, sf):
    rules = table(spark, sf, "events").select(F.expr(_SPELLED).alias("spelled"))
    return rules.groupBy(P.canonical_operator_column(F.col("spelled")).alias("operator")).agg(F.count(F.lit(1)).alias("n"))


@query("f21_row_search", """
SELECT p_partkey, p_name, p_brand FROM part
WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')""")
def row_search(spark, sf):
    return search_rows(table(spark, sf, "part"), "RING", ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_name", "p_brand")
