"""Scalar, grouped, quarterly and cross-tab calculations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import aggregate as A
from tablewright.queries.base import query, table, view


def scalar(name, kind, sql, column="l_extendedprice", source="lineitem", digits=2, uses=()):
    """One metric; doubles are rounded on both sides because sums depend on the order of addition."""

    @query(name, f"SELECT {sql} AS value FROM {source}", uses=uses)
    def run(spark, sf):
        df = view(spark, sf, source) if uses else table(spark, sf, source)
        row = A.metrics(df, [A.Metric(kind, column, "value")])
        return row if digits is None else row.select(F.round("value", digits).alias("value"))


scalar("a01_sum", "sum", "round(sum(cast(l_extendedprice AS decimal(18,2)))::double, 2)")
scalar("a02_mean", "mean", "round(round_even(avg(l_extendedprice), 2), 2)")
scalar("a03_median", "median", "round(round_even(median(l_extendedprice), 2), 2)")
scalar("a04_min", "min", "min(balance)", "balance", "sheet", uses=("sheet",))
scalar("a05_max", "max", "max(l_extendedprice)")
scalar("a06_count", "count", "count(segment)", "segment", "sheet", None, uses=("sheet",))
scalar("a07_count_distinct", "count_distinct", "count(DISTINCT l_partkey)", "l_partkey", digits=None)
scalar("a08_variance", "variance", "round(var_samp(l_quantity), 2)", "l_quantity")
scalar("a09_standard_deviation", "standard_deviation", "round(stddev_samp(l_quantity), 2)", "l_quantity")


@query("a01_sum_of_nothing", "SELECT coalesce(sum(l_quantity), 0.0) AS total FROM lineitem WHERE l_quantity < 0")
def sum_of_nothing(spark, sf):
    return A.metrics(table(spark, sf, "lineitem").where("l_quantity < 0"), [A.Metric("sum", "l_quantity", "total")])


@query("a09_all_metrics", """
SELECT round(sum(cast(o_totalprice AS decimal(18,2)))::double, 2) AS sum_x, round(avg(o_totalprice), 4) AS mean_x,
  round(median(o_totalprice), 4) AS median_x, min(o_totalprice) AS min_x, max(o_totalprice) AS max_x,
  count(o_totalprice) AS count_x, count(DISTINCT o_custkey) AS customers
FROM orders""")
def all_metrics(spark, sf):
    m = [("sum", "sum_x"), ("mean", "mean_x"), ("median", "median_x"), ("min", "min_x"), ("max", "max_x")]
    df = table(spark, sf, "orders")
    wanted = [A.Metric(k, "o_totalprice", o) for k, o in m] + [A.Metric("count", "o_totalprice", "count_x"), A.Metric("count_distinct", "o_custkey", "customers")]
    row = A.metrics(df, wanted)
    return row.select(*[F.round(c, 4).alias(c) if c.endswith("_x") and c != "count_x" else F.col(c) for c in row.columns])


@query("a10_group_sum", """
SELECT segment, round(sum(cast(balance AS decimal(18,2)))::double, 2) AS total_balance FROM sheet
WHERE segment IS NOT NULL GROUP BY 1""", uses=("sheet",))
def group_sum(spark, sf):
    out = A.grouped(view(spark, sf, "sheet"), "sum", ["segment"], "balance", "total_balance")
    return out.withColumn("total_balance", F.round("total_balance", 2))


@query("a11_group_mean", """
SELECT l_returnflag, l_linestatus, round(round_even(avg(l_extendedprice), 2), 2) AS mean_price FROM lineitem GROUP BY 1, 2""")
def group_mean(spark, sf):
    out = A.grouped(table(spark, sf, "lineitem"), "mean", ["l_returnflag", "l_linestatus"], "l_extendedprice", "mean_price")
    return out.withColumn("mean_price", F.round("mean_price", 2))


@query("a12_group_count", "SELECT segment, count(*) AS n FROM sheet WHERE segment IS NOT NULL GROUP BY 1", uses=("sheet",))
def group_count(spark, sf):
    return A.grouped(view(spark, sf, "sheet"), "count", ["segment"], out="n")


@query("a13_conditional_percentage", """
SELECT round_even(count(*) FILTER (lower(trim(gender)) = 'female' AND lower(trim(active_text)) = 'yes') * 100.0
    / count(*) FILTER (lower(trim(gender)) = 'female'), 2)::double AS pct_active_text_yes,
  count(*) FILTER (lower(trim(gender)) = 'female' AND lower(trim(active_text)) = 'yes') AS pct_active_text_yes_numerator,
  count(*) FILTER (lower(trim(gender)) = 'female') AS pct_active_text_yes_denominator
FROM sheet""", uses=("sheet",))
def conditional_percentage(spark, sf):
    return A.conditional_percentage(view(spark, sf, "sheet"), "active_text", "yes", "gender", "female")


Q_LABEL = "concat(cast(year(o_orderdate) AS string), 'Q', cast(quarter(o_orderdate) AS string))"
Q_START = "strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d')"


def quarterly(name, kind, value):
    @query(name, f"SELECT {Q_LABEL} AS quarter, {value} AS revenue, {Q_START} AS period_start FROM orders GROUP BY 1, 3")
    def run(spark, sf):
        out = A.quarterly(table(spark, sf, "orders"), kind, "o_orderdate", None if kind == "count" else "o_totalprice", "revenue")
        return out if kind == "count" else out.withColumn("revenue", F.round("revenue", 2))


quarterly("a14_quarterly_sum", "sum", "round(sum(cast(o_totalprice AS decimal(18,2)))::double, 2)")
quarterly("a15_quarterly_mean", "mean", "round(round_even(avg(o_totalprice), 2), 2)")
quarterly("a16_quarterly_count", "count", "count(*)")


def cross(name, kind, value):
    @query(name, f"SELECT o_orderpriority, o_orderstatus, {value} AS value FROM orders GROUP BY 1, 2")
    def run(spark, sf):
        out = A.cross_tab(table(spark, sf, "orders"), kind, ["o_orderpriority", "o_orderstatus"], None if kind == "count" else "o_totalprice", "value")
        return out if kind == "count" else out.withColumn("value", F.round("value", 2))


cross("a17_cross_tab_sum", "sum", "round(sum(cast(o_totalprice AS decimal(18,2)))::double, 2)")
cross("a18_cross_tab_mean", "mean", "round(round_even(avg(o_totalprice), 2), 2)")
cross("a18_cross_tab_count", "count", "count(*)")
