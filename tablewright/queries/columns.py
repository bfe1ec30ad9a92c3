"""Column operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import columns as K
from tablewright.queries.base import query, table, view




@query("p01_keep_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def keep(spark, sf):
    return K.keep_columns(table(spark, sf, "orders"), ["o_orderkey", "o_totalprice"])


@query("p02_drop_columns", "SELECT p_partkey, p_name, p_brand FROM part")
def drop(spark, sf):
    return K.drop_columns(table(spark, sf, "part"), ["p_type", "p_size", "p_retailprice"])


@query("p03_rename_columns", "SELECT c_custkey AS customer_id, c_name AS customer_name, c_acctbal FROM customer")
def rename(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return K.rename_columns(df, {"c_custkey": "customer_id", "c_name": "customer_name", "absent": "x"})


@query("p04_reorder_columns", "SELECT s_name, s_suppkey, s_nationkey, s_acctbal FROM supplier")
def reorder(spark, sf):
    return K.reorder_columns(table(spark, sf, "supplier"), ["s_name"])


@query("p05_normalize_names", "SELECT p_partkey AS \"partKey\", p_name AS \"partName\", p_retailprice AS \"retailPrice\" FROM part")
def names(spark, sf):
    df = table(spark, sf, "part").select(
        F.col("p_partkey").alias(" Part Key"), F.col("p_name").alias("PartName"), F.col("p_retailprice").alias("retail--Price"))
    return K.normalize_names(df, "camel_case")


@query("p06_alias_names", "SELECT voucher_date, entry_no, debit_amount, credit_amount, account_code FROM ledger", uses=("ledger",))
def aliases(spark, sf):
    df = view(spark, sf, "ledger").select(
        F.col("voucher_date").alias("Date"), F.col("entry_no").alias("Entry No"), F.col("debit_amount").alias("Debit"),
        F.col("credit_amount").alias("credit amount"), F.col("account_code").alias("Account Code"))
    return K.alias_names(df)


@query("p07_drop_empty_columns", "SELECT id, segment, balance FROM sheet", uses=("sheet",))
def empty_columns(spark, sf):
    return K.drop_empty_columns(view(spark, sf, "sheet").select("id", "segment", "balance", "notes"))


@query("p08_drop_private", "SELECT segment, balance_text FROM sheet WHERE segment IS NOT NULL OR balance_text IS NOT NULL", uses=("sheet",))
def private(spark, sf):
    df = view(spark, sf, "sheet").select("segment", "balance_text", F.col("id").alias("_source"), F.col("gender").alias("_confidence"))
    return K.drop_private(df)


@query("p09_difference", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice - l_quantity, 2) AS diff_amount FROM lineitem""")
def difference(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return K.difference(df, "l_extendedprice", "l_quantity", "diff_amount").drop("l_extendedprice", "l_quantity")


@query("p10_ratio", "SELECT id, CASE WHEN visits <> 0 THEN nation / visits END AS ratio_nation_visits FROM sheet", uses=("sheet",))
def ratio(spark, sf):
    return K.ratio(view(spark, sf, "sheet").select("id", "nation", "visits"), "nation", "visits").select("id", "ratio_nation_visits")


@query("p10_zero_denominators", "SELECT count(*) FILTER (visits = 0) AS zero_denominators FROM sheet", uses=("sheet",))
def zero_denominators(spark, sf):
    return view(spark, sf, "sheet").agg(K.zero_denominators("visits"))


@query("p11_absolute", "SELECT abs(id) AS id, abs(balance) AS balance, gender FROM sheet", uses=("sheet",))
def absolute(spark, sf):
    return K.absolute(view(spark, sf, "sheet").select("id", "balance", "gender"))


@query("p12_money_rounding", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  round_even(sqrt(l_extendedprice), 2) AS root_amount, sqrt(l_extendedprice) AS root FROM lineitem""")
def money_rounding(spark, sf):
    root = F.sqrt("l_extendedprice")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        K.money_rounded(root, "root_amount").alias("root_amount"), K.money_rounded(root, "root").alias("root"))


@query("p13_units", """
SELECT 'total_amount' AS field, 'INR' AS unit, round(sum(cast(o_totalprice AS decimal(18,2)))::double, 2) AS value FROM orders UNION ALL SELECT 'orders', NULL, count(*) FROM orders""")
def units(spark, sf):
    df = table(spark, sf, "orders").agg(F.sum("o_totalprice").alias("total_amount"), F.count(F.lit(1)).alias("orders"))
    tagged = K.with_field_metadata(df, {c: {"unit": K.unit_of(c)} for c in df.columns if K.unit_of(c)})
    units_of = {f.name: f.metadata.get("unit") for f in tagged.schema.fields}
    return tagged.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("field"), F.lit(u).cast("string").alias("unit"), F.round(F.col(c).cast("double"), 2).alias("value"))
        for c, u in units_of.items()])))


@query("p14_visible_columns", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def visible(spark, sf):
    return K.visible_columns(table(spark, sf, "orders"), {"o_custkey", "o_orderdate", "o_orderpriority"})
