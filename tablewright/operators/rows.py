"""Sorting, paging, first / latest row per key, leaders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.functions.convert import to_number


def sort_rows(df: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Keys with asc / desc; nulls always last."""
    return df.orderBy(*[
        F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last() for c, d in keys])


def natural_key(c: Column) -> list[Column]:
    """Numbers sort as numbers and before text; text sorts case-blind."""
    number = to_number(c.cast("string"))
    return [number.isNull().cast("int"), number, F.lower(c.cast("string"))]


def page(df: DataFrame, column: str, number: int, size: int, descending: bool = False, tie: list[str] | None = None) -> DataFrame:
    """One page of the table sorted by any column."""
    order = [k.desc() if descending else k.asc() for k in natural_key(F.col(column))]
    return df.orderBy(*order, *[F.asc(t) for t in (tie or [])]).offset(number * size).limit(size)


def custom_order(c: Column, ranks: list[str]) -> Column:
    """Position in a fixed list, anything else last."""
    out = F.lit(len(ranks))
    for i, value in reversed(list(enumerate(ranks))):
        out = F.when(c == value, F.lit(i)).otherwise(out)
    return out


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """First n rows per key. The rank filter also runs before the shuffle, so a hot key sends n rows per task."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    out = df.withColumn("_rn", rn).where(F.col("_rn") <= n)
    return out.withColumnRenamed("_rn", rank) if rank else out.drop("_rn")


def top_values(df: DataFrame, column: str, k: int, rare: bool = False) -> DataFrame:
    """Most frequent (or rarest) k values; ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.asc("n") if rare else F.desc("n"), F.asc(column)).limit(k)


def leaders(df: DataFrame, request: str, candidate: list[str], score: str, limit: float) -> DataFrame:
    """Best and second candidate per request, their margin, and whether the margin is too small to decide."""
    top = first_per_key(df, [request], [F.desc(score), *[F.asc(c) for c in candidate]], n=2, rank="_rn")
    name = F.concat_ws(":", *[F.col(c).cast("string") for c in candidate])
    both = top.groupBy(request).agg(
        F.max(F.when(F.col("_rn") == 1, name)).alias("leader"),
        F.max(F.when(F.col("_rn") == 1, F.col(score))).alias("leader_score"),
        F.max(F.when(F.col("_rn") == 2, name)).alias("runner_up"),
        F.max(F.when(F.col("_rn") == 2, F.col(score))).alias("runner_up_score"),
    )
    margin = F.round(F.col("leader_score") - F.coalesce(F.col("runner_up_score"), F.lit(0.0)), 6)
    return both.withColumn("margin", margin).withColumn(
        "ambiguous", F.col("runner_up").isNotNull() & (F.col("margin") <= limit))


def latest_rows(df: DataFrame, order: list[str], n: int | None = 100) -> DataFrame:
    """The n newest rows by ``order``, newest first; None gives all."""
    sorted_rows = df.orderBy(*[F.desc(c) for c in order])
    return sorted_rows if n is None else sorted_rows.limit(n)


def count_per_key(df: DataFrame, key: str, out: str = "n", top: int | None = None) -> DataFrame:
    """Rows per key; with ``top`` the largest of them, ties by key."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias(out))
    return counts if top is None else counts.orderBy(F.desc(out), key).limit(top)
