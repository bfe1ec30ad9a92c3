"""Filter plans: conditions joined by and / or, keep or drop, compare with an aggregate, search."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import predicates as P
from tablewright.functions.convert import to_number
from tablewright.operators.columns import is_numeric, require, types
from tablewright.operators.ordered import exact_median


@dataclass(frozen=True)
class Aggregate:
    """A value computed from the table itself, optionally over the rows where ``where_column`` equals a text."""

    func: str
    column: str
    where_column: str | None = None
    where_value: str | None = None


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str
    value: Any = None
    value_to: Any = None
    case_sensitive: bool = False


def money_text_number(c: Column) -> Column:
    return to_number(F.regexp_replace(c, "[$€£¥,]", ""))


def as_number(df: DataFrame, column: str) -> Column:
    return F.col(column) if is_numeric(types(df)[column]) else money_text_number(F.col(column))


def aggregate_value(df: DataFrame, agg: Aggregate) -> DataFrame:
    """One-row table with the aggregate."""
    rows = df
    if agg.where_column:
        rows = df.where(P.equals(F.col(agg.where_column).cast("string"), agg.where_value))
    number = rows.select(as_number(df, agg.column).alias("_v"))
    if agg.func == "median":
        return exact_median(number, "_v", "_a")
    fn = {"avg": F.avg, "mean": F.avg, "average": F.avg, "sum": F.sum, "min": F.min, "max": F.max,
          "count": F.count, "std": F.stddev_samp}[agg.func]
    return number.agg(fn("_v").alias("_a"))


def condition_column(df: DataFrame, cond: Condition) -> Column:
    require(df, [cond.column])
    if isinstance(cond.value, Aggregate):
        # a scalar subquery: one value, no join
        limit = aggregate_value(df, cond.value).scalar()
        return P.predicate(as_number(df, cond.column), "double", cond.operator, limit)
    return P.predicate(F.col(cond.column), types(df)[cond.column], cond.operator, cond.value, cond.value_to,
                       cond.case_sensitive)


def filter_rows(df: DataFrame, conditions: list[Condition], logic: str = "and", mode: str = "keep",
                select: list[str] | None = None, limit: int = 0, order: list[str] | None = None) -> DataFrame:
    """Keep or drop the rows that meet the combined condition. ``limit=0`` means no limit.

    Drop mode negates the whole condition, so keep and drop split the table in two.
    """
    if select:
        require(df, select)
    test = P.combine([condition_column(df, c) for c in conditions], logic)
    out = df.where(~F.coalesce(test, F.lit(False)) if mode == "drop" else test) if conditions else df
    if limit:
        if not order:
            raise ValueError("limit needs an order: rows of a distributed table have none")
        out = out.orderBy(*order).limit(limit)
    return out.select(*select) if select else out


def alerts_like(df: DataFrame, column: str, part: str, value: str, least: float) -> DataFrame:
    """Rows whose text holds a part, case ignored, and whose value is at least a limit."""
    literal = part.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return df.where(F.col(column).ilike(f"%{literal}%") & (F.col(value) >= least))


def search_rows(df: DataFrame, query: str, cols: list[str] | None = None) -> DataFrame:
    """Rows where any column contains the text, case ignored."""
    wanted = query.lower()
    hits = [F.contains(F.lower(F.col(c).cast("string")), F.lit(wanted)) for c in (cols or df.columns)]
    return df.where(P.combine([F.coalesce(h, F.lit(False)) for h in hits], "or"))
