"""Scalar, grouped, quarterly, cross-tab and conditional calculations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.convert import to_timestamp
from tablewright.functions.predicates import equals
from tablewright.operators.columns import is_numeric, money_rounded, require, types
from tablewright.operators.ordered import exact_median


@dataclass(frozen=True)
class Metric:
    kind: str
    column: str
    out: str | None = None

    @property
    def name(self) -> str:
        return self.out or f"{self.kind}_{self.column}"


SCALARS = {
    "sum": lambda c: F.coalesce(F.sum(c).cast("double"), F.lit(0.0)),
    "mean": lambda c: F.avg(c),
    "min": lambda c: F.min(c).cast("double"),
    "max": lambda c: F.max(c).cast("double"),
    "count": lambda c: F.count(c),
    "count_distinct": lambda c: F.count_distinct(c),
    "variance": lambda c: F.var_samp(c),
    "standard_deviation": lambda c: F.stddev_samp(c),
}
ANY_TYPE = ("count", "count_distinct")


def _need_numeric(df: DataFrame, column: str) -> None:
    require(df, [column])
    if not is_numeric(types(df)[column]):
        raise TypeError(f"column {column} must be numeric")


def metrics(df: DataFrame, wanted: list[Metric]) -> DataFrame:
    """All scalar metrics as one row from one scan; medians add one ordered lookup each."""
    plain = [m for m in wanted if m.kind != "median"]
    for m in wanted:
        if m.kind not in ANY_TYPE:
            _need_numeric(df, m.column)
    cols = [
        SCALARS[m.kind](F.col(m.column)) if m.kind in ANY_TYPE else money_rounded(SCALARS[m.kind](F.col(m.column)), m.name)
        for m in plain
    ]
    row = df.agg(*[c.alias(m.name) for m, c in zip(plain, cols)]) if plain else df.sparkSession.range(1).select()
    for m in wanted:
        if m.kind == "median":
            row = row.withColumn(m.name, money_rounded(exact_median(df, m.column).scalar(), m.name))
    return row.select(*[m.name for m in wanted])


def grouped(df: DataFrame, kind: str, keys: list[str], column: str | None = None, out: str | None = None) -> DataFrame:
    """sum, mean or count by keys; rows with a null key are left out."""
    require(df, keys)
    if kind != "count":
        _need_numeric(df, column)
    out = out or (f"count_{column}" if kind == "count" else f"{kind}_{column}")
    value = {
        "sum": lambda: money_rounded(F.coalesce(F.sum(column), F.lit(0)), out),
        "mean": lambda: money_rounded(F.avg(column), out),
        "count": lambda: F.count(F.lit(1)),
    }[kind]()
    return df.dropna(subset=keys).groupBy(*keys).agg(value.alias(out))


def cross_tab(df: DataFrame, kind: str, keys: list[str], column: str | None = None, out: str | None = None) -> DataFrame:
    if len(keys) < 2:
        raise ValueError("a cross-tab needs at least two keys")
    return grouped(df, kind, keys, column, out)


def quarter_label(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))


def quarterly(df: DataFrame, kind: str, date_column: str, column: str | None = None, out: str | None = None) -> DataFrame:
    """By calendar quarter, in order; rows without a usable date are left out."""
    require(df, [date_column])
    ts = to_timestamp(F.col(date_column)) if types(df)[date_column] == "string" else F.col(date_column)
    out = out or f"quarterly_{kind}_{column or date_column}"
    start = F.date_trunc("quarter", ts.cast("timestamp_ntz")).cast("date")
    result = grouped(df.withColumn("_start", start), kind, ["_start"], column, out)
    return result.select(
        quarter_label(F.col("_start")).alias("quarter"), out, F.date_format("_start", "yyyy-MM-dd").alias("period_start")
    ).orderBy("quarter")


def conditional_percentage(df: DataFrame, column: str, value: str, base_column: str | None = None,
                           base_value: str | None = None, out: str | None = None) -> DataFrame:
    """Share of matching rows among base rows × 100 with both counts; an empty base is an error."""
    require(df, [column] + ([base_column] if base_column else []))
    out = (out or f"pct_{column}_{value}").replace(" ", "_").lower()
    hit = equals(F.col(column).cast("string"), str(value))
    base = equals(F.col(base_column).cast("string"), str(base_value)) if base_column else F.lit(True)
    counted = df.agg(F.count_if(base & hit).alias("n"), F.count_if(base).alias("d"))
    checked = F.when(F.col("d") == 0, F.raise_error(F.lit("no rows in the base of the percentage")).cast("bigint")).otherwise(F.col("d"))
    return counted.select(
        F.bround(F.col("n") / checked * 100, 2).alias(out),
        F.col("n").alias(f"{out}_numerator"),
        F.col("d").alias(f"{out}_denominator"),
    )


def entity_columns(df: DataFrame, exclude: list[str]) -> list[str]:
    """String columns with more than one distinct value and fewer than half as many as rows."""
    names = [c for c, t in df.dtypes if t == "string" and c not in exclude]
    if not names:
        return []
    seen = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_distinct(c).alias(c) for c in names]).first()
    return [c for c in names if 1 < seen[c] < seen["_rows"] * 0.5]
