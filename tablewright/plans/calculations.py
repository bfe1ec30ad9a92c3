"""A list of calculations over one working table.

A calculation that yields a table replaces the working table, so later ones see the aggregated rows; scalar
ones leave it alone and become columns of a one-row metrics table. Neighbouring scalars share one scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators import aggregate as A
from tablewright.operators import charts as R
from tablewright.operators import columns as C
from tablewright.operators import ordered as O

SCALAR = (*A.SCALARS, "median")
TABLES = {
    "group_sum": lambda df, p: A.grouped(df, "sum", p["group_by"], p["column"], p.get("output_column")),
    "group_mean": lambda df, p: A.grouped(df, "mean", p["group_by"], p["column"], p.get("output_column")),
    "group_count": lambda df, p: A.grouped(df, "count", p["group_by"], p.get("column"), p.get("output_column")),
    "cross_tab_sum": lambda df, p: A.cross_tab(df, "sum", p["group_by"], p["column"], p.get("output_column")),
    "cross_tab_mean": lambda df, p: A.cross_tab(df, "mean", p["group_by"], p["column"], p.get("output_column")),
    "cross_tab_count": lambda df, p: A.cross_tab(df, "count", p["group_by"], p.get("column"), p.get("output_column")),
    "quarterly_sum": lambda df, p: A.quarterly(df, "sum", p["date_column"], p["column"], p.get("output_column")),
    "quarterly_mean": lambda df, p: A.quarterly(df, "mean", p["date_column"], p["column"], p.get("output_column")),
    "quarterly_count": lambda df, p: A.quarterly(df, "count", p["date_column"], p.get("column"), p.get("output_column")),
    "running_total": lambda df, p: O.running_total(df, p["column"], p["sort_by"], p.get("partition_by"), p.get("tie"), p.get("output_column")),
    "percentage_change": lambda df, p: O.percentage_change(df, p["column"], p["sort_by"], p.get("partition_by"), p.get("tie"), p.get("output_column")),
    "difference": lambda df, p: C.difference(df, p["column"], p["secondary_column"], p.get("output_column")),
    "ratio": lambda df, p: C.ratio(df, p["column"], p["secondary_column"], p.get("output_column")),
    "absolute_value": lambda df, p: C.absolute(df, [p["column"]] if p.get("column") else None, p.get("output_column")),
}


@dataclass
class Calculated:
    df: DataFrame
    metrics: list[DataFrame] = field(default_factory=list)
    fields: list[list[R.Field]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def metric_values(self) -> dict:
        """Every scalar by name; one row per metrics table reaches the driver."""
        return {k: v for m in self.metrics for k, v in m.first().asDict().items()}


def _warn(df: DataFrame, op: dict) -> list[str]:
    if op["type"] in ("running_total", "percentage_change") and not op.get("partition_by"):
        names = A.entity_columns(df, [op["column"], *op["sort_by"]])
        return [f"{op['type']} has no partition_by but these columns look like entities: {names}"] if names else []
    if op["type"] == "ratio":
        zeros = df.agg(C.zero_denominators(op["secondary_column"])).first()[0]
        return [f"ratio met {zeros} rows with zero in {op['secondary_column']}; they became null"] if zeros else []
    return []


def calculate(df: DataFrame, operations: list[dict], check: bool = True) -> Calculated:
    """Run the operations in order. ``check`` adds the warnings, each of which costs one counting pass."""
    out = Calculated(df)
    pending: list[A.Metric] = []

    def flush():
        if pending:
            out.metrics.append(A.metrics(out.df, list(pending)))
            pending.clear()

    for op in operations:
        kind = op["type"]
        if kind in SCALAR:
            metric = A.Metric(kind, op["column"], op.get("output_column"))
            pending.append(metric)
            out.fields.append([R.Field(metric.name, "measure", "number", C.unit_of(metric.name), kind)])
        elif kind == "conditional_percentage":
            flush()
            out.metrics.append(A.conditional_percentage(out.df, op["filter_column"], op["filter_value"], op.get("denominator_filter_column"),
                                                        op.get("denominator_filter_value"), op.get("output_column")))
            out.fields.append([R.Field(c, "measure", "number", "percent" if i == 0 else None, kind) for i, c in enumerate(out.metrics[-1].columns)])
        elif kind in TABLES:
            flush()
            out.warnings += _warn(out.df, op) if check else []
            out.df = TABLES[kind](out.df, op)
            series = kind.startswith("group_")
            out.fields.append(R.series_fields(op["group_by"], out.df.columns[-1], kind.removeprefix("group_")) if series else R.table_fields(out.df))
        else:
            raise ValueError(f"unknown calculation {kind!r}")
    flush()
    return out


def metrics_table(result: Calculated) -> DataFrame | None:
    """All metrics as rows (name, value)."""
    tables = [
        m.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in m.columns]))) for m in result.metrics]
    out = None
    for t in tables:
        out = t if out is None else out.unionByName(t)
    return out
