"""From a raw table to a written report: clean, filter, calculate, chart, write, always in this order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tablewright.operators import charts as R
from tablewright.operators.filters import Condition, filter_rows
from tablewright.plans.calculations import Calculated, calculate
from tablewright.plans.chain import Chain, run_chain
from tablewright.sources import sinks as W


@dataclass
class Request:
    cleaning: list[tuple[str, dict]] = field(default_factory=list)
    prepare: bool = False
    conditions: list[Condition] = field(default_factory=list)
    logic: str = "and"
    mode: str = "keep"
    select: list[str] | None = None
    limit: int = 0
    order: list[str] | None = None
    calculations: list[dict] = field(default_factory=list)
    charts: list[dict] = field(default_factory=list)


@dataclass
class Report:
    cleaned: Chain
    filtered: DataFrame
    calculated: Calculated
    charts: dict[str, DataFrame]


def build(df: DataFrame, request: Request) -> Report:
    """Everything stays lazy; only decisions that depend on the data look at it.

    ``prepare`` runs the safe conversions first when there is nothing else to clean.
    """
    steps = request.cleaning or ([("filter_prep", {})] if request.prepare and request.conditions else [])
    cleaned = run_chain(df, steps)
    filtered = filter_rows(cleaned.df, request.conditions, request.logic, request.mode, request.select, request.limit, request.order)
    calculated = calculate(filtered, request.calculations)
    charts = {c["title"]: R.chart_data(filtered, c["by"], c.get("aggregation", "count"), c.get("measure")) for c in request.charts}
    return Report(cleaned, filtered, calculated, charts)


def write(report: Report, path: str, kind: str = "csv", title: str = "Report") -> None:
    """Write the working table as csv, json, txt or as an audit bundle."""
    if kind == "csv":
        W.write_csv(report.calculated.df, path)
    elif kind == "json":
        W.write_json(report.calculated.df, path, title)
    elif kind == "txt":
        W.write_text(report.calculated.df, path, title)
    elif kind == "bundle":
        W.write_bundle(path, report.cleaned.df, report.filtered, audit_log=lambda: report.cleaned.audit(run=False))
    else:
        raise ValueError(f"unknown report kind {kind!r}")
