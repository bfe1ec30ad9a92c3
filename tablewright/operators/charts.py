"""Chart-ready aggregates, data shape, chart choice, compatibility checks, result payloads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.aggregate import grouped
from tablewright.operators.columns import is_numeric, types, unit_of
from tablewright.sources.sinks import safe_columns

PAYLOAD_ROWS = 1000
PIE_CATEGORIES = 12

# Chart picked for each data shape.
SHAPE_CHARTS = {"time_series": "line", "categorical_series": "bar", "histogram_bins": "histogram", "scatter_points": "scatter"}


@dataclass(frozen=True)
class Field:
    id: str
    role: str
    data_type: str
    unit: str | None = None
    aggregation: str | None = None

    @property
    def numeric(self) -> bool:
        return self.data_type in ("integer", "float", "number")


def chart_data(df: DataFrame, by: str, aggregation: str = "count", measure: str | None = None, out: str = "value") -> DataFrame:
    """count, sum or mean of a measure by one column."""
    kind = aggregation if aggregation in ("sum", "mean") and measure else "count"
    return grouped(df, kind, [by], measure, out)


def data_shape(roles: Column, numeric_measures: Column) -> Column:
    """Shape of a result from its field roles (array) and its number of numeric measures."""
    def has(role):
        return F.array_contains(roles, role)

    return (
        F.when(has("time"), "time_series").when(has("category") & has("measure"), "categorical_series")
        .when(has("dimension") & (numeric_measures > 0), "histogram_bins")
        .when((numeric_measures == 2) & ~has("category"), "scatter_points").otherwise("scalar"))


def chart_for(shape: Column, requested: Column) -> Column:
    """The requested chart, or for ``auto`` / blank the one that fits the shape (never a pie)."""
    pairs = [F.lit(x) for kv in SHAPE_CHARTS.items() for x in kv]
    auto = F.coalesce(F.try_element_at(F.create_map(*pairs), shape), F.lit("bar"))
    wanted = F.coalesce(F.nullif(requested, F.lit("")), F.lit("auto"))
    return F.when(wanted == "auto", auto).otherwise(wanted)


def check_chart(df: DataFrame, chart: str, fields: list[Field], encoding: dict[str, str]) -> DataFrame:
    """(chart, valid, reason): field checks from metadata, data checks in one aggregation."""
    by_id = {f.id: f for f in fields}
    used = [by_id[i] for i in encoding.values() if i in by_id]
    groups = [f for f in used if f.role in ("category", "dimension")]
    numbers = [f for f in used if f.numeric]
    all_set = {f.id: F.col(f.id).isNotNull() for f in fields}

    def rows_with(ids):
        test = F.lit(True)
        for i in ids:
            test = test & all_set[i]
        return F.count_if(test)

    problem: str | None = None
    data: list[tuple[Column, str]] = []
    if chart == "line":
        x = by_id.get(encoding.get("x", ""))
        if x is None:
            problem = "missing_x_axis"
        elif x.role not in ("time", "dimension"):
            problem = "invalid_x_role"
        else:
            data = [(F.count_distinct(x.id) < 2, "insufficient_x_values")]
    elif chart == "bar":
        problem = "missing_category" if not groups else "missing_numeric" if not numbers else None
        data = [] if problem else [(rows_with([f.id for f in groups + numbers]) < 1, "insufficient_rows")]
    elif chart == "pie":
        problem = "category_count" if len(groups) != 1 else "numeric_count" if len(numbers) != 1 else None
        if not problem and not numbers[0].aggregation:
            problem = "aggregation_required"
        data = [] if problem else [
            (F.coalesce(F.min(numbers[0].id) < 0, F.lit(False)), "negative_values"), (F.count_distinct(groups[0].id) > PIE_CATEGORIES, "too_many_categories")]
    elif chart == "scatter":
        problem = "insufficient_numeric_fields" if len(numbers) < 2 else None
        data = [] if problem else [(rows_with([f.id for f in numbers[:2]]) < 2, "insufficient_rows")]
    elif chart == "histogram":
        measures = [f for f in fields if f.role == "measure" and f.numeric]
        problem = "missing_measure" if not measures else None
        data = [] if problem else [(sum((F.count(f.id) for f in measures), F.lit(0)) < 1, "insufficient_rows")]
    else:
        raise ValueError(f"unknown chart {chart!r}")
    reason = F.lit(f"{chart}_incompatible_{problem}" if problem else None).cast("string")
    for test, code in reversed(data):
        reason = F.when(test, F.lit(f"{chart}_incompatible_{code}")).otherwise(reason)
    checked = df.agg(reason.alias("reason")) if data else df.agg(F.count(F.lit(1)).alias("_n")).select(reason.alias("reason"))
    return checked.select(F.lit(chart).alias("chart"), F.col("reason").isNull().alias("valid"), "reason")


def choose_axes(fields: list[Field], chart: str) -> dict[str, str] | None:
    """First fitting field per axis; identifiers are never measures."""
    groups = [f.id for f in fields if f.role in ("category", "dimension")]
    measures = [f.id for f in fields if f.role == "measure"]
    times = [f.id for f in fields if f.role == "time"]
    if chart == "pie" and groups and measures:
        return {"category": groups[0], "value": measures[0]}
    if chart == "scatter" and len(measures) >= 2:
        return {"x": measures[0], "y": measures[1]}
    xs = (times + groups) if chart == "line" else (groups + times)
    if chart not in ("pie", "scatter") and xs and measures:
        return {"x": xs[0], "y": measures[0]}
    texts = [f.id for f in fields if f.data_type == "string"]
    numbers = [f.id for f in fields if f.numeric and f.role != "identifier"]
    return {"x": texts[0], "y": numbers[0]} if texts and numbers else None


def table_fields(df: DataFrame) -> list[Field]:
    """Fields of a plain table: numbers measure, times time, the rest dimension."""
    out = []
    for c, t in types(df).items():
        number, time = is_numeric(t), t.startswith(("timestamp", "date"))
        out.append(Field(c, "measure" if number else "time" if time else "dimension", "number" if number else "datetime" if time else "string", unit_of(c)))
    return out


def series_fields(keys: list[str], measure: str, aggregation: str) -> list[Field]:
    return [Field(k, "category", "string") for k in keys] + [Field(measure, "measure", "number", unit_of(measure), aggregation)]


def payload_rows(df: DataFrame, order: list[str], kind: str = "table", most: int | None = PAYLOAD_ROWS) -> DataFrame:
    """JSON-safe rows of a result; a table payload holds its first ``most`` rows (None: all), a scalar or a series all of them."""
    rows = df.orderBy(*order).limit(most) if kind == "table" and most is not None else df
    fields = {f.id: f for f in table_fields(df)}
    safe = safe_columns(rows)
    return safe.select(*[F.col(c).alias(c, metadata={k: v for k, v in (("role", fields[c].role), ("unit", fields[c].unit)) if v}) for c in safe.columns])


def shares(df: DataFrame, value: str, out: str = "percent") -> DataFrame:
    """Each slice as percent of the total with one decimal; the total is one scalar."""
    total = df.agg(F.sum(value).alias("t")).scalar()
    return df.withColumn(out, F.round(F.try_divide(F.col(value), total) * 100, 1))
