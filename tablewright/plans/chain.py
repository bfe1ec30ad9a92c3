"""Chains of named operations with an audit row each.

A chain is plain ``DataFrame.transform`` calls, so the whole chain stays one lazy plan. Row counts are
observed while the data flows; they cost no extra pass.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tablewright.functions import convert as V
from tablewright.functions import text as X
from tablewright.operators import aggregate as A
from tablewright.operators import clean as K
from tablewright.operators import columns as C
from tablewright.operators import ordered as R
from tablewright.operators.columns import require
from tablewright.operators.filters import filter_rows
from tablewright.operators.rows import sort_rows


def _cols(columns=None, column=None) -> list[str]:
    return list(columns or ([column] if column else []))


def _each(fn):
    """A Column function on named columns."""
    return lambda df, columns=None, column=None: K.on_columns(df, fn, _cols(columns, column))


# name -> function(df, **parameters); add your own DataFrame -> DataFrame function with ``register``
OPERATIONS: dict[str, Callable[..., DataFrame]] = {
    "trim_whitespace": lambda df, columns=None: K.on_strings(df, X.strip_ws, columns),
    "normalize_column_names": lambda df, style="snake_case": C.normalize_names(df, style),
    "drop_duplicates": K.drop_duplicates,
    "fill_nulls": lambda df, columns, strategy, value=None: K.fill_nulls(df, columns, strategy, value),
    "drop_nulls": lambda df, columns=None, how="any": K.drop_nulls(df, columns, how),
    "normalize_date": lambda df, columns=None, column=None, target_format="%Y-%m-%d", dayfirst=False, errors="coerce":
        K.on_columns(df, lambda c: V.normalize_date(c, target_format, dayfirst, errors), _cols(columns, column)),
    "normalize_currency": _each(V.currency_number),
    "normalize_number": _each(V.plain_number),
    "normalize_text_case": lambda df, case, columns=None: K.on_strings(df, lambda c: X.change_case(c, case), columns),
    "replace_values": lambda df, column, mapping: K.on_columns(df, lambda c: X.replace_values(c, mapping), [column]),
    "strip_currency_symbols": _each(X.strip_currency),
    "remove_commas_from_numbers": _each(X.remove_commas),
    "coerce_column_type": lambda df, target_type, columns=None, column=None, errors="coerce":
        K.on_columns(df, lambda c: V.coerce_type(c, target_type, errors), _cols(columns, column)),
    "remove_empty_rows": K.drop_empty_rows,
    "remove_empty_columns": C.drop_empty_columns,
    "rename_columns": lambda df, mapping: C.rename_columns(df, mapping),
    "reorder_columns": lambda df, columns: C.reorder_columns(df, columns),
    "absolute_value": lambda df, columns=None, output_column=None: C.absolute(df, columns, output_column),
    "normalize_categorical_values": lambda df, columns=None: K.normalize_categories(df, columns),
    "normalize_empty_strings": lambda df, columns=None: K.blanks_to_null(df, columns),
    "safe_numeric_conversion": lambda df, columns=None: K.safe_convert(df, "numeric", columns),
    "safe_currency_conversion": lambda df, columns=None: K.safe_convert(df, "currency", columns),
    "safe_date_detection": lambda df, columns=None: K.safe_convert(df, "date", columns),
    "categorical_value_normalization": lambda df, columns=None: K.lower_strings(df, columns),
    "filter_prep": K.prepare_for_filter,
    "filter_rows": filter_rows,
    "project_columns": lambda df, columns: C.keep_columns(df, columns),
    "drop_columns": lambda df, columns: C.drop_columns(df, columns),
    "sort_rows": sort_rows,
    "limit_rows": lambda df, n, order: df.orderBy(*order).limit(n) if n else df,
    "difference": C.difference,
    "ratio": C.ratio,
    "running_total": R.running_total,
    "percentage_change": R.percentage_change,
    "group_sum": lambda df, group_by, column, output_column=None: A.grouped(df, "sum", group_by, column, output_column),
    "group_mean": lambda df, group_by, column, output_column=None: A.grouped(df, "mean", group_by, column, output_column),
    "group_count": lambda df, group_by, output_column="count": A.grouped(df, "count", group_by, None, output_column),
    "quarterly_sum": lambda df, date_column, column, output_column=None: A.quarterly(df, "sum", date_column, column, output_column),
    "quarterly_mean": lambda df, date_column, column, output_column=None: A.quarterly(df, "mean", date_column, column, output_column),
    "quarterly_count": lambda df, date_column, output_column=None: A.quarterly(df, "count", date_column, None, output_column),
    "cross_tab_sum": lambda df, group_by, column, output_column=None: A.cross_tab(df, "sum", group_by, column, output_column),
    "cross_tab_mean": lambda df, group_by, column, output_column=None: A.cross_tab(df, "mean", group_by, column, output_column),
    "cross_tab_count": lambda df, group_by, output_column="count": A.cross_tab(df, "count", group_by, None, output_column),
}

# Only these may run before a filter without changing the meaning of the data.
SAFE_BEFORE_FILTER = frozenset({
    "trim_whitespace", "normalize_column_names", "normalize_empty_strings", "safe_numeric_conversion",
    "safe_currency_conversion", "safe_date_detection", "categorical_value_normalization",
})
# Operations that leave absent columns out instead of failing.
LENIENT = frozenset({"drop_duplicates", "fill_nulls", "reorder_columns", "drop_columns"})


def register(name: str, fn: Callable[..., DataFrame]) -> None:
    if name in OPERATIONS:
        raise ValueError(f"{name} is taken")
    OPERATIONS[name] = fn


def parameter_hash(params: dict) -> str:
    return hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()


@dataclass
class Chain:
    """Result of a chain: the lazy table and, after an action, its audit table."""

    df: DataFrame
    entries: list[dict] = field(default_factory=list)
    counts: list[Observation] = field(default_factory=list)
    origin: str = "user_requested"

    def audit(self, run: bool = True) -> DataFrame:
        """One row per operation. ``run`` executes the chain once without keeping its result; leave it out after the
        table has been written anyway, because the counts were taken on the way."""
        if run:
            self.df.write.format("noop").mode("overwrite").save()
        rows = [o.get["rows"] for o in self.counts]
        entries = [
            {**e, "rows_in": rows[i], "rows_out": rows[i + 1], "step_kind": self.origin} for i, e in enumerate(self.entries)]
        schema = ("step int, operation string, rows_in bigint, rows_out bigint, columns_changed string, "
                  "params_hash string, step_kind string, duration_ms bigint")
        names = [c.split()[0] for c in schema.split(", ")]
        return self.df.sparkSession.createDataFrame([tuple(e[n] for n in names) for e in entries], schema)


def _observed(df: DataFrame, counts: list[Observation]) -> DataFrame:
    seen = Observation()
    counts.append(seen)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"))


def run_chain(df: DataFrame, steps: list[tuple[str, dict]], preparing: bool = False) -> Chain:
    """Apply the steps in order; names and columns are checked before any job starts."""
    result = Chain(df, origin="internal_preparation" if preparing else "user_requested")
    result.df = _observed(df, result.counts)
    for no, (name, params) in enumerate(steps):
        if name not in OPERATIONS:
            raise ValueError(f"unknown operation {name!r}")
        if preparing and name not in SAFE_BEFORE_FILTER:
            raise ValueError(f"{name} is not safe before a filter; allowed: {sorted(SAFE_BEFORE_FILTER)}")
        if name not in LENIENT:
            require(result.df, _cols(params.get("columns"), params.get("column")))
        started = time.time()
        before = dict(result.df.dtypes)
        after_df = OPERATIONS[name](result.df, **params)
        after = dict(after_df.dtypes)
        changed = sorted({c for c in {*before, *after} if before.get(c) != after.get(c)} | set(_cols(params.get("columns"), params.get("column"))))
        result.df = _observed(after_df, result.counts)
        result.entries.append({
            "step": no, "operation": name, "columns_changed": ",".join(changed), "params_hash": parameter_hash(params),
            "duration_ms": int((time.time() - started) * 1000)})
    return result


def default_cleaning(df: DataFrame) -> DataFrame:
    """When nothing is named: trim, snake-case names, drop exact duplicates."""
    return run_chain(df, [("trim_whitespace", {}), ("normalize_column_names", {}), ("drop_duplicates", {})]).df
