"""Row-level cleaning: missing values, duplicates, categories, safe conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.functions import convert as V
from tablewright.functions import text as X
from tablewright.operators.columns import is_numeric, normalize_names, require, string_columns, types
from tablewright.operators.ordered import exact_median, orderable

SAFE_SHARE = 0.80
CATEGORY_LIMIT = 50

# Short forms of common categories.
CATEGORY_SYNONYMS = {"m": "Male", "male": "Male", "males": "Male", "f": "Female", "female": "Female",
                     "females": "Female", "o": "Other", "other": "Other", "others": "Other"}


def on_strings(df: DataFrame, fn, cols: list[str] | None = None) -> DataFrame:
    """Apply a Column function to string columns."""
    return df.withColumns({c: fn(F.col(c)) for c in string_columns(df, cols)})


def on_columns(df: DataFrame, fn, cols: list[str]) -> DataFrame:
    require(df, cols)
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def fill_nulls(df: DataFrame, cols: list[str], strategy: str, value=None) -> DataFrame:
    """zero / empty_string / constant are one projection; mean, median and mode look at the data once before."""
    cols = [c for c in cols if c in df.columns]
    if strategy == "zero":
        kinds = {c: types(df)[c] for c in cols}
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(t)) for c, t in kinds.items() if is_numeric(t) or t == "string"})
    if strategy == "empty_string":
        return df.fillna("", subset=cols)
    if strategy == "constant":
        return df.withColumns({c: _filled(F.col(c), types(df)[c], value) for c in cols})
    if strategy in ("mean", "median"):
        cols = [c for c in cols if is_numeric(types(df)[c])]
    if not cols:
        return df
    if strategy == "mean":
        fills = df.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
    elif strategy == "median":
        fills = {c: exact_median(df, c).first()[0] for c in cols}
    elif strategy == "mode":
        fills = {c: most_frequent(df, c) for c in cols}
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items() if v is not None})


def _filled(c, dtype: str, value):
    """A constant that does not fit the column's type turns the column into text."""
    fits = value is None or isinstance(value, str) == (dtype == "string")
    return F.coalesce(c, F.lit(value)) if fits else F.coalesce(c.cast("string"), F.lit(str(value)))


def most_frequent(df: DataFrame, column: str):
    """Most frequent value, the smallest among ties; one row reaches the driver."""
    top = (
        df.where(F.col(column).isNotNull()).groupBy(column).count()
        .orderBy(F.desc("count"), F.asc(column)).limit(1).collect()
    )
    return top[0][0] if top else None


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.dropna(how="all")


def blanks_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return on_strings(df, lambda c: F.when(X.strip_ws(c) != "", c), cols)


def drop_nulls(df: DataFrame, cols: list[str] | None = None, how: str = "any") -> DataFrame:
    """Blank text counts as missing and becomes null."""
    named = [c for c in (cols or df.columns) if c in df.columns]
    return blanks_to_null(df, named).dropna(how=how, subset=named)


def drop_duplicates(df: DataFrame, subset: list[str] | None = None, keep: str | bool = "first",
                    order: list[str] | None = None) -> DataFrame:
    """``keep`` is first, last or False (no member of a duplicate group stays). Nulls are equal.

    first / last: the rank filter is applied before the shuffle as well, so a hot group sends one row per
    map task. False: counted with map-side combine.
    """
    cols = [c for c in (subset or df.columns) if c in df.columns]
    if keep is False:
        rest = [c for c in df.columns if c not in cols]
        once = (
            df.groupBy(*cols)
            .agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*(rest or [F.lit(0).alias("_x")]))).alias("_row"))
            .where(F.col("_n") == 1)
        )
        return once.select(*[F.col(c) if c in cols else F.col(f"_row.{c}").alias(c) for c in df.columns])
    if len(cols) == len(df.columns):
        return df.dropDuplicates()
    if not order:
        raise ValueError("first and last need an order: rows of a distributed table have none")
    rest = orderable(df, [*cols, *order])
    direction = F.asc if keep == "first" else F.desc
    rank = F.row_number().over(W.partitionBy(*cols).orderBy(*[direction(c) for c in order + rest]))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def duplicate_count(df: DataFrame, out: str = "duplicate_rows") -> DataFrame:
    """Rows beyond the first of each group of equal rows."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias(out)
    )


def union_tables(*tables: DataFrame) -> DataFrame:
    """By name, missing columns null; unnamed columns and empty rows go."""
    named = [t.select(*[c for c in t.columns if c.strip() and not c.lower().startswith("unnamed")]) for t in tables]
    out = named[0]
    for t in named[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return drop_empty_rows(out)


def ordered_distinct(df: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values in order of first appearance."""
    return df.groupBy(column).agg(F.min(order).alias("first_seen")).orderBy("first_seen", column)


def normalize_categories(df: DataFrame, cols: list[str] | None = None, limit: int = CATEGORY_LIMIT) -> DataFrame:
    """Title case and short forms, only for columns of at most ``limit`` distinct values.

    The gate is exact at bounded cost: of each column's distinct values one more than the limit is counted.
    """
    names = string_columns(df, cols)
    if not names:
        return df

    def few(c: str) -> bool:
        return df.select(X.strip_ws(F.col(c)).alias("v")).where("v IS NOT NULL").distinct().limit(limit + 1).count() <= limit

    chosen = [c for c in names if few(c)]
    pairs = [F.lit(x) for kv in CATEGORY_SYNONYMS.items() for x in kv]

    def canonical(c):
        plain = X.strip_ws(c)
        return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(plain)), F.initcap(plain))

    return df.withColumns({c: canonical(F.col(c)) for c in chosen})


# -- safe conversions: convert a column only when at least 80 % of its values parse; rows never drop ----------

def _parse_shares(df: DataFrame, tests: dict[str, object]) -> dict[str, float]:
    """Share of non-null values that pass, all columns in one scan; one row reaches the driver."""
    if not tests:
        return {}
    aggs = [F.try_divide(F.count_if(t), F.count(F.col(c))).alias(c) for c, t in tests.items()]
    return {c: s for c, s in df.agg(*aggs).first().asDict().items() if s is not None}


def safe_convert(df: DataFrame, kind: str, cols: list[str] | None = None) -> DataFrame:
    names = string_columns(df, cols)
    test, convert = {
        "numeric": (V.is_number, V.to_number),
        "currency": (V.looks_like_money, V.money_number),
        "date": (lambda c: V.to_timestamp(c).isNotNull(), V.to_timestamp),
    }[kind]
    shares = _parse_shares(df, {c: test(F.col(c)) for c in names})
    return df.withColumns({c: convert(F.col(c)) for c, s in shares.items() if s >= SAFE_SHARE})


def lower_strings(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return on_strings(df, lambda c: F.lower(X.strip_ws(c)), cols)


def prepare_for_filter(df: DataFrame) -> DataFrame:
    """The non-destructive chain in one fixed order, with two scans for all decisions.

    Names, trim, blanks, then conversions. The three parse shares of every string column are read in one
    pass over the trimmed text: currency wins over number and number over date, which gives the same result
    as one pass per kind because each kind only sees columns that are still text.
    """
    tidy = normalize_names(df).transform(on_strings, X.strip_ws).transform(blanks_to_null)
    names = string_columns(tidy)
    if not names:
        return tidy
    tests = {
        "currency": V.looks_like_money,
        "numeric": V.is_number,
        "date": lambda c: V.to_timestamp(c).isNotNull(),
    }
    aggs = [
        F.try_divide(F.count_if(t(F.col(c))), F.count(F.col(c))).alias(f"{k}|{c}") for c in names for k, t in tests.items()
    ]
    share = tidy.agg(*aggs).first().asDict()
    convert = {"currency": V.money_number, "numeric": V.to_number, "date": V.to_timestamp}
    done = {}
    for c in names:
        kind = next((k for k in tests if (share[f"{k}|{c}"] or 0) >= SAFE_SHARE), None)
        done[c] = convert[kind](F.col(c)) if kind else F.lower(F.col(c))
    return tidy.withColumns(done)
