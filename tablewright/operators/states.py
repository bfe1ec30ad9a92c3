"""Column profiles from stored states.

A state is one row for each part of a table (a day, a load) and column: counts, range, length of text, and three sketches of fixed size for
distinct values, quantiles and frequent values. States merge, so a new or rewritten part is read alone, and the profile of the whole table
comes from as many rows as there are parts times columns.

Counts, ranges and lengths are exact. Distinct counts are off by about 1.04 / sqrt(2^``DISTINCT_BITS``) (1.6 % at 12), ranks of quantiles by about
1.3 % (``QUANTILE_SIZE`` 200). Counts of frequent values are exact up to ``FREQUENT`` different values of a column; beyond that a value that fills more than
about 1 / ``FREQUENT`` of the column is found.

Defined cases: rows without a part are a part of their own; a column without values has a state with zero counts; an empty table has no states;
nested columns have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.columns import is_numeric
from tablewright.operators.profile import _is_date, _plain

DISTINCT_BITS, QUANTILE_SIZE, FREQUENT = 12, 200, 1_000
QUANTILES = (0.25, 0.5, 0.75)
STAMP = "yyyy-MM-dd'T'HH:mm:ss"


def column_states(df: DataFrame, part: str) -> DataFrame:
    """One row for each value of ``part`` and column; one pass, copies and hot parts are folded before the shuffle."""
    kept = _plain(df.drop(part))
    flat = df.select(F.col(f"`{part}`").alias("part"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept.columns)])
    aggs, rows = [F.count(F.lit(1)).alias("_rows")], []
    for i, (name, dtype) in enumerate(kept.dtypes):
        col, text, number, date = F.col(f"c{i}"), dtype == "string", is_numeric(dtype), _is_date(dtype)
        fields = {
            "non_null": (F.count(col), "bigint", True),
            "text_length": (F.sum(F.length(col)), "bigint", text),
            "numeric_min": (F.min(col.cast("double")), "double", number),
            "numeric_max": (F.max(col.cast("double")), "double", number),
            "date_min": (F.min(col).cast("timestamp"), "timestamp", date),
            "date_max": (F.max(col).cast("timestamp"), "timestamp", date),
            "distinct": (F.hll_sketch_agg(col.cast("string"), DISTINCT_BITS), "binary", True),
            "quantiles": (F.kll_sketch_agg_double(col.cast("double"), QUANTILE_SIZE), "binary", number),
            "frequent": (F.expr(f"approx_top_k_accumulate(cast(c{i} AS string), {FREQUENT}) FILTER (WHERE c{i} IS NOT NULL)"), "", True),
        }
        aggs += [agg.alias(f"{field}{i}") for field, (agg, _, held) in fields.items() if held]
        cells = [(F.col(f"{field}{i}") if held else F.lit(None).cast(kind)).alias(field) for field, (_, kind, held) in fields.items()]
        rows.append(F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("column"), F.lit(dtype).alias("dtype"), F.col("_rows").alias("rows"), *cells))
    return flat.groupBy("part").agg(*aggs).select("part", F.inline(F.array(*rows)))


def refresh(df: DataFrame, part: str, path: str) -> None:
    """Stores the states of the parts in ``df``. A part that comes again replaces its state; other parts are neither read nor written."""
    column_states(df, part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged(states: DataFrame) -> DataFrame:
    """One state for each column of the whole table."""
    sums = [F.sum(c).alias(c) for c in ("rows", "non_null", "text_length")]
    ends = [F.min(c).alias(c) for c in ("numeric_min", "date_min")] + [F.max(c).alias(c) for c in ("numeric_max", "date_max")]
    sketches = [F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.expr("approx_top_k_combine(frequent)").alias("frequent")]
    return states.groupBy("ordinal", "column", "dtype").agg(*sums, *ends, *sketches)


def profile(states: DataFrame) -> DataFrame:
    """As ``column_profile`` has it, with an estimated distinct count, and the quantiles of number columns in ``quantiles``."""
    found = F.kll_sketch_get_n_double("quantiles") > 0
    return merged(states).select(
        "ordinal", "column", "dtype", (F.col("rows") - F.col("non_null")).alias("null_count"), F.col("non_null").alias("non_null_count"),
        F.hll_sketch_estimate("distinct").alias("distinct_count"), "numeric_min", "numeric_max",
        F.date_format("date_min", STAMP).alias("date_min"), F.date_format("date_max", STAMP).alias("date_max"),
        (F.col("text_length") / F.nullif("non_null", F.lit(0))).alias("average_text_length"),
        F.when(found, F.kll_sketch_get_quantile_double("quantiles", F.array(*[F.lit(q) for q in QUANTILES]))).alias("quantiles"))


def frequent_values(states: DataFrame, k: int = 5) -> DataFrame:
    """(column, rank, value, n): the ``k`` most frequent values of each column, by value among equals."""
    items = F.expr(f"approx_top_k_estimate(frequent, {FREQUENT})")  # ties at the end of a shorter list would hang on the sketch
    order = F.array_sort(F.transform(items, lambda x: F.struct((-x["count"]).alias("less"), x["item"].alias("value"))))
    best = merged(states).where("non_null > 0").select("column", F.posexplode(F.slice(order, 1, k)).alias("rank", "x"))
    return best.select("column", (F.col("rank") + 1).cast("bigint").alias("rank"), "x.value", (-F.col("x.less")).alias("n"))
