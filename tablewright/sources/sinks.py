"""Writing results. Every sink writes a folder of part files in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.convert import json_safe


def safe_columns(df: DataFrame) -> DataFrame:
    """NaN and infinities as null, timestamps as ISO text."""
    return df.select(*[json_safe(F.col(c), t).alias(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    """Quotes are doubled and white space is kept, so that any reader gets back what was written (line ends in cells: ``read_delimited(multiline=True)``)."""
    as_is = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    safe_columns(df).write.mode("overwrite").options(header=True, **as_is).csv(path)


def write_json(df: DataFrame, path: str, title: str = "Report") -> None:
    """``data`` as JSON lines beside a one-row ``metadata``."""
    safe_columns(df).write.mode("overwrite").json(f"{path}/data")
    meta = df.sparkSession.range(1).select(F.lit(title).alias("title"))
    meta.write.mode("overwrite").json(f"{path}/metadata")


def text_layout(df: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Cells as text and the width of each column, found in one pass."""
    shown = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("NaN")).alias(c) for c in df.columns])
    widest = shown.agg(*[F.max(F.length(c)).alias(c) for c in df.columns]).first()
    return shown, {c: max(widest[c] or 0, len(c)) for c in df.columns}


def write_text(df: DataFrame, path: str, title: str | None = None) -> None:
    """``data`` as aligned text lines beside a ``head`` file with title and column names."""
    shown, width = text_layout(df)
    shown.select(F.concat_ws(" ", *[F.lpad(c, width[c], " ") for c in df.columns]).alias("value")).write.mode("overwrite").text(f"{path}/data")
    head = [title, "=" * len(title), ""] if title else []
    head.append(" ".join(c.rjust(width[c]) for c in df.columns))
    lines = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(line) for line in head])).alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(f"{path}/head")


AUDIT_SCHEMAS = {
    "audit_log": "step_kind string, operation string, rows_in bigint, rows_out bigint",
    "warnings": "warning string",
    "column_mapping": "requested_field string, matched_column string, confidence double, reason string",
}


def write_bundle(path: str, cleaned: DataFrame, filtered: DataFrame | None = None, **parts: DataFrame) -> list[str]:
    """One folder per part; parts without rows or not given still carry their schema.

    A part may be a function that gives the table: it is called when the data parts are already written.
    """
    spark = cleaned.sparkSession
    tables = {"cleaned_data": cleaned}
    if filtered is not None:
        tables["filtered_data"] = filtered
    for name, schema in AUDIT_SCHEMAS.items():
        tables[name] = parts.get(name) if parts.get(name) is not None else spark.createDataFrame([], schema)
    for name, df in tables.items():
        (df() if callable(df) else df).write.mode("overwrite").parquet(f"{path}/{name}")
    return list(tables)


def replace_records(records: DataFrame, path: str, key: str, buckets: int = 256) -> None:
    """Replace all records of the keys in this batch and leave the others alone.

    ``buckets`` is a property of the table: choose it at its first write so that one bucket is cheap to rewrite, and
    give the same number with every later batch.

    Keys are grouped into buckets; a touched bucket is rewritten from its other keys and the new records, and
    swapped in by dynamic partition overwrite after the rewrite has been made durable.
    """
    from tablewright.session import durable

    spark = records.sparkSession
    fresh = durable(records.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))))
    reader = spark.read.schema(fresh.schema)
    try:
        old = reader.parquet(path)
    except Exception as e:  # noqa: BLE001  first write: nothing to keep
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    if old is not None:
        touched = fresh.select("bucket").distinct()
        kept = old.join(touched, "bucket", "left_semi").join(fresh.select(key).distinct(), key, "left_anti")
        fresh = durable(fresh.unionByName(kept))
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
