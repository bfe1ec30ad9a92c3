"""Delimited text whose cells may hold line ends, read in splits.

Lines are the unit that Spark reads in parallel. Whether a line begins inside a quoted cell hangs on all lines before it, but a line's effect is one of four
functions of that one bit: it keeps it, flips it, or ends outside or inside whatever it was. Functions are composed within a split by
windows, and over splits by their summaries (one row for each split), so that a file of any size is read by many tasks. Only lines of records that span several are brought together.

A quote counts at the start of a cell, and doubled inside a quoted one. A carriage return at the end of a record is not part of it.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.session import durable

LAYOUTS = 1000  # different header lines among the files of one table
INSIDE = '[^"]*+(?:""[^"]*+)*+'  # text of a quoted cell


def _ends_inside(line: Column, sep: str) -> Column:
    """Whether a line that begins outside a quoted cell ends inside one."""
    start = f"(^|{re.escape(sep)})"
    return F.regexp_replace(line, f'{start}"{INSIDE}"', "$1x").rlike(f'{start}"')


def _composed(df: DataFrame, along, until: int) -> Column:
    """(known, value, flips) of the rows from the start to ``until`` before the current one: if ``known`` the bit was set to ``value``
    by some row, else what it was before the first; ``flips`` came after that."""
    reach = along.rowsBetween(W.unboundedPreceding, -until)
    last = F.last("_set", ignorenulls=True).over(reach)
    flips = F.coalesce(F.sum("_flips").over(reach), F.lit(0))
    return F.struct(last.isNotNull().alias("known"), F.coalesce(last["v"], F.lit(0)).alias("value"), (flips - F.coalesce(last["s"], F.lit(0))).alias("flips"))


def _bit(of: Column, before: Column) -> Column:
    return (F.when(of["known"], of["value"]).otherwise(before) + of["flips"]) % 2


def records(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """file, at (order within the file) and record of every record that is not blank, headers included."""
    read = spark.read.option("lineSep", "\n").text(path)
    lines = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")
    closing = F.col("value").rlike(f'^{INSIDE}"')
    f0 = _ends_inside(F.col("value"), sep).cast("int")
    f1 = F.when(closing, _ends_inside(F.regexp_replace("value", f'^{INSIDE}"', "x"), sep).cast("int")).otherwise(1)
    along = W.partitionBy("file", "block").orderBy("seq")
    marked = lines.withColumns({"_f0": f0, "_f1": f1}).withColumn("_flips", ((F.col("_f0") == 1) & (F.col("_f1") == 0)).cast("int"))
    marked = marked.withColumn("_sum", F.sum("_flips").over(along.rowsBetween(W.unboundedPreceding, 0)))
    marked = marked.withColumn("_set", F.when(F.col("_f0") == F.col("_f1"), F.struct(F.col("_f0").alias("v"), F.col("_sum").alias("s"))))
    marked = marked.withColumns({"_before": _composed(marked, along, 1), "_after": _composed(marked, along, 0)})
    splits = marked.groupBy("file", "block").agg(F.max_by("_after", "seq").alias("_all"))
    over = W.partitionBy("file").orderBy("block")
    splits = splits.withColumn("_flips", F.col("_all.flips")).withColumn("_sum", F.sum("_flips").over(over.rowsBetween(W.unboundedPreceding, 0)))
    # a split that sets the bit has counted only the flips behind that
    splits = splits.withColumn("_set", F.when(F.col("_all.known"), F.struct(F.col("_all.value").alias("v"), (F.col("_sum") - F.col("_flips")).alias("s"))))
    carry = durable(splits.select("file", "block", _bit(_composed(splits, over, 1), F.lit(0)).alias("_carry")))
    placed = marked.join(carry, ["file", "block"]).select("file", "block", "seq", "value", (_bit(F.col("_before"), F.col("_carry")) == 0).alias("_opens"), (_bit(F.col("_after"), F.col("_carry")) == 0).alias("_ends"))
    placed = durable(placed)
    at = F.struct("block", "seq")
    whole = placed.where("_opens AND _ends").select("file", at.alias("at"), F.col("value").alias("record"))
    parts = placed.where("NOT (_opens AND _ends)")
    counts = parts.groupBy("file", "block").agg(F.sum(F.col("_opens").cast("bigint")).alias("_n"))
    earlier = counts.select("file", "block", F.coalesce(F.sum("_n").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    number = F.col("_earlier") + F.sum(F.col("_opens").cast("bigint")).over(along.rowsBetween(W.unboundedPreceding, 0))
    numbered = parts.join(earlier, ["file", "block"]).withColumn("_nr", number)
    joined = numbered.groupBy("file", "_nr").agg(F.min(at).alias("at"), F.array_sort(F.collect_list(F.struct("block", "seq", "value"))).alias("_l"))  # the lines of one record
    spanning = joined.select("file", "at", F.array_join(F.transform("_l", lambda x: x["value"]), "\n").alias("record"))
    return whole.unionByName(spanning).withColumn("record", F.regexp_replace("record", "\r$", "")).where(F.trim("record") != "")


def names_of(header: str, sep: str) -> list[str]:
    return next(csv.reader([header.removeprefix("﻿")], delimiter=sep))


def read_by_header(spark: SparkSession, path: str | list[str], columns: list[str], sep: str = ",") -> DataFrame:
    """``columns`` as text, taken by the names in each file's own header, in whatever order they stand there; other columns are left out.

    A file that lacks one of them is an error, and so is a name that stands twice."""
    rows = records(spark, path, sep)
    first = durable(rows.groupBy("file").agg(F.min("at").alias("_at"), F.min_by("record", "at").alias("header")))
    layouts = [r[0] for r in first.select("header").distinct().limit(LAYOUTS + 1).collect()]
    if len(layouts) > LAYOUTS:
        raise ValueError(f"more than {LAYOUTS} different headers under {path}")
    named = [names_of(h, sep) for h in layouts]
    for names in named:
        wrong = [c for c in columns if names.count(c) != 1]
        if wrong:
            raise ValueError(f"columns {wrong} are not in the header {names} exactly once")
    cells = rows.join(first, "file").where(F.col("at") > F.col("_at"))
    width = max(map(len, named), default=1)
    schema = ", ".join(f"_{i} string" for i in range(width))
    parsed = cells.select("header", F.from_csv("record", schema, {"sep": sep, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}).alias("_r"))
    if not named:
        return parsed.select(*[F.lit(None).cast("string").alias(c) for c in columns])

    def cell(c: str) -> Column:
        value = F.lit(None).cast("string")
        for header, names in zip(layouts, named):
            value = F.when(F.col("header") == header, F.col(f"_r._{names.index(c)}")).otherwise(value)
        return value.alias(c)

    return parsed.select(*[cell(c) for c in columns])
