"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"

# most rows of a side that is sent to every executor; above it the same join is shuffled
BROADCAST_ROWS = 2_000_000


def words(text: Column) -> Column:
    """Array of the runs of characters other than space and U+0009 to U+000D; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, also where the body names it inside another lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """While a job runs that is started inside, Python workers get at most ``rows`` texts at a time; the setting comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fold(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it was counted and has at most ``limit`` rows; else unchanged, for a shuffled join.

    Only for narrow rows (keys and numbers), so that the limit on rows bounds the bytes too.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def dense(df: DataFrame, size: int, default: float = 0.0) -> DataFrame:
    """One row, one column ``_dense``: an array of ``size`` doubles with ``_value`` at index ``_at`` of ``df``.

    ``size`` is a parameter of the model, not of the data. Built in blocks of 1024, so no task sorts the whole array.
    """
    every = df.sparkSession.range(0, size, 1, 8).withColumnRenamed("id", "_at")
    cell = F.struct("_at", F.coalesce(F.col("_value"), F.lit(default)).alias("v"))
    block = every.join(df.select(F.col("_at").cast("bigint").alias("_at"), F.col("_value").cast("double").alias("_value")), "_at", "left")
    block = block.groupBy(F.expr("_at div 1024").alias("_block")).agg(F.sort_array(F.collect_list(cell)).alias("_cells"))
    block = block.select("_block", F.transform("_cells", lambda c: c["v"]).alias("_cells"))
    whole = F.sort_array(F.collect_list(F.struct("_block", "_cells")))
    return block.agg(F.flatten(F.transform(whole, lambda b: b["_cells"])).alias("_dense"))


def best_cut(bins: list[tuple[int, int, int]]) -> int | None:
    """Bin b so that "score in bin b or above" parts positives from negatives best (balanced accuracy).

    ``bins`` are (bin, positives, negatives); ties go to the lowest bin, which keeps more. None without both classes.
    """
    pos, neg = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not pos or not neg:
        return None
    best, at, above_pos, above_neg = -1.0, None, 0, 0
    for b, p, n in sorted(bins, reverse=True):
        above_pos, above_neg = above_pos + p, above_neg + n
        value = above_pos / pos + 1 - above_neg / neg
        if value >= best:
            best, at = value, b
    return at
