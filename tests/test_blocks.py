"""Blocks of the ordered operators under values that very many rows share."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import ordered as O


def skewed(spark, n):
    """A third of the rows alike in every column, another tenth alike in the order column only."""
    df = spark.range(n).select((F.col("id") % 3).alias("r"), "id")
    k = F.when(F.col("r") == 0, 500).when(F.col("id") % 10 == 1, 700).otherwise(F.col("id") % 1000)
    return df.select(k.alias("k"), F.when(F.col("r") == 0, 1).otherwise(F.col("id")).alias("v"))


def test_equal_rows_are_spread(spark):
    df = spark.range(200_000).select(F.lit(7).alias("k"), F.lit(1).alias("v"))
    blocks = {r[0]: r[1] for r in O.in_blocks(df, [], ["k", "v"]).groupBy(O.BLOCK).count().collect()}
    mean = 200_000 / len(blocks)
    assert sum(blocks.values()) == 200_000 and len(blocks) >= 4 and max(blocks.values()) <= 2 * mean
    assert O.number_rows(df, ["k", "v"], out="n").agg(F.min("n"), F.max("n"), F.count_distinct("n")).first() == (1, 200_000, 200_000)


def test_no_block_is_large(spark):
    df = skewed(spark, 120_000)
    blocks = O.in_blocks(df, [], ["k", "v"])
    sizes = [r[1] for r in blocks.groupBy(O.BLOCK).count().collect()]
    assert sum(sizes) == 120_000 and max(sizes) <= 2 * 120_000 / 4
    # blocks are in order: what comes before never sorts after what comes behind
    ends = sorted((r[0], r[1], r[2]) for r in blocks.groupBy(O.BLOCK).agg(F.min(F.struct("k", "v")), F.max(F.struct("k", "v"))).collect())
    assert all(a[2] <= b[1] for a, b in zip(ends, ends[1:]))


def test_running_values_with_equal_rows(spark):
    df = skewed(spark, 30_000)
    rows = sorted((r.k, r.v) for r in df.collect())
    want, total = [], 0
    for k, v in rows:
        total += v
        want.append((k, v, total))
    got = sorted(tuple(r) for r in O.running_total(df, "v", ["k"], out="t").collect())
    assert got == want


@pytest.mark.parametrize("rows", [0, 1])
def test_hardly_any_rows(spark, rows):
    df = spark.range(rows).select(F.col("id").alias("k"), F.lit(2).alias("v"))
    assert O.running_total(df, "v", ["k"]).count() == rows


def test_map_columns_ride_along(spark):
    df = spark.range(40_000).select(F.lit(1).alias("k"), F.create_map(F.lit("a"), F.col("id") % 2).alias("m"))
    out = O.number_rows(df, ["k"], out="n")
    assert out.agg(F.max("n"), F.count_distinct("n"), F.sum(F.col("m")["a"])).first() == (40_000, 40_000, 20_000)
