"""Running values over a total order, spread over the cluster.

A plain window without partitions runs on one task, and one with a hot key puts a third of the rows on
one task. Here rows are cut into balanced blocks by (keys, order); each block is scanned on its own and starts
from a carry value of the blocks before it. Only the first key of a block can have begun in an earlier block, so the
carry table has at most one row per block: it is small whatever the data size and may be broadcast.

A row's block follows from its own values and a list of cut points taken from a sample; only this list is written. The
input is read for its size, for the sample, for the carry and for the result. An input that gives other rows each time it is
read (random values, arrival order) must be made durable first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.operators.columns import money_rounded, require
from tablewright.session import durable

BLOCK = "_block"
PER_BLOCK = 32  # sampled rows for each block
ROWS_PER_BLOCK, MOST_BLOCKS = 4_000_000, 1 << 15
PORTION = 1024  # equal rows that stay together


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _place(cuts: Column, at: Column, n: int) -> Column:
    """How many of the sorted cuts are not above ``at``, by halving."""
    i, step = F.lit(0), 1 << max(0, n.bit_length() - 1)
    while step:
        def further(j: Column) -> Column:
            return j + F.when(F.get(cuts, j + (step - 1)) <= at, step).otherwise(0)  # noqa: B023  used at once

        i = _let(i, further)
        step //= 2
    return i


def _cuts(df: DataFrame, at: Column, n: int, rows: int) -> DataFrame:
    """One row, ``_cuts``: up to n - 1 sorted cut points with about the same number of rows between them; a value that many rows share stands there
    several times. They come from a random sample of about ``PER_BLOCK`` rows for each block, and are written, so that every reader cuts alike."""
    sample = df.select(at.alias("_at")).sample(min(1.0, n * PER_BLOCK / max(rows, 1)), seed=7)
    step = F.greatest(F.floor(F.size("_all") / n), F.lit(1)).cast("int")
    picked = F.transform(F.sequence(F.lit(1), F.lit(max(1, n - 1))), lambda i: F.get("_all", i * step))
    return durable(sample.agg(F.array_sort(F.collect_list("_at")).alias("_all")).select(F.filter(picked, lambda c: c.isNotNull()).alias("_cuts")))


def in_blocks(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Balanced, ordered blocks. ``order`` must be a total order within the keys; rows alike in it are in no order among themselves.

    The number of blocks follows the number of rows. A row's block follows from its own values, but rows of a value that fills more than a block are spread over all
    blocks between its cuts: they are counted by their whole content, and each portion of ``PORTION`` copies goes to a block by its hash.
    """
    rows = df.count()
    n = min(MOST_BLOCKS, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_BLOCK)))
    at = F.struct(*[F.col(c) for c in keys + order])
    cuts = _cuts(df, at, n, rows)

    def marked(of: DataFrame) -> DataFrame:
        # the optimiser folds _cuts into its one use, so the list is not copied into rows
        return of.withColumn("_at", at).withColumn("_cuts", cuts.select("_cuts").scalar())

    light = marked(df)
    block = _let(F.col("_cuts"), lambda c: _place(c, F.col("_at"), n))
    if not cuts.where(F.size("_cuts") > F.size(F.array_distinct("_cuts"))).count():
        return light.withColumn(BLOCK, block).drop("_at", "_cuts")
    repeated = cuts.select(F.filter(F.array_distinct("_cuts"), lambda c: F.size(F.filter("_cuts", lambda x: x == c)) > 1).alias("_heavy"))
    heavy = F.array_contains(repeated.scalar(), at)
    counted = df.where(heavy).groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    portions = counted.withColumn("_c", F.explode(F.sequence(F.lit(0), F.expr(f"cast((_n - 1) div {PORTION} as int)"))))
    spread = F.xxhash64("_c", *[c for c, t in df.dtypes if "map<" not in t])
    portions = portions.withColumn("_h", spread).repartition("_h").withColumn("_n", F.least(F.lit(PORTION), F.col("_n") - F.col("_c") * PORTION))
    copies = marked(portions.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))))
    same = F.size(F.filter("_cuts", lambda c: c == F.col("_at")))
    first = block - same
    copies = copies.withColumn(BLOCK, (first + F.pmod(F.col("_h"), (same + 1).cast("bigint"))).cast("int"))
    return light.where(~heavy).withColumn(BLOCK, block).drop("_at", "_cuts").unionByName(copies.select(*[F.col(f"`{c}`") for c in df.columns], BLOCK))


def _carry(blocks: DataFrame, keys: list[str], per_block: Column, over_blocks) -> DataFrame:
    """Carry-in per (block, key) for keys that began in an earlier block; one row per block at most."""
    by = [F.col(k) for k in keys] or [F.lit(0).alias("_all")]
    parts = blocks.groupBy(BLOCK, *by).agg(per_block.alias("_part"))
    names = keys or ["_all"]
    earlier = W.partitionBy(*names).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    carried = parts.select(BLOCK, *names, over_blocks(F.col("_part")).over(earlier).alias("_carry")).where("_carry IS NOT NULL")
    return carried.select(F.col(BLOCK).alias("_b"), *[F.col(k).alias(f"_k_{k}") for k in keys], "_carry")


def _scan(df: DataFrame, keys: list[str], order: list[str], out: str, per_block: Column, over_blocks, value) -> DataFrame:
    """Add ``out`` = value(window within the block, carry-in of the block)."""
    blocks = in_blocks(df, keys, order)
    carry = _carry(blocks, keys, per_block, over_blocks)
    same = F.col(BLOCK) == F.col("_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = blocks.join(F.broadcast(carry), same, "left")
    local = W.partitionBy(BLOCK, *keys).orderBy(*order)
    result = joined.withColumn("_out", value(local, F.col("_carry")))
    return result.select(*[c for c in df.columns if c != out], F.col("_out").alias(out))


def orderable(df: DataFrame, but: list[str]) -> list[str]:
    """The other columns that have an order; maps have none."""
    return [c for c, t in df.dtypes if c not in but and "map<" not in t]


def _ordering(df: DataFrame, keys: list[str], sort_by: list[str], tie: list[str] | None) -> list[str]:
    rest = tie if tie is not None else orderable(df, [*keys, *sort_by])
    require(df, keys + sort_by + rest)
    return sort_by + rest


def running_total(df: DataFrame, column: str, sort_by: list[str], partition_by: list[str] | None = None,
                  tie: list[str] | None = None, out: str | None = None) -> DataFrame:
    """Cumulative sum; a null row stays null. Ties are settled by ``tie`` or by all other columns."""
    out, keys = out or f"running_total_{column}", partition_by or []

    def value(local, carry: Column) -> Column:
        total = F.sum(column).over(local.rowsBetween(W.unboundedPreceding, 0)) + F.coalesce(carry, F.lit(0))
        return F.when(F.col(column).isNotNull(), money_rounded(total, out))

    return _scan(df, keys, _ordering(df, keys, sort_by, tie), out, F.sum(column), F.sum, value)


def running_max(df: DataFrame, column: str, sort_by: list[str], partition_by: list[str] | None = None,
                tie: list[str] | None = None, out: str = "running_max") -> DataFrame:
    """Largest value of the rows before this one, null at the start."""
    keys = partition_by or []

    def value(local, carry: Column) -> Column:
        return F.greatest(F.max(column).over(local.rowsBetween(W.unboundedPreceding, -1)), carry)

    return _scan(df, keys, _ordering(df, keys, sort_by, tie), out, F.max(column), F.max, value)


def number_rows(df: DataFrame, sort_by: list[str], partition_by: list[str] | None = None,
                tie: list[str] | None = None, out: str = "row_number") -> DataFrame:
    """1, 2, 3 … within the keys (or over the whole table), without a single-task window."""
    keys = partition_by or []

    def value(local, carry: Column) -> Column:
        return F.row_number().over(local).cast("bigint") + F.coalesce(carry, F.lit(0))

    return _scan(df, keys, _ordering(df, keys, sort_by, tie), out, F.count(F.lit(1)), F.sum, value)


def percentage_change(df: DataFrame, column: str, sort_by: list[str], partition_by: list[str] | None = None,
                      tie: list[str] | None = None, out: str | None = None) -> DataFrame:
    """Change against the row before, nulls first filled forward; a previous zero gives null."""
    out, keys = out or f"pct_change_{column}", partition_by or []
    order = _ordering(df, keys, sort_by, tie)
    last_filled = F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.struct(*order)))

    def value(local, carry: Column) -> Column:
        prev = F.coalesce(F.last(column, ignorenulls=True).over(local.rowsBetween(W.unboundedPreceding, -1)), carry)
        return F.try_divide(F.coalesce(F.col(column), prev) - prev, prev)

    return _scan(df, keys, order, out, last_filled, lambda c: F.last(c, ignorenulls=True), value)


def exact_median(df: DataFrame, column: str, out: str = "median") -> DataFrame:
    """One row: the interpolated median.

    Values are counted first, so repeated values collapse before the shuffle; then the middle ranks are
    looked up in the running count. No task ever holds all distinct values.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_total(durable(counts), "_n", ["_v"], tie=[], out="_upto")  # one row per distinct value, grouped once
    total = ranked.agg(F.sum("_n").alias("_t"))
    middle = ranked.withColumn("_t", total.scalar())
    low, high = F.floor((F.col("_t") + 1) / 2), F.floor((F.col("_t") + 2) / 2)
    return middle.agg(
        ((F.min(F.when(F.col("_upto") >= low, F.col("_v"))) + F.min(F.when(F.col("_upto") >= high, F.col("_v")))) / 2)
        .cast("double")
        .alias(out)
    )
