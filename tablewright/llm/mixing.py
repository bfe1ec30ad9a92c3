"""Mixing sources to target weights by entropy balancing.

Each source gets a target number of words. Document rates stay as near to 1 as the targets allow (least relative entropy,
rates at most ``MOST``), which makes them exponentially tilted: rate = min(MOST, exp(lambda * size / mean size)) with one
lambda for each source, the solution of a convex dual problem. Newton steps, kept inside a bracket, solve it: every step
is an aggregation of the counted (source, size) pairs, and the multipliers stay a table.

Rates become whole copies: the whole part is certain, and one copy more goes to documents in the order of (a hash uniform
minus the fraction) until the source's words are as near to its target as one document allows. The cut in that order is found
on a histogram first, then exactly inside one of its ``BUCKETS`` buckets. The place of a row is a hash of its columns (without maps).
Rows alike in all of them share a place; where the cut falls among them they are counted and k of the n get the copy.

Defined cases: null text has size 0; null source is a source of its own, last in order; repeated rows are documents of their own, and
where the mix takes some of them, which ones shows in no column; sources without words have target 0, and their documents are taken
once; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.llm.common import BROADCAST_ROWS, NOT_SPACE, if_small
from tablewright.session import durable

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BUCKETS = 4096
ROUNDS, STEPS, NEAR = 30, 3, 1e-7  # a round is a written table
BLOCK = 4096  # rows alike that one task deals with at a time


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(NOT_SPACE)), F.lit(0)).cast("bigint")


def _row_hash(docs: DataFrame) -> Column:
    """64 bits of all columns that can be hashed: maps cannot."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and row_hash, which tells rows with one doc_id apart."""
    return docs.select("doc_id", "source", _size().alias("size"), _row_hash(docs).alias("row_hash"))


def targets(of: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, docs, source_size, target: one row for each source.

    A target is the smaller of ``most`` times the size and a common level times the weight; the level that spends the whole share
    is the first that its own source does not cap, in order of size over weight. The windows run over one row per source.
    """
    total = of.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), place % len(weights))
    cap = total.withColumn("_w", weight).withColumn("_cap", most * F.col("source_size"))
    order = W.orderBy(F.col("_cap") / F.col("_w"), F.asc_nulls_last("source"))
    every = W.partitionBy(F.lit(0))
    below = F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(order.rowsBetween(0, W.unboundedFollowing))
    level = (share * F.sum("source_size").over(every) - below) / rest
    found = cap.withColumn("_level", level)
    first = F.min(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.struct(F.col("_cap") / F.col("_w"), "_level"))).over(every)["_level"]
    return found.select("source", "docs", "source_size", F.least("_cap", F.coalesce(first * F.col("_w"), F.col("_cap"))).alias("target"))


def _rate(z: Column, most: float) -> Column:
    return F.least(F.lit(most), F.exp(F.greatest(F.least(F.col("lam") * z, F.lit(700.0)), F.lit(-700.0))))


def _newton(pairs: DataFrame, state: DataFrame, most: float, narrow: bool) -> DataFrame:
    """One step for every source that is not done: the counted sizes give value and slope of the dual's gradient."""
    todo = state.where("NOT done").select("source", "lam", "_mean")
    joined = pairs.withColumnRenamed("source", "_s").join(F.broadcast(todo) if narrow else todo, F.col("_s").eqNullSafe(F.col("source")))
    words = F.col("n") * F.col("size") * F.col("_r")
    rated = joined.withColumn("_z", F.col("size") / F.col("_mean")).withColumn("_r", _rate(F.col("_z"), most))
    sums = rated.groupBy("_s").agg(F.sum(words).alias("f"), F.sum(F.when(F.col("_r") < most, words * F.col("_z")).otherwise(0.0)).alias("g"))
    step = state.join(F.broadcast(sums) if narrow else sums, F.col("source").eqNullSafe(F.col("_s")), "left")
    lo, hi = F.when(F.col("f") <= F.col("target"), F.col("lam")).otherwise(F.col("lo")), F.when(F.col("f") > F.col("target"), F.col("lam")).otherwise(F.col("hi"))
    step = step.withColumns({"lo": lo, "hi": hi}).withColumn("_next", F.col("lam") - F.try_divide(F.col("f") - F.col("target"), F.col("g")))
    inside = (F.col("_next") > F.col("lo")) & (F.col("_next") < F.col("hi"))
    near = F.abs(F.col("f") - F.col("target")) <= NEAR * F.col("target")
    lam = F.when(F.col("done") | near, F.col("lam")).when(inside, F.col("_next")).otherwise((F.col("lo") + F.col("hi")) / 2)
    tight = (F.col("hi") - F.col("lo")) <= 1e-12 * F.greatest(F.abs("lo"), F.abs("hi"))
    return step.withColumn("lam", lam).withColumn("done", F.col("done") | F.coalesce(near | tight, F.lit(True))).select(state.columns)


def multipliers(of: DataFrame, goal: DataFrame, most: float = MOST) -> DataFrame:
    """Adds ``lam`` to ``goal``."""
    pairs = durable(of.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    mean = F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9))
    wide = F.greatest(mean, F.lit(1.0)) * 100  # the smallest size is 1, so exp(wide / mean) is far beyond the cap
    state = goal.withColumns({"_mean": mean, "lo": -wide, "hi": wide}).withColumn("lam", F.log(F.greatest("target", F.lit(1e-9)) / F.greatest("source_size", F.lit(1))))
    state = durable(state.withColumn("done", (F.col("target") <= 0) | (F.col("target") >= most * F.col("source_size") * (1 - 1e-12))))
    narrow = goal.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    for _ in range(ROUNDS):
        if not state.where("NOT done").limit(1).count():
            break
        for _ in range(STEPS):
            state = _newton(pairs, state, most, narrow)
        state = durable(state)
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    return state.withColumn("lam", F.when(F.col("source_size") == 0, F.lit(0.0)).when(full, F.col("hi")).otherwise(F.col("lam")))


def _with_order(of: DataFrame, params: DataFrame, most: float) -> DataFrame:
    """Joins the source's row and adds whole (certain copies) and v (place in the order of one copy more, null for none)."""
    p = params.withColumnRenamed("source", "_s")
    joined = of.join(if_small(p), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.round(_rate(F.col("size") / F.col("_mean"), most), 9))
    uniform = F.pmod(F.xxhash64("row_hash", "size"), F.lit(1 << 52)) / float(1 << 52)
    return joined.withColumn("_rate", rate).withColumn("whole", F.floor("_rate")).withColumn(
        "v", F.when((F.col("whole") < most) & (F.col("size") > 0), uniform - (F.col("_rate") - F.col("whole"))))


def _bucket(v: Column) -> Column:
    return F.floor((v + 1.0) * (BUCKETS / 2.0))


def cuts(of: DataFrame, params: DataFrame, most: float = MOST) -> DataFrame:
    """Adds the cut to ``params``: rows before (cut, cut_hash) in the order of (v, row_hash) get one copy more, and ``cut_take`` of
    the ``cut_alike`` rows that lie on it."""
    rows = _with_order(of, params, most)
    by = rows.groupBy("source", _bucket(F.col("v")).alias("_b")).agg(F.sum("size").alias("_sum"), F.sum(F.col("whole") * F.col("size")).alias("_sure"), F.min("target").alias("target"))
    need = F.col("target") - F.sum("_sure").over(W.partitionBy("source"))
    upto = F.sum(F.when(F.col("_b").isNotNull(), F.col("_sum")).otherwise(0)).over(W.partitionBy("source").orderBy(F.asc_nulls_first("_b")))
    by = durable(by.withColumn("need", need).withColumn("upto", upto))  # at most BUCKETS + 1 rows for each source
    edge = by.where("_b IS NOT NULL AND upto > need").groupBy("source").agg(F.min_by(F.struct("_b", (F.col("need") - (F.col("upto") - F.col("_sum"))).alias("left")), "_b").alias("e"))
    edge = durable(edge.select(F.col("source").alias("_s"), F.col("e._b").alias("_edge"), F.col("e.left").alias("_left")))
    last = rows.join(if_small(edge), F.col("source").eqNullSafe(F.col("_s"))).where(_bucket(F.col("v")) == F.col("_edge"))
    alike = last.groupBy("source", "v", "row_hash", "size", "_left").agg(F.count(F.lit(1)).alias("n"))
    # one bucket of each source, with repeated rows already counted
    before = F.coalesce(F.sum(F.col("n") * F.col("size")).over(W.partitionBy("source").orderBy("v", "row_hash").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    take = F.least("n", F.floor((F.col("_left") - F.col("_before")) / F.col("size") + 0.5))
    begun = alike.withColumn("_before", before).where(F.col("_before") + F.col("size") / 2 <= F.col("_left"))
    at = F.struct(F.col("v").alias("cut"), F.col("row_hash").alias("cut_hash"), take.cast("bigint").alias("cut_take"), F.col("n").alias("cut_alike"))
    exact = begun.groupBy(F.col("source").alias("_s")).agg(F.max(at).alias("_at"))
    joined = params.join(edge, params["source"].eqNullSafe(edge["_s"]), "left").drop("_s").join(exact, params["source"].eqNullSafe(exact["_s"]), "left").drop("_s")
    nobody = F.when(F.col("_edge").isNull(), F.lit(2.0)).otherwise(F.col("_edge") * (2.0 / BUCKETS) - 1.0 - 1e-12)  # no row lies there
    joined = joined.withColumn("cut", F.coalesce("_at.cut", nobody))
    return joined.withColumns({c: F.coalesce(f"_at.{c}", F.lit(0).cast("bigint")) for c in ("cut_hash", "cut_take", "cut_alike")}).drop("_edge", "_left", "_at")


def plan(of: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row for each source: docs, source_size, target, lam and the cut (see ``cuts``)."""
    goal = durable(targets(of, weights, share, most))
    return durable(cuts(of, multipliers(of, goal, most), most))


def with_copies(of: DataFrame, params: DataFrame, most: float = MOST) -> DataFrame:
    """Rows of ``of`` (doc_id, source, size, row_hash and more) with source_size, target and copies."""
    rows = _with_order(of, params, most)
    on_cut = F.coalesce((F.col("v") == F.col("cut")) & (F.col("row_hash") == F.col("cut_hash")), F.lit(False))
    split = on_cut & (F.col("cut_take") < F.col("cut_alike"))
    more = (F.col("v") < F.col("cut")) | ((F.col("v") == F.col("cut")) & (F.col("row_hash") <= F.col("cut_hash")))
    names = [*of.columns, "source_size", "target"]
    if not params.where("cut_take < cut_alike").limit(1).count():
        return rows.select(*names, (F.col("whole") + F.coalesce(more.cast("int"), F.lit(0))).cast("bigint").alias("copies"))
    plain = rows.where(~split).select(*names, (F.col("whole") + F.coalesce(more.cast("int"), F.lit(0))).cast("bigint").alias("copies"))
    # repeated rows are counted on the map side, then dealt out again in blocks
    counted = rows.where(split).groupBy(*names, "whole", "cut_take").agg(F.count(F.lit(1)).alias("_n"))
    order = W.partitionBy("source").orderBy(F.to_json(F.struct(*of.columns)))  # one row of a source, unless maps differ
    counted = counted.withColumn("_before", F.sum("_n").over(order) - F.col("_n"))
    blocks = counted.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(BLOCK).cast("bigint"))))
    each = F.sequence("_from", F.least(F.col("_from") + BLOCK, F.col("_n")) - 1)
    dealt = blocks.repartition("source", "_from").withColumn("_i", F.explode(each))
    lucky = (F.col("_before") + F.col("_i") < F.col("cut_take")).cast("int")
    return plain.unionByName(dealt.select(*names, (F.col("whole") + lucky).cast("bigint").alias("copies")))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    of = durable(sizes(docs))
    out = with_copies(of, plan(of))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, each as often as the mix takes it."""
    params = plan(durable(sizes(docs)))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # columns of any name ride along
    of = docs.select(row.alias("_row"), "doc_id", "source", _size().alias("size"), _row_hash(docs).alias("row_hash"))
    out = with_copies(of, params).where("copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
