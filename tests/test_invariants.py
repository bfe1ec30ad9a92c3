"""Properties that must hold on any data, checked on generated small tables and on skewed ones."""

import itertools
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.operators import clean as K
from tablewright.operators import kpi
from tablewright.operators import ordered as R
from tablewright.operators.filters import Condition, filter_rows
from tablewright.operators.quality import uncovered_spans
from tablewright.queries.base import table, view
from tablewright.streaming import events as E

QUICK = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def skewed(spark, n=3000):
    """One key holds two thirds of the rows, and many rows share one moment."""
    rnd = random.Random(5)
    rows = [(i, "hot" if rnd.random() < 0.67 else f"k{rnd.randrange(40)}", rnd.choice([5, 5, 5, rnd.randrange(100)]), None if rnd.random() < 0.2 else rnd.randrange(-50, 50)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, k string, t int, v long").repartition(7)


def test_running_total_on_a_hot_key(spark):
    rows, df = skewed(spark)
    want, sums = {}, {}
    for i, k, t, v in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        sums[k] = sums.get(k, 0) + (v or 0)
        want[i] = None if v is None else sums[k]
    got = {r.id: r.total for r in R.running_total(df, "v", ["t"], ["k"], ["id"], "total").collect()}
    assert got == want


def test_global_running_values(spark):
    rows, df = skewed(spark)
    ordered = sorted(rows, key=lambda r: (r[2], r[0]))
    acc, high, want = 0, None, {}
    for n, (i, _, _, v) in enumerate(ordered, 1):
        acc += v or 0
        want[i] = (None if v is None else acc, high, n)
        high = v if high is None else high if v is None else max(high, v)
    total = R.running_total(df, "v", ["t"], tie=["id"], out="run")
    both = R.running_max(R.number_rows(total, ["t"], tie=["id"], out="no"), "v", ["t"], tie=["id"], out="high")
    assert {r.id: (r.run, r.high, r.no) for r in both.collect()} == want


def test_percentage_change_on_a_hot_key(spark):
    rows, df = skewed(spark)
    want, last = {}, {}
    for i, k, t, v in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        prev, cur = last.get(k), v if v is not None else last.get(k)
        want[i] = None if not prev or cur is None else round((cur - prev) / prev, 9)
        last[k] = cur
    got = {r.id: r.p for r in R.percentage_change(df, "v", ["t"], ["k"], ["id"], "p").collect()}
    assert {i: None if p is None else round(p, 9) for i, p in got.items()} == want


@QUICK
@given(st.lists(st.integers(-1000, 1000), min_size=1, max_size=60))
def test_exact_median(spark, values):
    import statistics

    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert R.exact_median(df, "x").first()[0] == statistics.median(values)


@QUICK
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 3)), min_size=1, max_size=40))
def test_dedup(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id int, a string, b int")
    first = {p: i for i, p in reversed(list(enumerate(pairs)))}
    last = {p: i for i, p in enumerate(pairs)}
    assert {r.id for r in K.drop_duplicates(df, ["a", "b"], "first", ["id"]).collect()} == set(first.values())
    assert {r.id for r in K.drop_duplicates(df, ["a", "b"], "last", ["id"]).collect()} == set(last.values())
    assert {r.id for r in K.drop_duplicates(df, ["a", "b"], False).collect()} == {i for i, p in enumerate(pairs) if pairs.count(p) == 1}
    once = K.drop_duplicates(df, ["a", "b"], "first", ["id"])
    assert K.drop_duplicates(once, ["a", "b"], "first", ["id"]).count() == once.count()


def test_keep_and_drop_split_the_table(spark, sf):
    df = view(spark, sf, "sheet")
    conds = [Condition("segment", "contains", "m"), Condition("balance", "gt", 2000), Condition("gender", "not_in", ["M"])]
    for logic in ("and", "or"):
        keep, drop = filter_rows(df, conds, logic), filter_rows(df, conds, logic, mode="drop")
        assert keep.count() + drop.count() == df.count()
        assert keep.join(drop, "id").count() == 0


def test_preparation_never_drops_rows(spark, sf):
    for name in ("sheet", "ledger"):
        df = view(spark, sf, name)
        assert K.prepare_for_filter(df).count() == df.count()


def test_trend_totals_equal_status_totals(spark, sf):
    jobs, records = view(spark, sf, "jobs"), table(spark, sf, "lineitem")
    wide = kpi.trend_by_day(kpi.daily_trend(jobs, records, "l_orderkey"))
    sums = wide.agg(*[F.sum(c).alias(c) for c in ("uploads", "succeeded", "quarantined", "records")]).first()
    counts = {r.status: r.jobs for r in kpi.status_counts(jobs).collect()}
    assert sums.uploads == sum(counts.values()) and sums.succeeded == counts["succeeded"] and sums.quarantined == counts["quarantined"]
    assert sums.records == records.join(jobs, records.l_orderkey == jobs.id, "left_semi").count()


def test_bursts_against_brute_force(spark):
    rnd = random.Random(3)
    times = [(rnd.choice(["hot", "hot", "a", "b"]), rnd.randrange(0, 4000)) for _ in range(600)]
    df = spark.createDataFrame(times, "who string, s int").select("who", F.timestamp_seconds("s").alias("ts"))
    got = {(r.who, r.at_us // 1_000_000): r.n for r in E.bursts_batch(df, "who", 60, 4).collect()}
    want = {}
    for who, s in times:
        n = sum(1 for w, x in times if w == who and s - 60 < x <= s)
        if n > 4:
            want[(who, s)] = n
    assert got == want


def test_spans_against_brute_force(spark):
    rnd = random.Random(11)
    text = "".join(rnd.choice("ab \n") for _ in range(5000))
    cuts = sorted(rnd.sample(range(4900), 120))
    spans = [(1, s, s + rnd.randrange(1, 60)) for s in cuts]
    covered = set(itertools.chain.from_iterable(range(s, e) for _, s, e in spans))
    gaps, start = [], None
    for i in range(len(text) + 1):
        free = i < len(text) and i not in covered
        if free and start is None:
            start = i
        if not free and start is not None:
            if text[start:i].strip():
                gaps.append((1, start, i))
            start = None
    texts = spark.createDataFrame([(1, text, len(text))], "k int, text string, n_chars int")
    got = sorted(tuple(r) for r in uncovered_spans(texts, spark.createDataFrame(spans, "k int, span_start int, span_end int"), "k").collect())
    assert got == gaps


def test_hot_ranks_are_cut_before_the_shuffle(spark, sf):
    from tablewright.operators.rows import first_per_key

    df = first_per_key(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Partial") > plan.index("Exchange")


@pytest.mark.parametrize("name", ["m01_token_overlap", "m05_weighted_candidates", "j01_inner_join_rows", "f19_above_average_of_group", "a29_agreement", "r07_slice_shares"])
def test_no_cross_joins(spark, sf, name):
    import __spark_entry__ as driver

    plan = driver.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf):
    df = filter_rows(table(spark, sf, "lineitem"), [Condition("l_quantity", "gt", 40)], select=["l_orderkey"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,40" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
