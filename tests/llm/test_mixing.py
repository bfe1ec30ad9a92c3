"""Targets by the rounds of the rule, the dual's solution, and the rounding."""

import math
import re

import pytest

from tablewright.llm import mixing


def goals(sizes):
    """Share out by weight; what is above twice the size is shared out again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        goal = {s: 2.0 * sizes[s] for s in capped} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if goal[s] > 2 * sizes[s]}
        if not over:
            return goal
        capped |= over


def check(docs):
    rows = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs.collect()]
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    goal = goals(sizes)
    of = mixing.sizes(docs)
    params = {r["source"]: r for r in mixing.plan(of).collect()}
    out = mixing.with_copies(of, mixing.plan(of)).collect()
    assert sorted(repr((r["doc_id"], r["source"], r["size"])) for r in out) == sorted(map(repr, rows))
    for s in sizes:
        mine = [r for r in out if r["source"] == s]
        assert params[s]["target"] == pytest.approx(goal[s], rel=1e-9) and all(r["source_size"] == sizes[s] for r in mine)
        assert all(0 <= r["copies"] <= 2 for r in mine)
        taken = sum(r["copies"] * r["size"] for r in mine)
        assert abs(taken - goal[s]) <= max((r["size"] for r in mine), default=0) + 1e-6, (s, taken, goal[s])
        if 0 < goal[s] < 2 * sizes[s] * (1 - 1e-9):  # the multiplier meets the constraint
            mean = sizes[s] / len(mine)
            met = sum(r["size"] * min(2.0, math.exp(min(700, max(-700, params[s]["lam"] * r["size"] / mean)))) for r in mine)
            assert met == pytest.approx(goal[s], rel=1e-5)
    again = mixing.with_copies(of.repartition(2), mixing.plan(of.repartition(5))).collect()
    assert sorted(repr((r["doc_id"], r["source"], r["size"], r["copies"])) for r in again) == sorted(repr((r["doc_id"], r["source"], r["size"], r["copies"])) for r in out)
    return out


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = check(docs)
    got = mixing.report(docs).collect()
    assert sum(r["taken"] for r in got) == pytest.approx(1.5 * sum(r["size"] for r in out), rel=0.02)


def test_odd_rows(odd, nothing):
    out = check(odd)
    odd = odd.withColumn("a.b", odd["doc_id"]).withColumn("copies", odd["doc_id"]).withColumn("size", odd["doc_id"])
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r["copies"] for r in out)
    assert mixing.report(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


def test_one_large_source(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 37), "big" if i % 3 else f"s{i % 7}") for i in range(900)], "doc_id bigint, text string, source string")
    check(docs)


def test_rows_alike_are_shared_out(spark):
    """Without ids, and with one row repeated: k of n rows alike are taken, whatever the columns beside."""
    texts = [(None, "w " * 40, s, f"l{i % 2}") for s in "abc" for i in range(100)]
    same = [(7, "w " * 10, s, "en") for s in "abc" for _ in range(9_000)]
    for rows in (texts, same):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
        check(docs)
        taken = {r["source"]: r["n"] for r in mixing.mixed(docs).groupBy("source").count().withColumnRenamed("count", "n").collect()}
        n = len(rows) // 3
        assert taken["a"] == 2 * n and abs(taken["b"] - n * 5 / 3) <= 1 and abs(taken["c"] - n * 5 / 6) <= 1
    maps = spark.createDataFrame([(None, "w w", s, {"k": i}) for s in "abc" for i in range(60)], "doc_id bigint, text string, source string, m map<string,int>")
    assert abs(mixing.mixed(maps).count() - 270) <= 3
