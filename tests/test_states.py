"""Profiles from stored states: merged states against the whole table, replaced parts, odd tables."""

from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from tablewright.operators import profile as P
from tablewright.operators import states as S

EXACT = ["column", "dtype", "null_count", "non_null_count", "numeric_min", "numeric_max", "date_min", "date_max", "average_text_length"]


def exact(df):
    return sorted(tuple(r) for r in df.select(*EXACT).withColumn("average_text_length", F.round("average_text_length", 9)).collect())


@pytest.fixture(scope="module")
def sheet(spark):
    n = F.col("id")
    return spark.range(60_000).select(
        F.when(n % 3 > 0, n % 7).alias("day"), F.concat(F.lit("v"), n % 1_000).alias("c0"), F.when(n % 4 > 0, n * n % 10_007).alias("part"),
        F.when(n % 5 > 0, F.sqrt(n)).alias("a.b"), F.timestamp_seconds(n * 1_000).alias("seen"), F.lit(None).cast("double").alias("none"), F.array(n).alias("nested"))


def test_merged_equals_whole(spark, sheet, tmp_path):
    path = str(tmp_path / "states")
    S.refresh(sheet.where("day < 4 OR day IS NULL"), "day", path)
    before = S.stored(spark, path).where("part = 2").select(F.input_file_name()).distinct().collect()
    S.refresh(sheet.where("day >= 4"), "day", path)
    assert S.stored(spark, path).where("part = 2").select(F.input_file_name()).distinct().collect() == before  # other parts stay as they are
    rest = sheet.drop("day")
    states = S.stored(spark, path)
    assert states.count() == 8 * 5 and exact(S.profile(states)) == exact(P.column_profile(rest))

    rows = {r["column"]: r for r in S.profile(states).collect()}
    for name, n in rest.agg(*[F.count_distinct(f"`{c}`").alias(c) for c in ("c0", "part", "a.b", "seen", "none")]).first().asDict().items():
        assert abs(rows[name].distinct_count - n) <= 0.05 * n, name
    for name in ("part", "a.b"):
        values = sorted(r[0] for r in rest.select(F.col(f"`{name}`").alias("v")).dropna().collect())
        for q, v in zip(S.QUANTILES, rows[name].quantiles):
            assert bisect_left(values, v) / len(values) - 0.03 <= q <= bisect_right(values, v) / len(values) + 0.03
    assert rows["none"].quantiles is None and rows["c0"].quantiles is None


def test_part_again_replaces_its_state(spark, sheet, tmp_path):
    path = str(tmp_path / "states")
    for load in ("true", "day = 3", "day = 3"):
        S.refresh(sheet.where(load), "day", path)
    assert exact(S.profile(S.stored(spark, path))) == exact(P.column_profile(sheet.drop("day")))
    changed = sheet.where("day = 3").withColumn("c0", F.lit("x"))
    S.refresh(changed, "day", path)
    want = sheet.where("day IS DISTINCT FROM 3").unionByName(changed).drop("day")
    assert exact(S.profile(S.stored(spark, path))) == exact(P.column_profile(want))


def test_frequent_values(sheet):
    states = S.column_states(sheet.withColumn("c0", F.when(F.col("part") % 3 == 0, "hot").otherwise(F.col("c0"))), "day")
    got = [(r.rank, r.value, r.n) for r in S.frequent_values(states, 4).where("column = 'c0'").orderBy("rank").collect()]
    rows = sheet.withColumn("c0", F.when(F.col("part") % 3 == 0, "hot").otherwise(F.col("c0"))).groupBy("c0").count().orderBy(F.desc("count"), "c0").take(4)
    assert len(got) == 4 and abs(got[0][2] - rows[0]["count"]) <= 60_000 / S.FREQUENT and got[0][1] == "hot"
    few = sheet.select("day", (F.col("part") % 50).cast("string").alias("v"))
    want = few.where("v IS NOT NULL").groupBy("v").count().orderBy(F.desc("count"), "v").take(5)
    assert [(r.value, r.n) for r in S.frequent_values(S.column_states(few, "day")).orderBy("rank").collect()] == [tuple(r) for r in want]
    assert S.frequent_values(states).where("column = 'none'").count() == 0


def test_no_rows(spark, sheet, tmp_path):
    none = sheet.where("false")
    assert S.column_states(none, "day").count() == 0 and S.profile(S.column_states(none, "day")).count() == 0
    path = str(tmp_path / "states")
    S.refresh(sheet, "day", path)
    S.refresh(none, "day", path)
    assert S.stored(spark, path).count() == 8 * 5
