"""Links, components and estimates against all pairs computed in full."""

import math

import numpy as np
import pytest
from conftest import same

from tablewright.llm import vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, a string, node bigint, ball int"


def expected(rows):
    """All pairs of usable vectors of one length, in double precision."""
    keep = [k for k, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    count, parent = dict.fromkeys(range(len(rows)), 0), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for size in {len(rows[k][1]) for k in keep}:
        of = [k for k in keep if len(rows[k][1]) == size]
        x = np.array([rows[k][1] for k in of], dtype=np.float32).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for i, j in zip(*np.nonzero(x @ x.T >= 0.9)):
            if i < j:
                count[of[i]] += 1
                count[of[j]] += 1
                a, b = find(of[i]), find(of[j])
                parent[max(a, b)] = min(a, b)
    ids = {}
    for k in keep:
        if rows[k][0] is not None:
            ids[find(k)] = min(rows[k][0], ids.get(find(k), rows[k][0]))
    for k, (i, _) in enumerate(rows):
        root = ids.get(find(k)) if k in keep else i
        yield (i, count[k], root, i == root)


def check(spark, rows, block=vectors.BLOCK, missable=False):
    df = spark.createDataFrame([(i, v, 1, "x", 5, None) for i, v in rows], SCHEMA).repartition(3)
    out = vectors.report(df, block=block)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    got, want = sorted(tuple(r) for r in out.collect()) if missable else [tuple(r) for r in out.collect()], list(expected(rows))
    if missable:  # tens of thousands of pairs near the limit: a few may share no band
        assert [(i, c, k) for i, _, c, k in got] == [(i, c, k) for i, _, c, k in want]
        assert all(n <= m for (_, n, *_), (_, m, *_) in zip(got, want)) and sum(r[1] for r in got) >= (1 - vectors.MISS) * sum(r[1] for r in want)
    else:
        same(got, want)


def at_cosine(r, base, cosine):
    other = r.standard_normal(len(base))
    other -= other @ base * base
    return cosine * base + math.sqrt(1 - cosine * cosine) * other / np.linalg.norm(other)


def planted(seed, dims=64, groups=40):
    """Random vectors, and pairs at cosines on both sides of the limit."""
    r = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        base = r.standard_normal(dims)
        base /= np.linalg.norm(base)
        out.append(base)
        out += [at_cosine(r, base, c) * r.uniform(0.1, 9) for c in r.uniform(0.86, 0.94, 4)]
    return [(int(i), [float(x) for x in v]) for i, v in enumerate(np.array(out, dtype=np.float32))]


def test_whole_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(spark, rows)


def test_around_the_limit(spark):
    check(spark, planted(1))
    check(spark, planted(2, dims=20))


@pytest.mark.parametrize("block", [128, 8])
def test_large_groups(spark, block):
    """Equal vectors, a tight group, a loose group whose members are not all linked, and vectors that hang on a tight group."""
    r = np.random.default_rng(3)
    axis = [r.standard_normal(64) for _ in range(3)]
    axis = [a / np.linalg.norm(a) for a in axis]
    made = [axis[0]] * 200 + [at_cosine(r, axis[1], 0.99) for _ in range(300)] + [at_cosine(r, axis[2], c) for c in r.uniform(0.9, 0.97, 80)] + [at_cosine(r, axis[1], c) for c in r.uniform(0.85, 0.95, 60)]
    made = np.array(made, dtype=np.float32)
    check(spark, [(int(i), [float(x) for x in v]) for i, v in enumerate(made)], block, missable=True)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (9, [1.0, 0.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0]),
            (None, [1.0, 0.1]), (None, [0.0, 1.0]), (None, None), (11, [-0.0, 1e-30]), (12, [3e38, 3e38]), (13, [1e-38, 1e-38]), (14, [1.0]), (15, [5.0]), (16, [-5.0]), (17, [0.0] * 200 + [1.0]), (18, [0.0] * 200 + [2.0])]
    check(spark, rows)
    assert vectors.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_double_precision_column(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [1e200, -1e200])]
    got = vectors.report(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_estimates_are_unbiased_and_bounded():
    """Over many random pairs the mean error is near zero, and the confidence bound holds."""
    r = np.random.default_rng(4)
    x = r.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([at_cosine(r, v, 0.9) for v in x])
    rows = {c: np.concatenate((vectors.encoded(x, 1, 1)[c], vectors.encoded(y, 1, 1)[c])) for c in ("code", "factor", "low", "step", "query")}
    side = vectors.Side(rows, 64)
    a, b = np.arange(4000), np.arange(4000, 8000)
    error = side.estimate(a, b) - 0.9
    assert abs(error.mean()) < 0.01
    assert (np.abs(error) <= vectors.bound(rows["factor"][a], rows["step"][b], 64)).all()


def test_bands_reach_the_stated_miss():
    """The share of pairs at the limit that meet in no band is near ``MISS``."""
    r = np.random.default_rng(5)
    x = r.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([at_cosine(r, v, 0.9) for v in x])
    for n in (500, 50_000):
        rotations, bands = vectors.settings(n, 64)
        met = (vectors.encoded(x, rotations, bands)["keys"] == vectors.encoded(y, rotations, bands)["keys"]).any(axis=1)
        assert met.mean() > 1 - 6 * vectors.MISS
