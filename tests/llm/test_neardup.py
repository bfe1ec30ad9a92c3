"""Fingerprints, links and components against brute force."""

import random

import pytest
import xxhash
from conftest import prose

from tablewright.llm import neardup


def fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(points, bits=2):
    points = sorted(set(points))
    parent = {p: p for p in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(points):
        for b in points[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in points}


def check(docs):
    rows = [(r["doc_id"], fingerprint(r["text"])) for r in docs.collect()]
    of = roots([f for _, f in rows])
    first = {}
    for i, f in rows:
        if i is not None:
            first[of[f]] = min(i, first.get(of[f], i))
    want = sorted(repr((i, f"{f:016x}", first.get(of[f]))) for i, f in rows)
    assert sorted(repr(tuple(r)) for r in neardup.report(docs).select("doc_id", "fingerprint", "component_id").collect()) == want


def test_whole_table(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_odd_rows(odd, nothing):
    check(odd)
    assert neardup.report(nothing).count() == 0


@pytest.mark.parametrize("bucket", [32, 2, 1])
def test_dense_points(spark, bucket):
    """Clusters far larger than a bucket: nothing is lost, no link is wrong."""
    r = random.Random(bucket)
    points = {0, 1, -1 & (2**64 - 1), 1 << 63}
    for _ in range(3):
        centre = r.getrandbits(64)
        for _ in range(150):
            points.add(centre ^ sum(1 << b for b in r.sample(range(64), r.choice([0, 1, 2, 3, 6]))))
    points |= {r.getrandbits(64) for _ in range(100)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in points], "fp bigint")
    edges = neardup.links(df, bucket=bucket)
    for r_ in edges.collect():
        assert ((r_["a"] ^ r_["b"]) & (2**64 - 1)).bit_count() <= 2
    got = {x["node"]: x["root"] for x in neardup.components(edges).collect()}
    want = roots([signed(p) & (2**64 - 1) for p in points])
    same = {}
    for p in points:
        same.setdefault(want[p], set()).add(got.get(signed(p), signed(p)))
    assert all(len(s) == 1 for s in same.values())
    assert len({next(iter(s)) for s in same.values()}) == len(same)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in neardup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_one_of_each_group_stays(spark, odd, nothing):
    rows = [(10, prose(1, 80)), (11, prose(1, 80)), (12, prose(2, 80)), (12, prose(2, 80)), (13, prose(3, 80)), (13, prose(4, 80)), (None, prose(5, 80)), (None, prose(5, 80)), (None, prose(1, 80))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id bigint, text string, lang string")
    got = sorted(repr((r["doc_id"], r["text"][:20])) for r in neardup.representatives(docs).collect())
    want = sorted(repr((i, t[:20])) for i, t in [rows[0], rows[2], rows[4], rows[5], rows[6]])
    assert got == want
    assert neardup.representatives(odd).columns == odd.columns
    assert neardup.representatives(nothing).count() == 0


def test_stage_keeps_one_of_each_linked_group(spark, sf):
    """Whole table: the smallest id of each group that brute force links."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], fingerprint(r["text"])) for r in docs.collect()]
    of, first = roots([f for _, f in rows]), {}
    for i, f in rows:
        first[of[f]] = min(i, first.get(of[f], i))
    assert sorted(r["doc_id"] for r in neardup.representatives(docs).collect()) == sorted(first.values())


def test_crowd_of_documents_with_one_passage(spark):
    """Unlike documents that share a long passage stay apart; copies of one of them go."""
    passage = prose(1, 200)
    texts = [passage + " " + prose(100 + i, 260) for i in range(120)] + [passage + " " + prose(100, 260)] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = roots([fingerprint(t) for t in texts])
    assert neardup.representatives(docs).count() == len(set(want.values()))
