"""Base rules and log-likelihood ratio against plain Python."""

import math
import re
import struct
from collections import Counter

import pytest
import xxhash

import __spark_entry__ as driver
from tablewright.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


def buckets(text, m):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
    signed = [x - (1 << 64) if x >> 63 else x for x in h]
    two = []
    for a, b in zip(signed, signed[1:]):
        x = xxhash.xxh64_intdigest(struct.pack("<q", b), xxhash.xxh64_intdigest(struct.pack("<q", a), 42))
        two.append((x - (1 << 64) if x >> 63 else x) % m)
    return [x % m for x in signed] + two


def model(rows, good, m, a=1.0):
    t, r = Counter(), Counter()
    for i, text in rows:
        b = buckets(text, m)
        r.update(b)
        if i in good:
            t.update(b)
    nt, nr = sum(t.values()), sum(r.values())
    return [math.log((t[k] + a) / (nt + a * m)) - math.log((r[k] + a) / (nr + a * m)) for k in range(m)]


def check(spark, docs, labels):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    quality_of = {}
    for r in labels.collect():
        if r["doc_id"] is not None and r["quality"] is not None:
            quality_of[r["doc_id"]] = min(r["quality"], quality_of.get(r["doc_id"], 1))
    ratio = model(rows, {i for i, q in quality_of.items() if q == 1}, quality.BUCKETS)
    out = quality.judge(docs, labels).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    want = sorted(((i, *base(t), sum(ratio[b] for b in buckets(t, quality.BUCKETS)) / max(1, len(buckets(t, quality.BUCKETS)))) for i, t in rows), key=key)
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["score"]) for r in out), key=key)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    for g, w in zip(got, want):
        assert g[7] == pytest.approx(w[7], abs=1e-9)
    # one cut decides on all
    for r in out:
        if r["base_failed"]:
            assert not r["kept"]
    passed = [r for r in out if not r["base_failed"]]
    if any(not r["kept"] for r in passed):
        assert max(r["score"] for r in passed if not r["kept"]) < min(r["score"] for r in passed if r["kept"])
    return out


def test_whole_table(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = check(spark, docs, labels)
    assert sorted(r["doc_id"] for r in out) == sorted(r[0] for r in driver.queries()["op1_quality_ratio"](spark, sf).select("doc_id").collect())
    good = {r["doc_id"]: r["quality"] for r in labels.collect()}
    judged = [(good[r["doc_id"]], r["kept"]) for r in out if r["doc_id"] in good]
    assert sum(k for q, k in judged if q == 1) >= 0.9 * sum(q for q, _ in judged)
    assert not sum(k for q, k in judged if q == 0)


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (6, 1, 0), (None, 1, 1), (8, None, None)], "doc_id bigint, quality int, toxic int")
    check(spark, odd, labels)


def test_no_labels_and_no_rows(spark, odd, nothing):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    out = quality.judge(odd, labels).collect()
    assert all(r["kept"] != r["base_failed"] for r in out)
    assert quality.judge(nothing, labels).count() == 0
