"""Runs and extensions against plain comparisons of words."""

import hashlib
import random
import zlib

import numpy as np
from conftest import same
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.llm import periodic


def plain_runs(words):
    """(start, length, period) of all maximal stretches, period by period."""
    found = {}
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q):
                found.setdefault((i, length), q)  # a smaller period came earlier
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def words_of(doc_id, text):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    words = [w for w in text.split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def expected(rows):
    for i, text in rows:
        words = words_of(i, text)
        all_runs = plain_runs(words)
        best = max(all_runs, key=lambda r: (r[1], -r[0], -r[2])) if all_runs else None
        dropped = {k for s, n, q in all_runs for k in range(s + q, s + n)}
        yield (i, len(all_runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
               hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in all_runs).encode()).hexdigest(),
               hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in dropped).encode()).hexdigest())


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    out = periodic.report(docs)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    same([tuple(r) for r in out.collect()], list(expected(rows)))


def test_documents(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 8000"))


def test_odd_rows(odd, nothing):
    check(odd.where("coalesce(length(text), 0) < 6000"))
    assert periodic.report(nothing).count() == 0


def test_every_difference_is_covered():
    assert {(a - b) % periodic.PERIOD for a in periodic.COVER for b in periodic.COVER} == set(range(periodic.PERIOD))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.lists(st.integers(0, 2), max_size=80), st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 30)).map(lambda x: x[0] * x[1])), max_size=6))
def test_runs_of_any_lists(texts):
    doc, start, length, period = periodic.runs(texts)
    got = [[] for _ in texts]
    for d, *r in zip(doc.tolist(), start.tolist(), length.tolist(), period.tolist()):
        got[d].append(tuple(r))
    assert got == [plain_runs(t) for t in texts]


def test_extensions():
    """Random places of repetitive texts, several documents side by side."""
    r = random.Random(7)
    texts = [[r.randint(0, 1) for _ in range(300)], ([1, 2, 3, 4, 5, 6, 7] * 90)[:500], [0] * 400, [r.randint(0, 50) for _ in range(200)] * 3]
    words, owner = [], []
    for d, t in enumerate(texts):
        words += [*t, -1 - d]
        owner += [d] * (len(t) + 1)
    words, owner = np.array(words), np.array(owner)
    pairs = sorted({tuple(sorted(r.sample(range(len(words)), 2))) for _ in range(1500)})
    pairs = [(i, j) for i, j in pairs if owner[i] == owner[j]]
    i, j = np.array(pairs).T

    def plain(a, b):
        n = 0
        while words[a + n] == words[b + n]:
            n += 1
        return n

    assert periodic.Extensions(words, owner).of(i, j).tolist() == [plain(a, b) for a, b in pairs]


def test_long_text():
    """A long periodic text, a single word repeated, and a long text without runs."""
    made = [[k % 997 for k in range(40_000)], [5] * 30_000, list(range(50_000))]
    doc, start, length, period = periodic.runs(made)
    assert list(zip(doc.tolist(), start.tolist(), length.tolist(), period.tolist())) == [(0, 0, 40_000, 997), (1, 0, 30_000, 1)]


def test_texts_that_end_in_repeats():
    """Extensions that go on to the end, or begin at the start, of texts side by side."""
    r = random.Random(9)
    texts = []
    for _ in range(60):
        cycle = [r.randint(0, 30) for _ in range(r.randint(20, 90))]
        texts.append([r.randint(0, 30) for _ in range(r.randint(0, 40))] + cycle * r.randint(1, 7) + cycle[:r.randint(0, 15)] + [99] * r.choice([0, 0, 40]))
    doc, start, length, period = periodic.runs(texts)
    got = [[] for _ in texts]
    for d, *run in zip(doc.tolist(), start.tolist(), length.tolist(), period.tolist()):
        got[d].append(tuple(run))
    assert got == [plain_runs(t) for t in texts] and sum(map(len, got)) > 30
