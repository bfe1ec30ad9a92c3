"""Counts, ranks and distances against plain Python; held-out accuracy."""

import zlib
from collections import Counter

import numpy as np

from tablewright.llm import language


def grams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    out = Counter()
    for w in words:
        out.update(w)
        p = f" {w} "
        out.update(p[i:i + 2] for i in range(len(p) - 1))
        out.update(p[i:i + 3] for i in range(len(p) - 2))
    return out


def code(g):
    n = 0
    for c in g:
        n = (n << language.SYMBOL_BITS) | ord(c)
    return n


def test_counts(odd_rows, monkeypatch):
    for chunk in (language.CHUNK, 16, 5):
        monkeypatch.setattr(language, "CHUNK", chunk)
        for text in [r[1] for r in odd_rows if len(r[1] or "") < 3000] + ["a", "ab", " a b ", "x1y", "Ünï 🙂 ñandú"]:
            keys, n = language.counts(text)
            assert dict(zip(keys.tolist(), n.tolist())) == {code(g): k for g, k in grams(text).items()}, (chunk, text)


def learned(rows, size):
    by = {}
    for i, text, lang in rows:
        if lang is not None and zlib.crc32(("" if i is None else str(i)).encode()) % 3 != 1:
            by.setdefault(lang, Counter()).update(grams(text))
    return {k: [code(g) for g in sorted(c, key=lambda g: (-c[g], code(g)))[:size]] for k, c in sorted(by.items()) if c}


def nearest(text, profiles, size):
    c = grams(text)
    if not c or not profiles:
        return "und"
    own = [code(g) for g in sorted(c, key=lambda g: (-c[g], code(g)))[:size]]
    d = {k: sum(abs(p.index(g) - i) if g in p else size for i, g in enumerate(own)) for k, p in profiles.items()}
    return min(d, key=lambda k: (d[k], k))


def check(docs, size=60):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    want = learned(rows, size)
    assert {k: p.tolist() for k, p in language.learn(docs, size)} == want
    out = language.identify(docs, size).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert sorted(repr((r["doc_id"], r["lang_pred"])) for r in out) == sorted(repr((i, nearest(t, want, size))) for i, t, _ in rows)
    for r in out:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 3 == 1)
    return out


def test_against_brute_force(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in language.identify(docs).collect() if r["held_out"] and lang[r["doc_id"]]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.95


def test_odd_rows(odd):
    out = {r["doc_id"]: r for r in check(odd)}
    assert out[3]["lang_pred"] == out[4]["lang_pred"] == out[5]["lang_pred"] == "und"


def test_no_rows(nothing):
    assert language.identify(nothing).count() == 0
