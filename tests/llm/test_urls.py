"""Hosts, rules and the character models against plain Python."""

import math
import re

import pytest

from tablewright.llm import urls

SCHEMA = "page_id bigint, url string, html string, host string, score string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host):])[0]


def rule(host, path):
    best = None
    for text, verdict in urls.RULES:
        h, p = text.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(text) > len(best[0])):
            best = (text, verdict)
    return best or (None, None)


def cells(url):
    plain = re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), url or ""))
    c = [0] * 3 + [urls.ALPHABET.find(x) + 1 for x in plain]
    return [c[i] + 32 * c[i - 1] + 1024 * c[i - 2] + 32768 * c[i - 3] for i in range(3, len(c))]


def models(ruled):
    """log ratio of a cell by interpolation, worked out on demand."""
    seen = {}
    for url, verdict in ruled:
        for c in cells(url):
            for order in range(1, 5):
                k = (order, c % 32**order, verdict)
                seen[k] = seen.get(k, 0) + 1

    def p(order, cell, verdict):
        if order == 0:
            return 1 / 32
        context = cell // 32
        n = [seen.get((order, context * 32 + x, verdict), 0) for x in range(32)]
        t = sum(x > 0 for x in n)
        q = p(order - 1, cell % 32 ** (order - 1), verdict)
        return (n[cell % 32] + t * q) / (sum(n) + t) if sum(n) + t else q

    return lambda cell: math.log(p(4, cell, "allow")) - math.log(p(4, cell, "block"))


def check(pages):
    rows = [(r["page_id"], r["url"]) for r in pages.collect()]
    ruled = [(u, rule(*split(u))[1]) for _, u in rows if rule(*split(u))[1]]
    ratio, memo = models(ruled), {}
    out = urls.judge(pages).collect()
    assert len(out) == len(rows)
    want = sorted((repr((i, *split(u), *rule(*split(u)))), u) for i, u in rows)
    got = sorted((repr((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None)), r["score"], r["verdict"], r["rule"]) for r in out)
    assert [g[0] for g in got] == [w[0] for w in want]
    by = {}
    for (k, u), (_, s, _, _) in zip(want, got):
        c = cells(u)
        value = sum(memo.setdefault(x, None) or memo.__setitem__(x, ratio(x)) or memo[x] for x in c) / max(1, len(c))
        by.setdefault(k, []).append((s, value))
    for pairs in by.values():
        assert sorted(a for a, _ in pairs) == pytest.approx(sorted(b for _, b in pairs), abs=1e-6)
    free = [(r["score"], r["verdict"]) for r in out if r["rule"] is None]
    allowed, blocked = [s for s, v in free if v == "allow"], [s for s, v in free if v == "block"]
    assert not allowed or not blocked or max(blocked) < min(allowed)
    return out


def test_whole_table(spark, sf):
    out = check(spark.read.parquet(f"{sf}/pages.parquet"))
    assert {r["verdict"] for r in out} == {"allow", "block"}


def test_odd_urls(spark):
    texts = [None, "", "no scheme/en/", "http://Example.COM/en/x", "http://example.com/en/x", "https://www.example.com/en/1", "https://a.www.example.com/en/", "http://x.net/es/", "http://x.net/es",
             "http://net/fr/1", "http://notnet.org/fr/", "ftp://b.com?x=1", "http://b.com/", "a://b://c/d", "http://ünï.com/é#f", "://h/p", "http://b.com:80/", "http://y.com/" + "q" * 5000]
    rows = [(i if i != 3 else None, u, None, "clash", "clash") for i, u in enumerate(texts + texts[:5])]
    check(spark.createDataFrame(rows, SCHEMA))


def test_no_rows(spark):
    assert urls.judge(spark.createDataFrame([], SCHEMA)).count() == 0
