"""Base spans against Python's re; the trees against their own plain evaluation; added spans by planted cases."""

import hashlib
import re

from tablewright.llm import pii

BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(d):
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def base(text):
    spans = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(BASE) for m in re.finditer(p, text or "") if ok(k, m[0])]
    return [(k, a, b) for a, _, b, k in sorted(spans)]


def check(docs):
    rows = sorted(docs.select("doc_id", "text").collect(), key=repr)
    got = {}
    for r in pii.report(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for r in rows:
        spans = base(r["text"])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want = (*[sum(s[0] == k for s in spans) for k, _ in BASE], hashlib.sha256(text.encode()).hexdigest())
        mine = [g for g in got[r["doc_id"]] if tuple(g)[1:6] == want]
        assert mine, (r, got[r["doc_id"]])
        listed = [s.split(":") for s in mine[0]["spans"].split(",") if s]
        every = [(k, int(a), int(b)) for k, a, b in listed]
        assert set(spans) <= set(every)
        assert every == sorted(every, key=lambda s: (s[1], pii.KINDS.index(s[0])))
        for s in set(every) - set(spans):  # added ones touch no base span
            assert not any(a < s[2] and s[1] < b for _, a, b in spans)
    return got


def test_whole_table(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


HARD = ["a@b.com_c@d.com", "x@y", "a@b.c.d.e@f.g", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4 1..2.3.4.5", "4111 1111 1111 1111 4111-1111-1111-1112 5", "+1 (555) 555-0101 +12 +49.30.1234567",
        "1" * 3000, "a." * 3000 + "@", "@" * 50, "1-" * 4000, "+1 " * 300, "é a@b.co 🙂 +44 20 7946 0958 ñ 10.0.0.1", "9" * 12 + " " + "0" * 13, "a@b-.c- %+@x.y.", "1.1.1.1" * 50]


def test_hard_texts(spark, odd):
    rows = [(100 + i, t) for i, t in enumerate(HARD)]
    check(odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string")))


def test_no_rows(nothing):
    assert pii.report(nothing).count() == 0


def test_trees_agree_with_their_expression(spark):
    table = [((k, l, a, d, g, c, ch, x, gl), 10, 10 if c and x == 1 else 0) for k in (0, 4) for l in (0, 1) for a in (2, 5) for d in (1, 4) for g in (0,) for c in (0, 1) for ch in (1, 3) for x in (0, 1) for gl in (0,)]
    trees = pii.boost(table)
    names = list(pii.FEATURES)
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([tuple(x) for x, _, _ in table], ", ".join(f"{n} int" for n in names)).select(F.struct(*names).alias("c"))
    for r in rows.select("c", pii.margin(trees, F.col("c")).alias("m")).collect():
        want = sum(pii._value(t, tuple(r["c"])) for t in trees)
        assert abs(r["m"] - want) < 1e-9
        assert (want > 0) == (r["c"]["check"] == 1 and r["c"]["context"] == 1)


def test_added_spans(spark):
    """Secrets in context are added, plain long words are not; loose phones need their context."""
    rows = []
    for i in range(240):
        key = hashlib.sha1(str(i).encode()).hexdigest()
        rows.append((i, f"text {i} token = \"{key}\" and more" if i % 2 else f"the file {key} was fine, see commit {key[::-1]}"))
    out = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(("secret:" in out[i]) == (i % 2 == 1) for i in range(240))


def test_redaction(spark):
    rows = [(1, "mail a@b.com now +1 555 010 0199."), (2, None), (3, "")]
    out = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[1] == "mail [REDACTED] now [REDACTED]."
    assert out[3] == ""
