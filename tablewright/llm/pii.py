"""Personal data: high-recall generators propose spans, boosted trees score them, calibrated thresholds select redactions.

Generators are regular expressions; every match becomes a candidate with a handful of small whole-number features of its
format (length, digits, groups, characters, arithmetic check) and context (words before it, glued to a word). All
candidates of all documents are counted by feature vector; the number of vectors is bounded by the product of the
feature ranges, so the table that the trees are grown on has a fixed bound whatever the data. Labels are weak: the
strict base patterns with their checks, and labelling rules for the loose generators. Trees become CASE expressions,
and each kind's threshold is the lowest that reaches the wanted precision on held-out documents.

Base spans (strict patterns that pass their check) are always kept; the method only adds spans that overlap none of
them. Positions are code points, end exclusive. Everything is DataFrame expressions; only feature counts reach the driver.

Defined cases: null text is empty and has no spans; an empty table gives an empty result; repeated rows give repeated results; a
kind without held-out positives adds nothing; of two overlapping added neighbours the better score (then the earlier) stays.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import fold, let
from tablewright.session import durable

KINDS = ("email", "ip", "card", "phone", "secret")  # order of spans that start together
LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# (kind, strict, needed character, pattern). \G or the look-behind only skips starts inside a run that has failed already;
# possessive quantifiers stand where the base pattern cannot backtrack into a match, so the matches are the same.
GENERATORS = (
    (0, True, "@", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++"),
    (1, True, ".", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    (2, True, "", r"[0-9](?:[ -]?[0-9])++"),
    (3, True, "+", r"\+[0-9][ ().0-9-]+[0-9]"),
    (0, False, "at", rf"(?<!{LOCAL}){LOCAL}++ ?[\[(]at[\])] ?{LABEL}++(?: ?(?:\.|[\[(]dot[\])]) ?{LABEL}++)++"),
    (3, False, "", r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    (4, False, "", r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+"),
)
CONTEXT = 24  # characters before a candidate
# context classes, the first that matches counts
CONTEXTS = (r"(?:token|secret|api[_ -]?key|passw\w*|auth\w*)\W{0,6}$", r"(?:tel|phone|call|fax|mobile)\w*\W{0,4}$", r"(?:mail|contact|write to)\w*\W{0,4}$",
            r"(?:card|visa|account|credit)\w*\W{0,4}$", r"(?:version|section|isbn|page|chapter|order)\W{0,3}$")
FEATURES = {"kind": 5, "loose": 2, "length": 8, "digits": 8, "groups": 5, "check": 2, "chars": 4, "context": 6, "glued": 2}  # name: number of values
ROUNDS, DEPTH, RATE, PENALTY = 12, 3, 0.4, 1.0
FOLDS, PRECISION = 4, 0.95


def _before(lengths: Column) -> Column:
    """For each element the sum of those before it, in blocks, so long arrays cost far less than a square."""
    size = 128

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def place(a: Column, bases: Column) -> Column:
        return F.transform(a, lambda _, i: F.get(bases, F.floor(i / size).cast("int")) + total(F.slice(a, (i - i % size) + 1, i % size)))

    def with_bases(a: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / size).cast("int")), lambda b: total(F.slice(a, b * size + 1, size)))
        bases = let(sums, lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))))
        return let(bases, lambda x: place(a, x))

    return let(lengths, with_bases)


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, F.substring(F.lit("0246813579"), d + 1, F.lit(1)).cast("int")).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _check(kind: int, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == 1:
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == 2:
        return F.when((n >= 12) & (n <= 19), _luhn(digits)).otherwise(False)
    if kind == 3:
        return (n >= 9) & (n <= 15)
    if kind == 4:
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return m.rlike(r"[A-Za-z]{2,}$")


def _bin(n: Column, edges: tuple[int, ...]) -> Column:
    return sum((F.when(n >= e, 1).otherwise(0) for e in edges), F.lit(0))


def _candidate(kind: int, strict: bool, m: Column, before: Column, start: Column) -> Column:
    check = _check(kind, m)
    digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    near = F.lower(F.right(before, F.lit(CONTEXT)))
    context = F.coalesce(*[F.when(near.rlike(p), i + 1) for i, p in enumerate(CONTEXTS)], F.lit(0))
    chars = F.when(m.rlike(r"^[0-9 ().+-]+$"), 0).when(m.rlike(r"^[0-9a-f]+$|^[0-9A-F]+$"), 1).when(m.rlike(r"^[A-Za-z0-9]+$"), 2).otherwise(3)
    if strict:
        label = F.lit(True) if kind == 0 else check  # the base pattern of e-mail has no check
    elif kind == 0:
        label = check
    elif kind == 3:
        label = context == 2
    else:
        label = check & (context == 1)
    features = {
        "kind": F.lit(kind), "loose": F.lit(0 if strict else 1), "length": _bin(F.length(m), (8, 12, 16, 20, 28, 36, 48)),
        "digits": _bin(digits, (4, 8, 10, 12, 14, 16, 20)), "groups": _bin(F.size(F.split(m, r"[ .-]+")), (2, 3, 4, 5)),
        "check": check.cast("int"), "chars": chars, "context": context, "glued": before.rlike(r"[\p{L}\p{N}]$").cast("int"),
    }
    return F.struct(start.cast("int").alias("start"), F.lit(kind).alias("rank"), (start + F.length(m)).cast("int").alias("end"),
                    (label & F.lit(strict)).alias("base"), label.cast("int").alias("label"), *[features[f].cast("int").alias(f) for f in FEATURES])


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and ``found``: all candidates of the whole text, base ones marked."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = docs.select("doc_id", text.alias("_text"))
    for g, (_, _, need, pattern) in enumerate(GENERATORS):
        may = F.contains("_text", F.lit(need)) if need else F.lit(True)
        cut = cut.withColumns({
            f"_m{g}": F.when(may, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")),
            f"_p{g}": F.when(may, F.split("_text", pattern, -1)).otherwise(F.array().cast("array<string>"))})
    cut = cut.drop("_text")
    def listed(g: int, kind: int, strict: bool) -> Column:
        m, p = F.col(f"_m{g}"), F.col(f"_p{g}")
        steps = F.transform(m, lambda x, i: F.length(F.get(p, i)) + F.length(x))

        def one(at: Column, x: Column, i: Column) -> Column:
            before = F.get(p, i)
            raw = F.struct(x.alias("m"), before.alias("before"), (F.get(at, i) + F.length(before)).alias("start"))
            return let(raw, lambda c: _candidate(kind, strict, c["m"], c["before"], c["start"]))

        return let(_before(steps), lambda at: F.transform(m, lambda x, i: one(at, x, i)))

    every = [listed(g, kind, strict) for g, (kind, strict, _, _) in enumerate(GENERATORS)]
    every[-1] = F.filter(every[-1], lambda c: c["check"] == 1)  # long runs of letters only are words
    return cut.select("doc_id", F.concat(*every).alias("found"))


# --- boosted trees on the table of feature vectors


def _grow(rows: list[tuple[tuple[int, ...], float, float]], depth: int):
    """Tree over (features, gradient sum, hessian sum): ("leaf", value) or (feature, cut, low, high)."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best, split = 1e-6, None
    if depth:
        for f in range(len(FEATURES)):
            sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
            for x, a, b in rows:
                sums[x[f]][0] += a
                sums[x[f]][1] += b
            lg = lh = 0.0
            for v in sorted(sums)[:-1]:
                lg, lh = lg + sums[v][0], lh + sums[v][1]
                gain = lg * lg / (lh + PENALTY) + (g - lg) ** 2 / (h - lh + PENALTY) - g * g / (h + PENALTY)
                if gain > best:
                    best, split = gain, (f, v)
    if split is None:
        return ("leaf", RATE * g / (h + PENALTY))
    f, v = split
    return (f, v, _grow([r for r in rows if r[0][f] <= v], depth - 1), _grow([r for r in rows if r[0][f] > v], depth - 1))


def _value(tree, x: tuple[int, ...]) -> float:
    while tree[0] != "leaf":
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree[1]


def boost(table: list[tuple[tuple[int, ...], int, int]]) -> list:
    """Newton boosting of logistic loss on (features, rows, positives); deterministic."""
    trees, score = [], {x: 0.0 for x, _, _ in table}
    for _ in range(ROUNDS):
        rows = []
        for x, n, pos in table:
            p = 1 / (1 + math.exp(-score[x]))
            rows.append((x, pos - n * p, n * p * (1 - p)))
        trees.append(_grow(rows, DEPTH))
        for x in score:
            score[x] += _value(trees[-1], x)
    return trees


def margin(trees: list, c: Column) -> Column:
    """Summed trees of a candidate struct as one expression."""
    names = list(FEATURES)

    def expr(t) -> Column:
        return F.lit(float(t[1])) if t[0] == "leaf" else F.when(c[names[t[0]]] <= t[1], expr(t[2])).otherwise(expr(t[3]))

    return sum((expr(t) for t in trees), F.lit(0.0))


def fit(found: DataFrame) -> tuple[list, dict[int, float]]:
    """Trees, and the threshold on the margin for each kind that adds spans."""
    flat = found.select((fold("doc_id", FOLDS) == 0).alias("held"), F.explode("found").alias("c"))
    counts = flat.groupBy("held", *[F.col(f"c.{f}").alias(f) for f in FEATURES]).agg(F.count(F.lit(1)).alias("n"), F.sum("c.label").alias("pos"))
    rows = sorted(tuple(r) for r in counts.collect())  # at most 2 x the product of FEATURES rows
    trees = boost([(tuple(r[1:-2]), r[-2], r[-1]) for r in rows if not r[0]])
    cuts = {}
    for kind in range(len(KINDS)):
        held = sorted(((sum(_value(t, tuple(r[1:-2])) for t in trees), r[-2], r[-1]) for r in rows if r[0] and r[1] == kind), reverse=True)
        n = pos = 0
        for s, k, p in held:
            n, pos = n + k, pos + p
            if pos and pos >= PRECISION * n:
                cuts[kind] = s
    return trees, cuts


def _listing(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, ``base`` and ``added``: arrays of (start, rank, end), sorted; ranks are positions in KINDS."""
    found = durable(candidates(docs))
    trees, cuts = fit(found)

    def span(c: Column, *more: Column) -> Column:
        return F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"), *more)

    base = F.sort_array(F.transform(F.filter("found", lambda c: c["base"]), lambda c: span(c)))
    split = found.select("doc_id", "found", base.alias("base"))

    def apart(c: Column) -> Column:
        return ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))

    picked = F.transform(F.filter("found", lambda c: ~c["base"]), lambda c: span(c, margin(trees, c).alias("score")))

    def over(c: Column) -> Column:
        test = F.lit(False)
        for kind, cut in cuts.items():
            test = test | ((c["rank"] == kind) & (c["score"] >= cut - 1e-9))
        return test

    more = F.sort_array(F.filter(picked, lambda c: over(c) & apart(c)))

    def best(s: Column) -> Column:
        def clear(c: Column, i: Column) -> Column:
            left, right = F.get(s, i - 1), F.get(s, i + 1)
            beaten = F.coalesce((left["end"] > c["start"]) & (left["score"] >= c["score"]), F.lit(False))
            return ~(beaten | F.coalesce((right["start"] < c["end"]) & (right["score"] > c["score"]), F.lit(False)))

        return F.transform(F.filter(s, clear), lambda c: span(c))

    return split.select("doc_id", "base", let(more, best).alias("added"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, their digest, and all spans as text."""
    out = find(docs)
    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("bigint").alias(f"n_{KINDS[rank]}")

    counts = [count(rank) for rank in range(4)]
    every = F.sort_array(F.concat("base", "added"))
    return out.select("doc_id", *counts, F.sha2(_listing(F.col("base")), 256).alias("base_sha256"), _listing(every).alias("spans"))


def redact(docs: DataFrame, mask: str = "[REDACTED]") -> DataFrame:
    """doc_id and text with every span replaced; overlapping spans become one mask."""
    spans = find(docs.select(F.xxhash64("text").alias("doc_id"), "text")).dropDuplicates(["doc_id"])
    every = F.sort_array(F.concat("base", "added"))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        piece = F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.lit(mask))).otherwise(a["out"])
        return F.struct(piece.alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    joined = docs.select("doc_id", "text", F.xxhash64("text").alias("_h")).join(spans.select(F.col("doc_id").alias("_h"), every.alias("_s")), "_h")
    folded = F.aggregate("_s", zero, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return joined.select("doc_id", folded.alias("text"))
