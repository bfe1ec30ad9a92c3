"""Toxicity: a weighted finite-state pattern grammar over clauses.

A clause is the text between sentence marks. Its words become a string of one-letter classes by a lexicon transducer:
I insult, T threat, Y second-person target, N negation, R reported speech, X intensifier, O anything else. Composed
transducers over that string (regular expressions, so finite-state) read a negated or a reported insult as another symbol
with less weight, and an insult or threat next to a target with more. A text's evidence is the summed weight of its matched
clauses and its density; a logistic curve with fitted scale turns it into a score.

The lexicon holds fixed seeds, and words and word beginnings learned from labelled documents: entries found in toxic
documents far more often than in others, by smoothed log odds. The fit reads a bounded sample of labelled rows
(``SAMPLE``, lowest hashes first); everything else covers all rows.

Defined cases: null and empty text score as text without matches; a text is scored whole, clause by clause; repeated rows score
alike; without labels of both classes the seeds alone count, with fixed weights; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.llm.common import fold, if_small, small_batches, words
from tablewright.session import durable

HELD = 5  # rows whose fold is 0 are never learned from
SAMPLE = 20_000  # labelled documents that the fit reads at most
STEMS = (4, 5, 6, 7, 8)  # lengths of word beginnings that may become entries
MIN_DOCS, MIN_ODDS, MAX_ENTRIES = 5, 2.0, 2_000
HELD_COUNTS = 50_000  # counts that a task holds, beyond the words of one document

# fixed values: seeds of the classes
INSULTS = ("idiot", "idiots", "moron", "morons", "stupid", "scum", "trash", "loser", "losers", "pathetic", "worthless", "disgusting", "clown",
           "imbecile", "dumb", "vermin", "filth", "bastard", "abschaum", "dummkopf", "trottel", "imbécile", "crétin", "ordure", "idiota",
           "estúpido", "basura", "imbécil")
THREATS = ("kill", "hurt", "destroy", "beat", "punish", "shoot", "töten", "tuer", "matar")
TARGETS = ("you", "your", "youre", "u", "du", "dich", "ihr", "toi", "tu", "vous", "tú", "usted", "they", "them", "he", "she")
NEGATIONS = ("not", "no", "never", "nobody", "isnt", "arent", "nicht", "kein", "keine", "pas", "jamais", "nunca", "jamás")
REPORTS = ("said", "says", "called", "calls", "quoted", "wrote", "claimed", "reported", "sagte", "dit", "dijo")
INTENSIFIERS = ("very", "so", "such", "utterly", "total", "complete", "sehr", "très", "muy")
CLASSES = (("X", INTENSIFIERS), ("R", REPORTS), ("N", NEGATIONS), ("Y", TARGETS), ("T", THREATS), ("I", INSULTS))  # later classes win

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSE = re.compile(r"[.!?;:\n]+(?=\s|$)")
# composed patterns, in the order tried at each place: (pattern over classes, factor on the entry's weight)
GRAMMAR = (
    (re.compile(r"R[^IT]{0,3}[IT]"), 0.5),  # reported: he called it ...
    (re.compile(r"N[^IT]{0,2}[IT]"), 0.4),  # negated: not an ...
    (re.compile(r"Y[^ITNR]{0,3}T"), 1.5),  # target then threat
    (re.compile(r"T[^ITNR]{0,2}Y"), 1.5),  # threat then target
    (re.compile(r"Y[^ITNR]{0,3}I"), 1.2),  # target then insult
    (re.compile(r"X+I"), 1.2),
    (re.compile(r"I"), 1.0),
    (re.compile(r"T"), 0.15),  # a threatening verb alone says little
)
SEED_WEIGHT = 3.0


@dataclass
class Grammar:
    """Lexicon weights by word and by word beginning, and the logistic curve on (evidence, density)."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, float, float] = (-3.0, 1.0, 0.0)


KNOWN = {w: c for c, seeds in CLASSES for w in seeds}


def _entry(word: str, g: Grammar) -> float:
    """Weight of an insult entry, 0 if the word is none; the longest learned beginning counts."""
    if word in g.words:
        return g.words[word]
    for n in reversed(STEMS):
        if len(word) >= n and word[:n] in g.stems:
            return g.stems[word[:n]]
    return 0.0


def evidence(text: str | None, g: Grammar) -> tuple[float, float, int]:
    """(summed weight of matches, weight per hundred words, number of matches)."""
    total, matches, n, cache = 0.0, 0, 0, {}
    for clause in CLAUSE.split((text or "").lower()):
        found = WORD.findall(clause)
        n += len(found)
        classes, weights = [], {}
        for i, w in enumerate(found):
            got = cache.get(w)
            if got is None:
                weight = _entry(w, g)
                symbol = KNOWN.get(w, "O")
                if weight > 0 and symbol != "T":
                    symbol = "I"
                elif symbol == "T":
                    weight = SEED_WEIGHT
                elif symbol == "I":
                    symbol = "O"  # a seed that labels speak against
                got = cache[w] = (symbol, weight)
            classes.append(got[0])
            if got[0] in "IT":
                weights[i] = got[1]
        if not weights:
            continue
        line, at = "".join(classes), 0
        while at < len(line):
            for pattern, factor in GRAMMAR:
                m = pattern.match(line, at)
                if m:
                    hit = next(i for i in range(m.start(), m.end()) if i in weights)
                    total += factor * weights[hit]
                    matches += 1
                    at = m.end()
                    break
            else:
                at += 1
    return total, 100 * total / max(n, 20), matches


def _features(text: str | None, g: Grammar) -> tuple[float, float, float]:
    total, density, _ = evidence(text, g)
    return 1.0, math.log1p(total), math.log1p(density)


def score_text(text: str | None, g: Grammar) -> float:
    z = sum(a * b for a, b in zip(g.curve, _features(text, g)))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows (text, toxic), at most ``SAMPLE``: those with the lowest hash of doc_id, never the held-out fold.

    Of near copies, seen by the smallest hash of their three-word shingles, one stays, else their words would count many times.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(fold("doc_id", HELD) != 0)
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select(F.col("doc_id").alias("_id"), "toxic")
    rows = docs.select("doc_id", "text").join(if_small(picked), F.col("doc_id") == F.col("_id")).withColumn("_w", words(F.lower("text")))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - 2, F.lit(1)))
    rows = rows.withColumn("_sign", F.array_min(F.transform(starts, lambda i: F.xxhash64(F.slice("_w", i, 3)))))
    first = W.partitionBy("_sign").orderBy(F.desc("toxic"), F.xxhash64("text"))  # within the bounded sample
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("text", "toxic")


def entries(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words and word beginnings with their documents by class: partial counts, handed on whenever ``HELD_COUNTS`` are held."""
    counts: Counter = Counter()

    def handed() -> pd.DataFrame:
        return pd.DataFrame({"w": [w for w, _ in counts], "t": [t for _, t in counts], "n": list(counts.values())}).astype({"w": "object", "t": "int32", "n": "int64"})

    for part in parts:
        for text, toxic in zip(part["text"], part["toxic"]):
            seen = set(WORD.findall((text or "").lower()))
            seen |= {w[:n] + "*" for w in seen for n in STEMS if len(w) > n}
            counts.update((w, int(toxic)) for w in seen)
            if len(counts) >= HELD_COUNTS:
                yield handed()
                counts.clear()
    yield handed()


def learn(train: DataFrame) -> Grammar:
    """Entries by document frequency in both classes, then the curve on the evidence of the training rows."""
    with small_batches(train.sparkSession):
        return _learned(durable(train))  # at most SAMPLE documents and their copies


def _learned(train: DataFrame) -> Grammar:
    totals = {r[0]: r[1] for r in train.groupBy(F.col("toxic").cast("int")).count().collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return Grammar({w: SEED_WEIGHT for w in INSULTS})
    counts = train.mapInPandas(entries, "w string, t int, n long").groupBy("w").agg(F.sum(F.expr("if(t = 1, n, 0)")).alias("p"), F.sum(F.expr("if(t = 1, 0, n)")).alias("q"))
    odds = F.log((F.col("p") + 0.5) / (pos + 1.0)) - F.log((F.col("q") + 0.5) / (neg + 1.0))
    best = counts.withColumn("o", odds).where((F.col("p") >= MIN_DOCS) & (F.col("o") >= MIN_ODDS))
    rows = best.orderBy(F.desc(F.col("o") * F.sqrt("p")), "w").limit(MAX_ENTRIES).collect()  # the model's size is a parameter
    g = Grammar({r.w: r.o for r in rows if not r.w.endswith("*")}, {r.w[:-1]: r.o for r in rows if r.w.endswith("*")})
    seeds = {r.w: r for r in counts.where(F.col("w").isin(*INSULTS)).collect()}
    for w in INSULTS:  # unseen seeds keep a fixed weight; seen ones answer to the labels
        if w not in seeds:
            g.words.setdefault(w, SEED_WEIGHT)

    def features(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(int(t), *[round(f, 2) for f in _features(x, g)[1:]]) for x, t in zip(part["text"], part["toxic"])], columns=["t", "a", "b"])

    grid = train.mapInPandas(features, "t int, a double, b double").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("p")).collect()
    g.curve = _logistic([((1.0, r.a, r.b), r.n, r.p) for r in sorted(grid)])
    return g


def _logistic(rows: list[tuple[tuple[float, float, float], int, int]], rounds: int = 25, ridge: float = 0.05) -> tuple[float, float, float]:
    """Newton steps for a weighted logistic curve with three terms."""
    w = [0.0, 0.0, 0.0]
    for _ in range(rounds):
        grad, hess = [-ridge * x for x in w], [[ridge * (i == j) for j in range(3)] for i in range(3)]
        for x, n, p in rows:
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x))))))
            for i in range(3):
                grad[i] += x[i] * (p - n * q)
                for j in range(3):
                    hess[i][j] += n * q * (1 - q) * x[i] * x[j]
        step = _solve(hess, grad)
        w = [a + max(-2.0, min(2.0, b)) for a, b in zip(w, step)]
    return w[0], w[1], w[2]


def _solve(m: list[list[float]], v: list[float]) -> list[float]:
    """Three linear equations by elimination; ``m`` is positive definite."""
    a = [[*row, x] for row, x in zip(m, v)]
    for i in range(3):
        for j in range(i + 1, 3):
            f = a[j][i] / a[i][i]
            a[j] = [x - f * y for x, y in zip(a[j], a[i])]
    out = [0.0] * 3
    for i in (2, 1, 0):
        out[i] = (a[i][3] - sum(a[i][j] * out[j] for j in range(i + 1, 3))) / a[i][i]
    return out


def scorer(g: Grammar):
    """Vectorised column function of the text."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([score_text(t, g) for t in texts], dtype="float64")

    return score


def scored(docs: DataFrame, g: Grammar) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = docs.select("doc_id", (fold("doc_id", HELD) == 0).alias("held_out"), scorer(g)(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepts(text: Column, g: Grammar) -> Column:
    """True for texts that are not toxic."""
    return scorer(g)(text) < 0.5
