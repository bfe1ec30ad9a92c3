"""Language ID by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (1 to 3, within words, a blank at both word ends), by
rank. A text's own most frequent n-grams are compared with each profile by the out-of-place distance: the sum of rank
differences, with the profile's length for an n-gram that it lacks. The nearest profile names the language.

Profiles are counted over the whole texts of all learning rows: each task counts n-grams by language, Spark sums the
counts. What reaches the driver is ``PROFILE`` rows for each language label.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is every text if nothing could be learned; ties go to
the label that is first by code point; tied n-grams rank by code point; repeated rows are judged alike; lang, source
and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablewright.llm.common import fold

HELD, FOLDS = 1, 3
PROFILE = 400
SYMBOL_BITS = 21  # a code point
CHUNK = 1 << 18  # code points counted at a time, so memory follows the chunk, not the text


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text; everything that is no letter becomes a blank, runs of blanks one."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    ascii_letter = (code >= 97) & (code <= 122)
    other = code >= 170
    if other.any():
        high = np.unique(code[other])
        letters = np.array([c for c in high.tolist() if chr(c).isalpha()], dtype=np.int64)
        ascii_letter |= np.isin(code, letters)
    code = np.where(ascii_letter, code, 32)
    if not ascii_letter.any():
        return code[:0]
    blank = code == 32
    keep = ~(blank & np.concatenate(([True], blank[:-1])))
    return np.concatenate(([32], code[keep], [32]) if not blank[-1] else ([32], code[keep]))


def _grams(code: np.ndarray) -> np.ndarray:
    """One number for each 1-, 2- and 3-gram without an inner blank; blanks alone are left out."""
    a, b, c = code[:-2], code[1:-1], code[2:]
    one = code[code != 32]
    two = (code[:-1] << SYMBOL_BITS) | code[1:]
    three = (((a << SYMBOL_BITS) | b) << SYMBOL_BITS) | c
    return np.concatenate((one, two, three[b != 32]))


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, their counts) of a whole text, n-grams ascending."""
    code = _letters(text or "")
    if not len(code):
        return code, code
    if len(code) <= CHUNK:
        return np.unique(_grams(code), return_counts=True)
    keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
    for at in range(0, len(code) - 2, CHUNK):
        part = code[at:at + CHUNK + 2]
        grams = _grams(part)
        k, n = np.unique(grams, return_counts=True)
        if at + CHUNK + 2 < len(code):  # the two shared code points and their pair count in the next chunk
            for g in (*part[-2:][part[-2:] != 32].tolist(), int((part[-2] << SYMBOL_BITS) | part[-1])):
                n[np.searchsorted(k, g)] -= 1
        both, where = np.unique(np.concatenate((keys, k)), return_inverse=True)
        keys, sums = both, np.bincount(where, np.concatenate((sums, n)), len(both)).astype(np.int64)
    return keys[sums > 0], sums[sums > 0]


def ranked(keys: np.ndarray, n: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties by code point."""
    return keys[np.lexsort((keys, -n))[:size]]


def learn(docs: DataFrame, size: int = PROFILE) -> list[tuple[str, np.ndarray]]:
    """(label, ranked n-grams) in order of the label."""

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}

        def merged(pieces: list) -> tuple[np.ndarray, np.ndarray]:
            keys, where = np.unique(np.concatenate([p[0] for p in pieces]), return_inverse=True)
            return keys, np.bincount(where, np.concatenate([p[1] for p in pieces]), len(keys)).astype(np.int64)

        for part in parts:
            for text, lang in zip(part["text"], part["lang"]):
                held.setdefault(lang, []).append(counts(text))
                if len(held[lang]) > 256:
                    held[lang] = [merged(held[lang])]
        for lang, pieces in held.items():
            keys, n = merged(pieces)
            yield pd.DataFrame({"lang": lang, "gram": keys, "n": n})

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", FOLDS) != HELD)).select("text", "lang")
    total = rows.mapInPandas(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the best of every hash part first, so that no task sorts all n-grams of a language
    first = W.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(64))).orderBy(F.desc("n"), "gram")
    best = total.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= size).drop("_r")
    best = best.withColumn("_r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("_r") <= size)
    profiles: dict[str, list[tuple[int, int]]] = {}
    for r in best.collect():
        profiles.setdefault(r["lang"], []).append((r["_r"], r["gram"]))
    return [(k, np.array([g for _, g in sorted(v)], dtype=np.int64)) for k, v in sorted(profiles.items())]


def distances(text: str | None, profiles: list[tuple[str, np.ndarray]], size: int = PROFILE) -> np.ndarray | None:
    """Out-of-place distance to each profile over that of a text that shares no n-gram; None without letters."""
    keys, n = counts(text)
    if not len(keys):
        return None
    own = ranked(keys, n, size)
    out = []
    for _, profile in profiles:
        order = np.argsort(profile)
        at = np.minimum(np.searchsorted(profile[order], own), len(profile) - 1)
        hit = profile[order][at] == own
        apart = np.where(hit, np.abs(order[at] - np.arange(len(own))), size)
        out.append(apart.sum() / (size * len(own)))
    return np.array(out)


def predict(text: str | None, profiles: list[tuple[str, np.ndarray]], size: int = PROFILE) -> tuple[str, float]:
    """(label, score); the score is the runner-up's share of the two smallest distances, 1 where there is one label."""
    d = distances(text, profiles, size) if profiles else None
    if d is None:
        return "und", 0.0
    best = int(d.argmin())
    if len(d) == 1:
        return profiles[0][0], 1.0
    second = np.partition(d, 1)[1]
    return profiles[best][0], float(second / (d[best] + second)) if second else 0.5


def identify(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    profiles = learn(docs, size)

    @F.pandas_udf("lang_pred string, score double")
    def judged(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([predict(t, profiles, size) for t in texts], columns=["lang_pred", "score"])

    out = docs.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), judged("text").alias("_j"))
    return out.select("doc_id", "held_out", "_j.lang_pred", "_j.score")
