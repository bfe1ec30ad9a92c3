"""Grammar cases, learning only from the right rows, and held-out accuracy."""

import zlib
from collections import Counter

import pandas as pd

from tablewright.llm import toxicity

SEEDS = toxicity.Grammar({w: toxicity.SEED_WEIGHT for w in toxicity.INSULTS})


def weight(text):
    return toxicity.evidence(text, SEEDS)[0]


def test_clauses():
    plain = weight("the man is an idiot today")
    assert plain == toxicity.SEED_WEIGHT
    assert weight("you are such an idiot") > plain
    assert weight("it is not an idiot here") < plain
    assert weight("he said idiot to it") < plain
    assert weight("we will kill you") > weight("we will kill it")
    assert weight("not good. idiot here") == plain  # negation ends with its clause
    assert weight("the quiet river") == weight("") == weight(None) == 0
    assert weight("Idiot, MORON!") == 2 * plain


def test_score_bounds():
    assert 0 <= toxicity.score_text(None, SEEDS) < 0.5 <= toxicity.score_text("idiot moron scum " * 30, SEEDS) <= 1


def test_held_out(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.scored(docs, toxicity.learn(toxicity.labelled(docs, labels)))
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = out.collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5)
    held = [(toxic[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    pos, neg = [s for t, s in held if t], [s for t, s in held if not t]
    assert sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) >= 0.8
    assert sum(s >= 0.5 for s in neg) <= 0.05 * len(neg)


def test_training_rows(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)] + [(3, "again"), (None, "x"), (7, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(50)] + [(None, 1, 1), (2, 1, None)], "doc_id bigint, quality int, toxic int")
    got = toxicity.labelled(docs, labels).collect()
    want = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5]
    assert len(got) == len(want) + (3 in want) + (7 in want)


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    g = toxicity.learn(toxicity.labelled(odd, labels))
    out = toxicity.scored(odd, g).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in out)
    assert toxicity.scored(nothing, g).count() == 0


def test_counts_handed_on(monkeypatch):
    """A task never holds the words of all its documents; the partial counts add up."""
    texts = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)} shared alone" for i in range(400)] + [None]
    parts = [pd.DataFrame({"text": texts[:200], "toxic": [i % 2 for i in range(200)]}), pd.DataFrame({"text": texts[200:], "toxic": [i % 2 for i in range(201)]})]
    whole = list(toxicity.entries(iter(parts)))
    monkeypatch.setattr(toxicity, "HELD_COUNTS", 50)
    some = list(toxicity.entries(iter(parts)))
    assert max(map(len, some)) < 70 and len(some) > len(whole) == 1

    def summed(frames):
        out = Counter()
        for f in frames:
            for w, t, n in f.itertuples(index=False):
                out[w, t] += n
        return out

    assert summed(some) == summed(whole) and summed(whole)["shared", 0] == 200
