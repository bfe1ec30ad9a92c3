"""Planted, re-parameterised and inconsistent questions, and exact containment on the given table."""

import random
import re

import regex
from conftest import prose

from tablewright.llm import contamination

ITEM = "A train leaves Paris at 40 km per hour and another leaves from Berlin with Anna inside at 60 km per hour; when do they meet"
BENCH = "item_id bigint, text string"


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    return contamination.report(d, spark.createDataFrame(items, BENCH)).collect()


def test_whole_table(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    plain = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    items = [(r["item_id"], plain(r["text"])) for r in bench.collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in items if t in plain(r["text"])}
    assert {(r["doc_id"], r["item_id"]) for r in contamination.report(docs, bench).collect()} == want


def test_parameters_and_consistency(spark):
    docs = [(1, prose(1, 50) + ". " + ITEM + ". " + prose(2, 50)), (2, prose(3, 50)),
            (3, "So it is. " + ITEM.replace("Paris", "London").replace("Berlin", "Madrid").replace("40", "75").replace("60", "90").replace("Anna", "Otto")),
            (4, ITEM.replace("Berlin", "Paris")),  # two slots take one value
            (5, " ".join(ITEM.split()[:8])), (None, ITEM), (6, None), (7, ""), (1, prose(1, 50) + ". " + ITEM + ". " + prose(2, 50))]
    got = {(r["doc_id"], r["item_id"]): r for r in run(spark, docs, [(7, ITEM), (8, None), (9, ""), (7, ITEM), (10, "Short one")])}
    assert set(got) == {(1, 7), (3, 7), (4, 7), (None, 7)}
    assert got[1, 7]["n_changed"] == 0 and got[1, 7]["n_slots"] >= 4
    assert got[3, 7]["n_changed"] >= 5


FORMS = [ITEM, ITEM.replace("Paris", "New York"), ITEM.replace("Anna", "Mary Ann"), ITEM.replace("Berlin", "New Delhi"), ITEM.replace("60", "40"), ITEM.replace("Berlin", "Paris"),
         ITEM.replace("another", "a second"), ITEM.replace("train", "tram"), ITEM.replace("inside ", ""), ITEM.replace("and another", "and then another")]
FRAMES = ["A train leaves Paris at 40 km per hour and reaches the coast before noon if nothing on the long line is broken today",
          "One bus waits in Rome while another leaves from Berlin with Anna inside, so who of them pays for the tickets of all the others",
          "Nobody knew when do they meet or why a train leaves at all, least of all Otto, who had 60 km to walk home that night"]


def test_ten_forms_of_a_question(spark):
    """Verbatim, other values of one or two words, two slots of one value, small edits; and unrelated questions that share a frame with it."""
    docs = [(i, prose(i, 40) + ". " + f + ". " + prose(i + 50, 40)) for i, f in enumerate(FORMS + FRAMES)]
    assert {r["doc_id"] for r in run(spark, docs, [(1, ITEM)])} == set(range(len(FORMS)))


def test_conflicting_values(spark):
    """One slot with another value each time is no re-parameterised question, unless most slots are unchanged."""
    item = "first Anna took the old boat, then Anna sold the old boat, later Anna missed the old boat, and so Anna bought a new boat with 5 oars"
    same, mixed = item.replace("Anna", "Otto"), item
    for name in ("Otto", "Hugo", "Emil", "Karl"):
        mixed = mixed.replace("Anna", name, 1)
    docs = [(1, same), (2, mixed), (3, item.replace("Anna", "Otto", 1))]
    assert {r["doc_id"] for r in run(spark, docs, [(1, item)])} == {1, 3}


def plain_tokens(text):
    marked = regex.sub(contamination.INSIDE, contamination.MARK, text or "").lower()
    out = []
    for w in regex.findall(contamination.TOKEN, marked):
        after_number = bool(out) and out[-1][0] == "<number>"
        if w.startswith(contamination.NAME):
            out.append(("<name>", w))
        elif w[0] in "0123456789":
            out.append(("<number>", w))
        elif after_number and w in contamination.UNITS:
            out.append(("<unit>", w))
        else:
            out.append((w, w))
    return out


def plain_match(doc, item, size=8):
    """Every window of the document against every window of the item, then places, coverage and slots, in plain loops."""
    a, b = plain_tokens(doc), plain_tokens(item)
    windows = lambda t: {i: t[i:i + size] for i in range(max(1, len(t) - size + 1))} if t else {}
    marks = ("<name>", "<number>", "<unit>")
    kept = {j: w for j, w in windows(b).items() if sum(x not in marks for x, _ in w) >= 4} or windows(b)
    hits = [(i - j, j, w, kept[j]) for i, w in windows(a).items() for j in kept if [x for x, _ in w] == [x for x, _ in kept[j]]]
    covered = lambda js: {k for j in js for k in range(j, j + len(kept[j]))}
    places, last = [], None
    for off, j, w, v in sorted(hits, key=lambda h: h[0]):
        if last is None or off - last > 6:
            places.append([])
        places[-1].append((j, w, v))
        last = off
    for place in places:
        js = {j for j, _, _ in place}
        pairs = {(y, x) for _, w, v in place for (kind, x), (_, y) in zip(w, v) if kind in marks}
        conflicts, unchanged = len(pairs) - len({y for y, _ in pairs}), sum(x == y for y, x in pairs)
        if (len(js) >= 0.5 * len(kept) or len(covered(js)) >= 0.6 * len(covered(kept))) and (conflicts <= 0.5 * len(pairs) or unchanged >= 2 / 3 * len(pairs)):
            return True
    return False


def test_brute_force_alignments(spark):
    """Edited, cut and doubled questions against the plain version."""
    r = random.Random(3)
    items = [(1, ITEM), (2, prose(4, 30)), (3, "Bob buys 3 kg of green tea for 12 euros and Ida sells 5 kg of black tea for 20 euros, who of Bob and Ida gets more tea for 1 euro"), (4, "how many small birds sat under the old tree near 7 stones")]
    docs = []
    for i in range(120):
        words = r.choice(items)[1].split()
        for _ in range(r.randint(0, 5)):
            k = r.randrange(len(words))
            words[k:k + r.choice([0, 1, 1, 2])] = r.choice([["Karl"], ["New", "Rome"], ["9"], ["blue"], [], ["a", "very"], ["7", "km"]])
            words = words or ["x"]
        if r.random() < 0.2:
            words = words[:len(words) * 2 // 3] + prose(i, 5).split() + words[len(words) // 3:]
        docs.append((i, prose(i, 20) + " " + " ".join(words) + " " + prose(i + 50, 20)))
    want = {(i, k) for i, t in docs for k, item in items if plain_match(t, item)}
    assert {(x["doc_id"], x["item_id"]) for x in run(spark, docs, items)} == want and 30 < len(want) < 120


def test_clean_and_odd_rows(spark, odd, nothing):
    bench = spark.createDataFrame([(1, prose(2, 40)), (None, prose(3, 30)), (2, None)], BENCH)
    left = contamination.clean(odd, bench)
    assert left.columns == odd.columns
    assert sorted(repr(r["doc_id"]) for r in left.collect()) == sorted(repr(r["doc_id"]) for r in odd.collect() if r["doc_id"] not in (1, 2, None))
    assert contamination.report(nothing, bench).count() == 0
    assert contamination.report(odd, spark.createDataFrame([], BENCH)).count() == 0
    assert contamination.clean(odd, spark.createDataFrame([], BENCH)).count() == odd.count()


def test_words_of_many_parts(spark):
    """Names, hyphenated words and numbers of 20,000 parts take no deep stack, and the text around them is still judged."""
    long = ("and " + "Otto " * 20_000, "ab" + "-ab" * 20_000, "1" + ",234" * 20_000)
    docs = [(i, f"{x}. {ITEM}. {x}") for i, x in enumerate(long)] + [(9, " ".join(long))]
    assert {r["doc_id"] for r in run(spark, docs, [(1, ITEM)])} == {0, 1, 2}
