"""Benchmark decontamination by template windows.

Text becomes a sequence of words; numbers, names (runs of capitalised words inside a sentence) and units (after a number) become
one typed placeholder each, the rest is lower-cased. Windows of ``WINDOW`` template words of documents are hash-joined with those of
benchmark items. Matches of a document and an item whose offsets follow each other by at most ``SLACK`` words are one place: a word put in or left out moves the offset only.

A place counts if its windows cover at least ``COVERAGE`` of the item's windows, or ``WORDS`` of the words in them (one changed word breaks ``WINDOW`` windows, which
in a short item are many). Then the words behind aligned placeholders are compared. A re-parameterised question replaces equal slots by equal values: each further value of
one slot is a conflict, and at most ``CONFLICTS`` of the pairs may be. If at least ``VERBATIM`` of the pairs are unchanged, the place counts whatever the others say.

The documents are read once and never shuffled as text: a fixed-size table of the first three words of benchmark windows thins
the windows inside each row, and only the remaining ones are joined, exactly.

Defined cases: null or empty texts on either side match nothing; a text shorter than a window is one window and matches only whole
texts; windows with fewer than ``LITERALS`` plain words are left out unless an item has no other; repeated rows give repeated
results, repeated items count once per item_id and text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.llm.common import dense, if_small, let
from tablewright.session import durable

WINDOW, LITERALS, COVERAGE, WORDS = 8, 4, 0.5, 0.6
SLACK, CONFLICTS, VERBATIM = 6, 0.5, 2 / 3
CELLS = 1 << 18  # of the table that thins windows; a fuller table thins less and loses nothing
# fixed values
UNITS = ("kg", "g", "mg", "lb", "lbs", "oz", "km", "m", "cm", "mm", "mile", "miles", "ft", "feet", "inch", "inches", "yards", "l", "ml", "liter", "liters",
         "litre", "litres", "gallons", "s", "sec", "seconds", "min", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year",
         "years", "dollar", "dollars", "cent", "cents", "euro", "euros", "pounds", "percent", "degrees", "mph", "kmh", "euros", "metros", "horas", "tage", "stunden", "jours", "heures")
NAME, UNIT = "\u0001", "\u0002"  # marks in front of a word
MARK = " " + NAME
INSIDE = r" (?<=[\p{L}\p{N},;:)] )(?=\p{Lu}\p{Ll})"  # the space first: other characters fail at once
# possessive: the same matches, but a word of any length takes no stack for its parts
TOKEN = r"\x01\p{L}+(?:(?:['’-]| \x01)\p{L}+)*+|\p{L}+(?:['’-]\p{L}+)*+|[0-9]+(?:[.,:/][0-9]+)*+"


def _tokens(text: Column) -> Column:
    """Lower-cased words with their marks."""
    raw = F.regexp_extract_all(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), INSIDE, MARK)), F.lit(TOKEN), F.lit(0))

    def marked(a: Column) -> Column:
        def unit(w: Column, i: Column) -> Column:
            after_number = F.coalesce(_number(F.get(a, i - 1)), F.lit(False))
            return F.when(after_number & w.isin(*UNITS), F.concat(F.lit(UNIT), w)).otherwise(w)

        return F.transform(a, unit)

    return F.when(text.rlike("[0-9]"), let(raw, marked)).otherwise(raw)


def _number(w: Column) -> Column:
    return (w >= "0") & (w < ":")  # begins with a digit


def _slot(w: Column) -> Column:
    return w.startswith(NAME) | w.startswith(UNIT) | _number(w)


def _template(w: Column) -> Column:
    # marks and digits come before the letters, so plain words take one comparison
    return F.when(w >= "a", w).when(w.startswith(NAME), "<name>").when(w.startswith(UNIT), "<unit>").when(_number(w), "<number>").otherwise(w)


def _hashed(df: DataFrame) -> DataFrame:
    """Adds _raw (words) and _t (hash of each template word)."""
    split = df.withColumn("_raw", _tokens(F.col("text")))
    return split.withColumn("_t", F.transform("_raw", lambda w: F.xxhash64(_template(w))))


def _starts(t: Column, window: int) -> Column:
    """Window starts; a shorter text has one, an empty one none."""
    some = F.sequence(F.lit(0), F.greatest(F.size(t) - window, F.lit(0)))
    return F.when(F.size(t) > 0, some).otherwise(F.array().cast("array<int>"))


def _first(t: Column, i: Column) -> Column:
    """Cell of a window's first three words; their hashes need no second one."""
    later = [F.call_function("shiftleft", F.coalesce(F.get(t, i + k), F.lit(0).cast("bigint")), F.lit(k)) for k in (1, 2)]
    return F.get(t, i).bitwiseXOR(later[0]).bitwiseXOR(later[1]).bitwiseAND(F.lit(CELLS - 1)).cast("int")


def _piece(t: Column, raw: Column, i: Column, window: int) -> Column:
    return F.struct(F.xxhash64(F.slice(t, i + 1, window)).alias("k"), i.alias("i"), F.slice(raw, i + 1, window).alias("w"), _first(t, i).alias("first"))


def _covered(starts: Column, window: Column) -> Column:
    """Places of the words in windows of an item."""
    return F.array_distinct(F.flatten(F.transform(starts, lambda j: F.sequence(j, j + window - 1))))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, k, j, words, n (the item's number of windows) and n_words (of the words in them)."""
    items = benchmark.select("item_id", "text").distinct().select("item_id", F.xxhash64("text").alias("_item"), "text")
    t, raw = F.col("_t"), F.col("_raw")
    cut = _hashed(items).select("item_id", "_item", F.explode(F.transform(_starts(t, window), lambda i: _piece(t, raw, i, window))).alias("p"))
    rows = cut.select("item_id", "_item", "p.k", F.col("p.i").alias("j"), F.col("p.w").alias("words"), "p.first")
    rows = rows.withColumn("_plain", (F.size(F.filter("words", lambda w: ~_slot(w))) >= LITERALS).cast("int"))
    item = W.partitionBy("item_id", "_item")  # one item's windows
    rows = rows.withColumn("_some", F.sum("_plain").over(item)).withColumn("_all", F.count(F.lit(1)).over(item)).where((F.col("_plain") == 1) | (F.col("_some") == 0))
    rows = rows.withColumn("n_words", F.size(_covered(F.collect_set("j").over(item), F.max(F.size("words")).over(item))))
    return rows.select("item_id", "_item", "k", "j", "words", "first", "n_words", F.when(F.col("_some") > 0, F.col("_some")).otherwise(F.col("_all")).alias("n"))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, words: float = WORDS) -> DataFrame:
    """doc_id, th (hash of the text), item_id, n_windows, matched, coverage, n_slots, n_changed for contaminated documents."""
    items = durable(item_windows(benchmark, window))
    table = dense(items.select(F.col("first").alias("_at"), F.lit(1.0).alias("_value")).distinct(), CELLS)
    table = durable(table.select(F.transform("_dense", lambda x: x.cast("tinyint")).alias("_dense")))  # small enough for a processor's cache
    # the optimiser folds _seen into its one use, so the table is not copied into rows
    cut = _hashed(docs.select("doc_id", "text")).withColumn("_seen", table.scalar())
    t, raw = F.col("_t"), F.col("_raw")

    thinned = F.filter(_starts(t, window), lambda i: F.get(F.col("_seen"), _first(t, i)) > 0)
    some = cut.select("doc_id", F.xxhash64("text").alias("th"), "_raw", "_t", thinned.alias("_some"))
    hits = some.select("doc_id", "th", F.explode(F.transform("_some", lambda i: _piece(t, raw, i, window))).alias("h")).select("doc_id", "th", "h.k", "h.i", "h.w")
    joined = hits.join(if_small(items, 200_000), "k")
    slots = F.filter(F.zip_with("w", "words", lambda d, b: F.struct(b.alias("b"), d.alias("d"))), lambda p: _slot(p["d"]))
    of = ["doc_id", "th", "item_id", "_item", "n", "n_words"]
    at = joined.select(*of, "j", (F.col("i") - F.col("j")).alias("_off"), F.size("words").alias("_w"), slots.alias("_slots"))
    runs = at.groupBy(*of, "_off").agg(F.collect_set("j").alias("_js"), F.max("_w").alias("_w"), F.array_distinct(F.flatten(F.collect_set("_slots"))).alias("_ps"))  # bounded by the item's length
    along = W.partitionBy(*of).orderBy("_off")  # the offsets of one text and one item
    apart = F.coalesce(F.col("_off") - F.lag("_off").over(along) > SLACK, F.lit(True)).cast("int")
    placed = runs.withColumn("_new", apart).withColumn("_place", F.sum("_new").over(along))
    places = placed.groupBy(*of, "_place").agg(F.array_distinct(F.flatten(F.collect_set("_js"))).alias("_js"), F.max("_w").alias("_w"), F.array_distinct(F.flatten(F.collect_set("_ps"))).alias("_pairs"))
    slots_of = F.size(F.array_distinct(F.transform("_pairs", lambda p: p["b"])))
    changed = F.size(F.filter("_pairs", lambda p: p["b"] != p["d"]))
    pairs = F.size("_pairs")
    consistent = (pairs - slots_of <= CONFLICTS * pairs) | (pairs - changed >= VERBATIM * pairs)
    places = places.withColumns({"matched": F.size("_js"), "coverage": F.size("_js") / F.col("n"), "_words": F.size(_covered(F.col("_js"), F.col("_w"))) / F.col("n_words")})
    found = places.where(((F.col("coverage") >= coverage) | (F.col("_words") >= words)) & consistent)
    row = F.struct("coverage", (-changed).alias("same"), F.col("matched"), F.col("n"), pairs.alias("n_slots"))
    best = found.groupBy("doc_id", "th", "item_id").agg(F.max(row).alias("r"))
    return best.select("doc_id", "th", "item_id", F.col("r.n").cast("bigint").alias("n_windows"), F.col("r.matched").cast("bigint").alias("matched"), "r.coverage",
                       F.col("r.n_slots").cast("bigint").alias("n_slots"), (-F.col("r.same")).cast("bigint").alias("n_changed"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each contaminated document and item."""
    return matches(docs, benchmark).drop("th")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without benchmark passages; the verdict follows the text, so all its copies go."""
    bad = durable(matches(docs, benchmark).select("th").distinct())
    return docs.join(if_small(bad), F.xxhash64(docs["text"]) == bad["th"], "left_anti")  # docs may hold any column names
