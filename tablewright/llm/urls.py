"""URL filters: prefix rules first, else the ratio of two character language models.

Two smoothed variable-order Markov models of URL characters, one of accepted and one of rejected URLs (those that a rule
decides), are interpolated over contexts of 3, 2, 1 and 0 characters. The log ratio of every (context, character) fills
one dense array, whose size is fixed by the alphabet. A URL's score is its summed ratio over its length, against a cut
calibrated on a fold of the rule-decided URLs that the models have not seen.

Defined cases: a null url or one without "://" has empty host and path, no rule, and is judged by the models (empty text
scores 0); upper case A-Z and a-z are one symbol, digits are one, anything else outside the alphabet is one; repeated rows are
judged alike; without rule-decided URLs of both classes the cut is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import best_cut, dense, fold, let
from tablewright.session import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
ALPHABET = LOWER + "0/.-:"  # with "anything else" 32 symbols
SYMBOLS, ORDER = 32, 4
CELLS = SYMBOLS**ORDER
BINS_PER_UNIT = 200
FOLDS = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """host, path, rule (the longest that fits, else null) and its verdict ``_ruled``."""
    host, path = host_and_path(F.col("url"))
    split = pages.withColumn("host", host).withColumn("path", path)
    rule = F.lit(None).cast("string")
    ruled = F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the last that fits is the longest
        at = text.index("/")
        fits = ((F.col("host") == text[:at]) | F.col("host").endswith("." + text[:at])) & F.col("path").startswith(text[at:])
        rule, ruled = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
    return split.withColumn("rule", rule).withColumn("_ruled", ruled)


def _codes(url: Column) -> Column:
    plain = F.regexp_replace(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), "[0-9]", "0")
    chars = F.filter(F.split(plain, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.call_function("locate", c, F.lit(ALPHABET)))


def _cells(codes: Column) -> Column:
    """Per character the number of its (context, character); before the start stands symbol 0."""
    def cell(c: Column, x: Column, i: Column) -> Column:
        total = x.cast("bigint")
        for back in range(1, ORDER):
            total = total + F.coalesce(F.get(c, i - back), F.lit(0)) * SYMBOLS**back
        return total

    return let(codes, lambda c: F.transform(c, lambda x, i: cell(c, x, i)))


def fit(ruled: DataFrame) -> DataFrame:
    """One row with the log ratio of every cell, from ``url`` and ``_ruled``."""
    grams = ruled.select((F.col("_ruled") == "allow").cast("int").alias("_a"), F.explode(_cells(_codes(F.col("url")))).alias("_cell"))
    counts = durable(grams.groupBy("_cell").agg(F.sum("_a").alias("a"), F.sum(1 - F.col("_a")).alias("b")))
    table = None
    for order in range(1, ORDER + 1):
        size = SYMBOLS**order
        seen = counts.groupBy((F.col("_cell") % size).alias("_at")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        context = F.expr(f"_at div {SYMBOLS}")
        of = seen.groupBy(context.alias("_c")).agg(*[e.alias(n) for c in "ab" for e, n in ((F.sum(c), f"n{c}"), (F.count_if(F.col(c) > 0), f"t{c}"))])
        # a context is written oldest character first, so the shorter context drops the leading symbol
        cell = counts.sparkSession.range(0, size, 1, 4 if order < ORDER else 8).withColumnRenamed("id", "_at").withColumn("_c", context)
        cell = cell.join(seen, "_at", "left").join(of, "_c", "left")
        if table is None:
            cell = cell.withColumns({"qa": F.lit(1.0 / SYMBOLS), "qb": F.lit(1.0 / SYMBOLS)})
        else:
            lower = table.select(F.col("_at").alias("_low"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
            cell = cell.withColumn("_low", F.col("_at") % (size // SYMBOLS)).join(lower, "_low")

        def smoothed(c: str) -> Column:  # Witten-Bell
            n, t, k = (F.coalesce(F.col(x), F.lit(0)) for x in (f"n{c}", f"t{c}", c))
            return F.when(n + t > 0, (k + t * F.col(f"q{c}")) / (n + t)).otherwise(F.col(f"q{c}"))

        table = cell.select("_at", smoothed("a").alias("pa"), smoothed("b").alias("pb"))
    return durable(dense(table.select("_at", (F.log("pa") - F.log("pb")).alias("_value")), CELLS))


def with_score(pages: DataFrame, model: DataFrame) -> DataFrame:
    """Summed log ratio of ``url`` over its length, 0 for an empty text."""
    def mean(cells: Column, ratio: Column) -> Column:
        return F.aggregate(cells, F.lit(0.0), lambda a, c: a + F.get(ratio, c.cast("int"))) / F.greatest(F.size(cells), F.lit(1))

    # the optimiser folds _ratio into its one use, so the model is not copied into rows
    ready = pages.withColumn("_cells", _cells(_codes(F.col("url")))).withColumn("_ratio", model.scalar())
    return ready.withColumn("score", let(F.col("_ratio"), lambda ratio: mean(F.col("_cells"), ratio))).drop("_cells", "_ratio")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (6 digits) of every page."""
    marked = with_rule(pages.select("page_id", "url"), rules)
    known = marked.where("_ruled IS NOT NULL")
    held = fold("url", FOLDS) == 0
    trial = fit(known.where(~held))
    bins = with_score(known.where(held), trial).select(F.floor(F.col("score") * BINS_PER_UNIT).alias("b"), (F.col("_ruled") == "allow").alias("_ok"))
    bins = bins.groupBy("b").agg(F.count_if("_ok").alias("p"), F.count_if(~F.col("_ok")).alias("n"))
    at = best_cut([tuple(r) for r in bins.collect()])  # bounded: ratios have a bounded range
    cut = 0.0 if at is None else at / BINS_PER_UNIT
    out = with_score(marked, fit(known))
    by_model = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_ruled", by_model).alias("verdict"), F.round("score", 6).alias("score"))
