"""Quality rules: hashed n-gram log-likelihood ratio of trusted target against raw corpus, beside fixed base rules.

Word unigrams and bigrams are hashed into a fixed number of buckets. Two multinomials over the buckets, one of the
trusted documents and one of all documents, give each bucket a log ratio. A document's score is the mean ratio of its
n-grams, and one cut, calibrated on the labelled documents, decides on every document.

Defined cases: null text is empty text; a document without words scores 0 and fails the base rules; repeated rows are
judged alike and all returned; a document is trusted if all its labels say quality 1; without labels of both classes the
cut is lowest, so only the base rules decide; extra columns of the inputs are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import NOT_SPACE, best_cut, dense, if_small, let, words
from tablewright.session import durable

BUCKETS = 10_000
SMOOTHING = 1.0
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
BINS_PER_UNIT = 500  # resolution of the cut


@dataclass
class Ratio:
    """Model: one row with the log ratio of every bucket, and the cut (None: keep all that pass the base rules)."""

    table: DataFrame
    cut: float | None = None


def _hashes(docs: DataFrame, *keep: str) -> DataFrame:
    split = docs.select(*keep, "text", words(F.col("text")).alias("_words"))
    return split.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))


def _buckets(h: Column, m: int) -> Column:
    one = F.transform(h, lambda x: F.pmod(x, F.lit(m)))
    two = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.pmod(F.xxhash64(x, F.get(h, i + 1)), F.lit(m)))
    return F.concat(one, two)


def _repeat_words(keys: Column) -> Column:
    """Words covered by windows whose key occurs twice or more; ``keys`` is one 64-bit key per window start."""
    at = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["k"] == x["k"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False)))
        starts = F.sort_array(F.transform(again, lambda x: x["i"]))
        return F.transform(F.array(starts), lambda p: F.aggregate(
            F.transform(p, lambda v, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - v, F.lit(WINDOW)))), F.lit(0), lambda a, v: a + v))[0]

    repeated = F.transform(F.array(at), covered)[0]
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), repeated).otherwise(0).cast("bigint")


def base_rules(hashed: DataFrame, *keep: str) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of rows of ``_hashes``."""
    n = F.size("_words")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NOT_SPACE))
    keys = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("_h", i, WINDOW))))
    wide = hashed.select(*keep, "_h", "_words", text.alias("text"), lines.alias("_lines"), F.coalesce(keys, F.array().cast("array<bigint>")).alias("_keys"))
    out = wide.select(
        *keep, "_h", n.cast("bigint").alias("n_words"),
        F.char_length(F.translate("text", " \t\n\x0b\f\r", "")).cast("bigint").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col("_keys")).alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _trusted(labels: DataFrame) -> DataFrame:
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    return if_small(known.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_good")))


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> Ratio:
    """Both multinomials over all documents; at most ``buckets`` counts leave each task."""
    joined = docs.select("doc_id", "text").join(_trusted(labels), F.col("doc_id") == F.col("_id"), "left")
    grams = _hashes(joined, "_good").select(F.coalesce(F.col("_good") == 1, F.lit(False)).cast("int").alias("_t"), F.explode(_buckets(F.col("_h"), buckets)).alias("_at"))
    counts = grams.groupBy("_at").agg(F.sum("_t").alias("t"), F.count(F.lit(1)).alias("r"))
    counts = durable(counts)  # at most one row per bucket
    total = counts.agg(F.sum("t").alias("_nt"), F.sum("r").alias("_nr"))
    every = counts.sparkSession.range(buckets).withColumnRenamed("id", "_at").join(counts, "_at", "left").crossJoin(F.broadcast(total))  # one row
    a = smoothing

    def log_share(n: str, of: str) -> Column:
        return F.log((F.coalesce(F.col(n), F.lit(0)) + a) / (F.coalesce(F.col(of), F.lit(0)) + a * buckets))

    return Ratio(durable(dense(every.select("_at", (log_share("t", "_nt") - log_share("r", "_nr")).alias("_value")), buckets)))


def scored(docs: DataFrame, model: Ratio, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, the base rules and ``score`` of every document; one pass, no shuffle."""
    base = base_rules(_hashes(docs, "doc_id"), "doc_id")
    grams = _buckets(F.col("_h"), buckets)

    def mean(ratio: Column) -> Column:
        return F.aggregate(F.col("_grams"), F.lit(0.0), lambda a, b: a + F.get(ratio, b.cast("int"))) / F.greatest(F.size("_grams"), F.lit(1))

    # the optimiser folds this column into its one use, so the model is not copied into rows
    ready = base.withColumn("_grams", grams).withColumn("_ratio", model.table.scalar())
    return ready.select(*[c for c in base.columns if c != "_h"], let(F.col("_ratio"), mean).alias("score"))


def calibrated(narrow: DataFrame, labels: DataFrame, model: Ratio) -> Ratio:
    """The cut that parts labelled documents best among those that pass the base rules."""
    known = narrow.where("NOT base_failed").join(_trusted(labels), F.col("doc_id") == F.col("_id"))
    bins = known.groupBy(F.floor(F.col("score") * BINS_PER_UNIT).alias("b")).agg(F.count_if(F.col("_good") == 1).alias("p"), F.count_if(F.col("_good") != 1).alias("n"))
    at = best_cut([tuple(r) for r in bins.collect()])  # bounded: ratios, hence bins, have a bounded range
    return Ratio(model.table, None if at is None else at / BINS_PER_UNIT)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with base rules, ``score`` and ``kept``."""
    model = fit(docs, labels)
    narrow = durable(scored(docs, model))
    cut = calibrated(narrow, labels, model).cut
    good = F.lit(True) if cut is None else F.col("score") >= cut
    return narrow.withColumn("kept", ~F.col("base_failed") & good)
