"""Cross-tokenizer alignment with exact-text deduplication.

Texts are shuffled by their full text, so each distinct text is tokenized by both tokenizers and aligned once. Both sides encode a space
and the text. Where a byte offset ends a token on both sides, a group ends; an A and a B token whose byte ranges overlap are a link. A
text's links are kept as counted id pairs; the corpus-wide count of a pair weighs each text by its number of copies. The measures of a
text are joined back to its documents by the SHA-256 of the text.

A worker encodes a chunk (a run of white space and the characters up to the next space) once and looks it up after that, within a bound on what it
remembers. This equals encoding the whole text where no token of either side goes on across the end of such a chunk, which is checked
on the tokenizer files; otherwise the whole text is the chunk.

Defined cases: texts that are null, empty or not given back byte for byte by both tokenizers have no tokens: zeros and an empty
``groups_sha256``; null and repeated doc_ids each get a row; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import if_small, small_batches
from tablewright.session import durable

CACHE = 300_000  # chunks that a worker remembers
CHARS = 1 << 21  # characters of texts aligned at a time
SHIFT = 32  # a pair of ids is one number, the A id above these bits
SPACE = "▁"  # stands for a space in a piece
COLUMNS = "key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<bigint>, times array<int>"
AFTER_SPACE = re.compile(r"\s ")
CUT = re.compile(r"(?<=\S)(?= )")


def _byte_letters() -> dict[str, int]:
    """The byte for each letter of a byte-level vocabulary: printable ones stand for themselves, the rest are numbered from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class ByteLevel:
    """Tokenizer A: ids of texts, and the bytes of each id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = _byte_letters()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = {i: bytes([letters[c] for c in token]) for token, i in vocabulary.items() if all(c in letters for c in token)}
        settings = json.loads(self.tokenizer.to_str())
        before = settings["pre_tokenizer"] or {}
        self.chunks = settings["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """Tokenizer B: ids of texts, to which it adds the space itself, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = {i: bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)}
        self.space = self.model.piece_to_id(SPACE)
        self.chunks = not any(SPACE in p.lstrip(SPACE) for p in pieces) and self.model.encode("a b") == self.model.encode("a") + self.model.encode("b")

    def encode(self, texts: list[str]) -> list[list[int]]:
        found = self.model.encode(texts, num_threads=1)
        return [ids if t else [self.space] for t, ids in zip(texts, found)]


def _sizes(table: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(max(table) + 1, dtype=np.int64)
    for i, b in table.items():
        out[i] = len(b)
    return out


class Aligner(dict):
    """Chunk (without the space in front) to its number; the arrays hold what each number stands for."""

    def __init__(self, path_a: str, path_b: str):
        super().__init__()
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.size_a, self.size_b = _sizes(self.a.bytes), _sizes(self.b.bytes)
        self.by_chunk = self.a.chunks and self.b.chunks
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.text: list[str] = []
        self.counts = np.zeros((0, 4), dtype=np.int64)  # A tokens, B tokens, groups, links
        self.bad = np.zeros(0, dtype=bool)
        self.pairs = np.zeros(0, dtype=np.int64)
        self.first = np.zeros(1, dtype=np.int64)

    def __missing__(self, chunk: str) -> int:
        i = self[chunk] = len(self)
        self.new.append(chunk)
        return i

    def split(self, text: str) -> list[str]:
        if not self.by_chunk:
            return [text]
        padded = " " + text
        # a space after white space does not end a chunk
        return [c[1:] for c in CUT.split(padded)] if AFTER_SPACE.search(padded) else text.split(" ")

    def learn(self) -> None:
        """Aligns the chunks that were asked for and are not known yet."""
        chunks, self.new = self.new, []
        if not chunks:
            return
        whole = [(" " + c).encode("utf-8", "surrogatepass") for c in chunks]
        ids_a, ids_b = self.a.encode(chunks), self.b.encode(chunks)
        get_a, get_b = self.a.bytes.get, self.b.bytes.get
        good = [b"".join([get_a(i, b"") for i in x]) == w and b"".join([get_b(i, b"") for i in y]) == w for x, y, w in zip(ids_a, ids_b, whole)]
        ids_a, ids_b = ([i if g else [] for i, g in zip(ids, good)] for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.array([i for ids in side for i in ids], dtype=np.int64) for side in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        chunk_ends = np.cumsum([len(w) if g else 0 for w, g in zip(whole, good)])
        cuts, shared = np.union1d(ends_a, ends_b), np.intersect1d(ends_a, ends_b, assume_unique=True)
        pairs = (flat_a[np.searchsorted(ends_a, cuts)] << SHIFT) | flat_b[np.searchsorted(ends_b, cuts)]
        links = np.diff(np.searchsorted(cuts, chunk_ends, "right"), prepend=0)
        until = np.searchsorted(shared, chunk_ends, "right")
        groups = np.diff(until, prepend=0)
        to_a, to_b = (np.searchsorted(ends, shared, "right").tolist() for ends in (ends_a, ends_b))
        text_a, text_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        written = [",".join(text_a[a:c]) + "|" + ",".join(text_b[b:d]) for a, b, c, d in zip([0, *to_a], [0, *to_b], to_a, to_b)]
        self.text += [";".join(written[x:y]) for x, y in zip([0, *until.tolist()], until.tolist())]
        now = np.stack((np.array([len(i) for i in ids_a]), np.array([len(i) for i in ids_b]), groups, links), axis=1).astype(np.int64)
        self.counts = np.concatenate((self.counts, now))
        self.bad = np.concatenate((self.bad, ~np.array(good)))
        self.pairs = np.concatenate((self.pairs, pairs))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(links)))

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For each text: its four counts and the hash of its groups; then the distinct id pairs of all texts with the text's number and times."""
        if len(self) > CACHE:
            self.forget()
        asked = [list(map(self.__getitem__, self.split(t))) for t in texts]
        self.learn()
        sizes = np.array([len(x) for x in asked])
        flat = np.array([i for x in asked for i in x], dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        bad = np.zeros(len(texts), dtype=bool)
        bad[owner[self.bad[flat]]] = True
        counts = np.add.reduceat(self.counts[flat], np.cumsum(sizes) - sizes, axis=0)
        counts[bad] = 0
        of = self.text
        hashes = ["" if b else hashlib.sha256(";".join([of[i] for i in x]).encode()).hexdigest() for x, b in zip(asked, bad.tolist())]
        flat, owner = flat[~bad[owner]], owner[~bad[owner]]
        # equal chunks of a text first: their links are looked up once
        both, times = np.unique(owner * (len(self) + 1) + flat, return_counts=True)
        owner, flat = np.divmod(both, len(self) + 1)
        n = self.first[flat + 1] - self.first[flat]
        at = np.repeat(self.first[flat] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pair, owner, times = self.pairs[at], np.repeat(owner, n), np.repeat(times, n)
        order = np.lexsort((pair, owner))
        pair, owner, times = pair[order], owner[order], times[order]
        start = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])))) if len(pair) else np.zeros(0, dtype=np.int64)
        return counts, hashes, owner[start], pair[start], np.add.reduceat(times, start) if len(start) else times


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row for each distinct text that is not null or empty: key (SHA-256), copies, the counts, the hash of the groups, and its
    distinct id pairs with the number of links that hold them."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tokenizers

        # kept in the worker process between its tasks: this function travels by value, so its own module has no lasting state there
        kept = tokenizers.__dict__.setdefault("_aligners", {})
        aligner = kept.get((path_a, path_b)) or kept.setdefault((path_a, path_b), Aligner(path_a, path_b))

        def done(texts: list[str], copies: list[int]) -> pa.RecordBatch:
            counts, hashes, owner, pair, times = aligner.align(texts)
            ends = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32))
            keys = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
            lists = [pa.ListArray.from_arrays(ends, pa.array(pair)), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32)))]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(copies, pa.int64()), *[pa.array(counts[:, i]) for i in range(4)], pa.array(hashes, pa.string()), *lists],
                                              ["key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

        for batch in parts:
            texts, copies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= CHARS:
                    yield done(texts[at:i + 1], copies[at:i + 1])
                    at, size = i + 1, 0
            if at < len(texts):
                yield done(texts[at:], copies[at:])

    distinct = docs.where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    with small_batches(docs.sparkSession):
        return durable(distinct.mapInArrow(rows, COLUMNS))


def pair_counts(texts: DataFrame) -> DataFrame:
    """pair, a, b, count (links of the corpus, copies included) and best (no A id has a higher count with this B id)."""
    each = texts.select("copies", F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    counts = durable(each.groupBy(F.col("l.pairs").alias("pair")).agg(F.sum(F.col("l.times") * F.col("copies")).alias("count")))
    counts = counts.withColumns({"a": F.shiftright("pair", SHIFT), "b": F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))})
    top = counts.groupBy(F.col("b").alias("_b")).agg(F.max("count").alias("_top"))
    return counts.join(if_small(top), F.col("b") == F.col("_b")).select("pair", "a", "b", "count", (F.col("count") == F.col("_top")).alias("best"))


def report(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    texts = aligned(docs, path_a, path_b)
    counts = durable(pair_counts(texts).select("pair", "count", "best"))
    each = texts.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("key", F.col("l.pairs").alias("pair"), F.col("l.times").cast("bigint").alias("times"))
    sums = each.join(if_small(counts), "pair").groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    of = texts.drop("pairs", "times", "copies").join(durable(sums), "key")
    rows = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("key"))
    number = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return rows.join(of, "key", "left").select("doc_id", *number, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
