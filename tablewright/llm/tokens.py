"""Token ids in wavelet matrix shards.

Documents are tokenized in ascending doc_id order, an end id follows each, and the id stream is cut into shards of about
``SHARD`` ids (a document is never cut). A shard is one self-contained binary value in the format of ``Shard``: a directory of
documents and one bit-plane for each bit of an id, most significant first, each compressed. Behind every plane the ids are
partitioned stably by its bit, so ``rank`` on the planes gives access to any position, the number of times an id occurs in a
range, and (with ``select``) the places where it occurs, without decoding the rest.

Shards are rows of a written table (part, seq, sizes, payload): Spark's committer makes a lost task's shards appear once. The
range partitioning is by doc_id, so parts and shards are in order.

The tokenizer's pieces never cross ASCII white space, so a worker encodes a word once and looks it up after that, within a bound on
what it remembers; the result equals encoding the whole text (tested).

Defined cases: null text is empty and gives only the end id; null doc_ids come first; rows alike in doc_id are in order of their
text; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.llm.common import if_small, small_batches
from tablewright.session import durable

END_ID = 1
SHARD = 1 << 17
CACHE, PIECES = 16 << 20, 10 << 20  # bytes of words, and of pieces of words, with their ids in one generation of what a worker remembers
CHUNK = 8 << 20  # bytes of text, about, that are encoded at a time: the more, the fewer words are looked up again
TOGETHER = 20_000  # pieces that the tokenizer gets at a time: it takes far more memory than their letters
BATCH = 256  # rows handed to Python at a time: texts may be long
MAGIC = b"WVM2"
BLOCK = 1024  # bits between two entries of a rank directory
COLUMNS = "part int, seq int, docs long, tokens long, payload binary"


def ranks(plane: np.ndarray) -> np.ndarray:
    """Ones before each block of a plane, and in all."""
    ones = np.bitwise_count(np.pad(plane, (0, -len(plane) % (BLOCK // 8)))).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
    return np.concatenate(([0], np.cumsum(ones))).astype("<u4")


class Shard:
    """Layout: magic, ids, documents, planes (u32 each); compressed lengths; directory (doc_id i64, null flag u8, length u32);
    then for each plane its number of zeros (u32) and, zstd-compressed, its rank directory (ones before each ``BLOCK`` bits, u32) and packed bits.
    A plane is decompressed when it is first used. Numbers are little-endian."""

    def __init__(self, doc_ids: np.ndarray, missing: np.ndarray, lengths: np.ndarray, zeros: list[int], bodies: list[bytes]):
        self.doc_ids, self.missing, self.lengths, self.zeros, self.bodies = doc_ids, missing, lengths, zeros, bodies
        self.n = int(lengths.sum())
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def build(cls, ids: np.ndarray, doc_ids: list, lengths: list[int], width: int) -> Shard:
        zeros, bodies, now = [], [], ids
        packed = zstandard.ZstdCompressor(level=1).compress
        for b in range(width - 1, -1, -1):
            bit = (now & ids.dtype.type(1 << b)).astype(bool)
            plane = np.packbits(bit, bitorder="little")
            bodies.append(packed(ranks(plane).tobytes() + plane.tobytes()))
            low, high = np.flatnonzero(~bit), np.flatnonzero(bit)
            zeros.append(len(low))
            now = np.concatenate((now.take(low), now.take(high)))
        missing = np.array([d is None for d in doc_ids], dtype=np.uint8)
        return cls(np.array([d or 0 for d in doc_ids], dtype="<i8"), missing, np.array(lengths, dtype="<u4"), zeros, bodies)

    def write(self) -> bytes:
        packed = zstandard.ZstdCompressor(level=1).compress
        head = packed(self.doc_ids.tobytes() + self.missing.tobytes() + self.lengths.tobytes())
        bodies = self.bodies
        sizes = struct.pack(f"<{1 + len(bodies)}I", len(head), *map(len, bodies))
        zeros = struct.pack(f"<{len(self.zeros)}I", *self.zeros)
        return b"".join((MAGIC, struct.pack("<III", self.n, len(self.lengths), len(bodies)), sizes, zeros, head, *bodies))

    @classmethod
    def read(cls, data: bytes) -> Shard:
        if data[:4] != MAGIC:
            raise ValueError("not a shard")
        n, docs, width = struct.unpack_from("<III", data, 4)
        sizes = struct.unpack_from(f"<{1 + width}I", data, 16)
        zeros = struct.unpack_from(f"<{width}I", data, 20 + 4 * width)
        at = 20 + 8 * width
        parts = []
        for s in sizes:
            parts.append(data[at:at + s])
            at += s
        head = zstandard.decompress(parts[0])
        return cls(np.frombuffer(head, "<i8", docs), np.frombuffer(head, np.uint8, docs, 8 * docs), np.frombuffer(head, "<u4", docs, 9 * docs),
                   list(zeros), parts[1:])

    def plane(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Rank directory and packed bits of a plane."""
        if level not in self._open:
            body, entries = zstandard.decompress(self.bodies[level]), -(-self.n // BLOCK) + 1
            self._open[level] = np.frombuffer(body, "<u4", entries), np.frombuffer(body, np.uint8, offset=4 * entries)
        return self._open[level]

    def ids(self) -> np.ndarray:
        """All ids in order, planes undone from the last to the first."""
        width = len(self.bodies)
        kind = np.uint16 if width <= 16 else np.uint32
        now = np.zeros(self.n, dtype=kind)
        for level in range(width - 1, -1, -1):
            bit = np.unpackbits(self.plane(level)[1], count=self.n, bitorder="little").view(bool)
            z, back = self.zeros[level], np.empty(self.n, dtype=kind)
            back[np.flatnonzero(~bit)] = now[:z]
            back[np.flatnonzero(bit)] = now[z:] | kind(1 << (width - 1 - level))
            now = back
        return now

    def _rank(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane: a directory entry and the rest of one block."""
        before, plane = self.plane(level)
        block, rest = divmod(i, BLOCK)
        first = block * (BLOCK // 8)
        return int(before[block]) + int(np.unpackbits(plane[first:first + BLOCK // 8], bitorder="little")[:rest].sum())

    def _select(self, level: int, k: int, bit: int) -> int:
        """Place of the k-th (from 0) such bit of a plane, by bisection on rank."""
        lo, hi = 0, self.n
        while hi - lo > 1:
            mid = (lo + hi) // 2
            ones = self._rank(level, mid)
            if (ones if bit else mid - ones) <= k:
                lo = mid
            else:
                hi = mid
        return lo

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for level in range(len(self.bodies)):
            before, after = self._rank(level, i), self._rank(level, i + 1)
            value = 2 * value + (after - before)
            i = self.zeros[level] + before if after > before else i - before
        return value

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        width = len(self.bodies)
        if value >> width:
            return 0, 0
        for level in range(width):
            a, b = self._rank(level, lo), self._rank(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if value >> (width - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """How often an id occurs among the places lo to hi."""
        a, b = self._range(value, lo, self.n if hi is None else hi)
        return b - a

    def places(self, value: int) -> list[int]:
        """All places of an id, ascending."""
        lo, hi = self._range(value, 0, self.n)
        out = []
        for i in range(lo, hi):
            for level in range(len(self.bodies) - 1, -1, -1):
                bit = value >> (len(self.bodies) - 1 - level) & 1
                i = self._select(level, i - self.zeros[level] if bit else i, bit)
            out.append(i)
        return out


# What SIMPLE and PIECE rebuild: the normaliser and splitter of a tokenizer file
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Words of ASCII and precomposed Latin letters: for these, lower case and the pattern do what such a file prescribes
SIMPLE = "^[\\x21-\\x7eÀ-ÖØ-öø-ÿ]*$"
PIECE = r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Known:
    """Different words, or pieces of words, and the ids of each, as Arrow columns."""

    def __init__(self, names: list[pa.Array] = (), ids: list[pa.Array] = ()):
        self.names = pa.concat_arrays(names or [pa.array([], pa.large_string())])
        self.ids = pa.concat_arrays(ids or [pa.array([], pa.large_binary())])
        self.nbytes = self.names.nbytes + self.ids.nbytes

    def items(self) -> Iterator[tuple[str, bytes]]:
        return zip(self.names.to_pylist(), self.ids.to_pylist())

    def places(self, wanted: pa.Array) -> np.ndarray:
        """Where each stands, -1 if nowhere."""
        return np.array(pc.fill_null(pc.index_in(wanted, value_set=self.names), -1))

    def recall(self, older: Known, wanted: pa.Array, learn: Callable[[pa.Array], pa.Array]) -> tuple[Known, pa.Array]:
        """These and whatever else is wanted, taken from the older ones or learned; the ids of what is wanted, which has no two alike."""
        at = self.places(wanted)
        new = np.flatnonzero(at < 0)
        missing = wanted.take(new)
        old = older.places(missing)
        again, unknown = np.flatnonzero(old >= 0), np.flatnonzero(old < 0)
        at[new[np.concatenate((again, unknown))]] = np.arange(len(self.names), len(self.names) + len(new))
        fresh = missing.take(unknown)
        made = Known([self.names, missing.take(again), fresh], [self.ids, older.ids.take(old[again]), learn(fresh)])
        return made, made.ids.take(at)


def spans(ids: pa.Array, ends: np.ndarray) -> pa.Array:
    """The ids joined between these places, for each two that follow each other."""
    _, offsets, data = ids.buffers()
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.frombuffer(offsets, np.int64, len(ids) + 1)[ends]), data])


class Words:
    """Encodes texts through their words. Words are remembered with their ids in two generations of about ``CACHE`` bytes each; the words of a batch that are new
    are encoded together: simple ones go to the tokenizer's model piece by piece, and pieces are remembered too ("Word," and "word" share one), any
    other word is encoded whole. With a file of another normaliser or splitter, texts are encoded whole. ``share`` of these bounds holds: less memory, more work."""

    def __init__(self, path: str, dtype: str, share: float = 1.0):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.dtype = Tokenizer.from_file(path), dtype
        self.letters = {b: letter for b, letter in _byte_letters().items() if b != 32}  # pieces hold no space
        self.bare = Tokenizer(self.tokenizer.model)  # takes pieces between spaces
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.item = struct.Struct(dtype.replace("u2", "H").replace("u4", "I")).pack
        self.words, self.older, self.pieces, self.older_pieces, self.share = Known(), Known(), Known(), Known(), share
        settings = json.loads(self.tokenizer.to_str())
        split, *more = (settings["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        model = settings["model"]
        suffix = model.get("end_of_word_suffix") or " "
        self.last = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=bool)
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.by_word = (settings["normalizer"] == NORMALIZER and split.get("pattern") == {"Regex": SPLITTER} and split.get("behavior") == "Removed" and bool(split.get("invert"))
                        and [m["type"] for m in more] == ["ByteLevel"] and not more[0]["add_prefix_space"] and not more[0]["use_regex"]
                        and model["type"] == "BPE" and suffix != " " and not model["dropout"] and not any(re.search(r"\s", t) for t in self.special))

    def encode(self, texts: list[bytes | None] | pa.Array) -> list[bytes]:
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_binary()), b"")
        if not self.by_word:
            found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in column.to_pylist()], add_special_tokens=False)
            return [self.packed(e.ids) for e in found]
        parts = pc.ascii_split_whitespace(column.view(pa.large_string()))
        coded = parts.flatten().dictionary_encode()
        if self.words.nbytes > CACHE * self.share:
            self.words, self.older = Known(), self.words
        self.words, ids = self.words.recall(self.older, coded.dictionary, self.learn)
        return spans(ids.take(coded.indices), parts.offsets.to_numpy()).to_numpy(zero_copy_only=False).tolist()

    def learn(self, words: pa.Array) -> pa.Array:
        simple = pc.match_substring_regex(words, SIMPLE)
        for t in self.special:
            simple = pc.and_not(simple, pc.match_substring(words, t))
        mask = simple.to_numpy(zero_copy_only=False)
        if mask.all():
            return self.learn_simple(words)
        rest = words.filter(pc.invert(simple)).view(pa.large_binary()).to_pylist()
        whole = [self.packed(self.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids) for w in rest]
        ids = pa.concat_arrays([self.learn_simple(words.filter(simple)), pa.array(whole, pa.large_binary())])
        return ids.take(np.argsort(np.concatenate((np.flatnonzero(mask), np.flatnonzero(~mask)))))

    def learn_simple(self, words: pa.Array) -> pa.Array:
        parts = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(words), PIECE, r"\0 "))
        coded = parts.flatten().dictionary_encode()
        if self.pieces.nbytes > PIECES * self.share:
            self.pieces, self.older_pieces = Known(), self.pieces
        self.pieces, ids = self.pieces.recall(self.older_pieces, coded.dictionary, self.learn_pieces)
        return spans(ids.take(coded.indices), parts.offsets.to_numpy())

    def learn_pieces(self, pieces: pa.Array) -> pa.Array:
        names, made = pieces.to_numpy(zero_copy_only=False).tolist(), [np.empty(0, self.dtype)]
        for at in range(0, len(names), TOGETHER):
            listed = " ".join(names[at:at + TOGETHER]).encode().decode("latin-1").translate(self.letters)
            made.append(np.array(self.bare.encode_batch_fast([listed], add_special_tokens=False)[0].ids, dtype=self.dtype))
        ids = np.concatenate(made)
        ends = np.concatenate(([0], np.flatnonzero(self.last[ids]) + 1)) * ids.itemsize  # every piece has its last token marked
        filled = np.cumsum(np.concatenate(([0], np.array(pc.binary_length(pieces)) > 0)))  # the end of a word is an empty piece without ids
        return pa.Array.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(ends[filled]), pa.py_buffer(ids)])

    def packed(self, ids: list[int]) -> bytes:
        return b"".join([self.item(i) for i in ids])


def chunks(batches: Iterator[pa.RecordBatch], size: float) -> Iterator[tuple[list, pa.Array]]:
    """The two columns of all batches, in order, until their rows have about so many bytes. A row is not cut."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            held.append(batch.slice(at, BATCH))
            n += held[-1].nbytes
            if n >= size:
                yield _joined(held)
                held, n = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[list, pa.Array]:
    return [i for rows in held for i in rows.column(0).to_pylist()], pa.concat_arrays([rows.column(1).cast(pa.large_binary()) for rows in held])


def encoder(path: str, end_id: int = END_ID, dtype: str = "<u4", share: float = 1.0):
    """Function from UTF-8 texts to their ids as bytes, end id included."""
    import tokenizers

    # kept in the worker process between its tasks: this function travels by value, so its own module has no lasting state there
    kept = tokenizers.__dict__.setdefault("_words_by_file", {})
    words = kept.get((path, dtype, share)) or kept.setdefault((path, dtype, share), Words(path, dtype, share))
    end = np.array([end_id], dtype=dtype).tobytes()
    return lambda texts: [ids + end for ids in words.encode(texts)]


def id_width(path: str, end_id: int = END_ID) -> int:
    from tokenizers import Tokenizer

    return max(1, max(Tokenizer.from_file(path).get_vocab_size() - 1, end_id).bit_length())


def write(docs: DataFrame, path: str, end_id: int = END_ID, shard: int = SHARD, share: float = 1.0) -> DataFrame:
    """The written shards, read back as a table."""
    width = id_width(path, end_id)
    ordered = docs.select("doc_id", "text").repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    dtype = "<u2" if width <= 16 else "<u4"

    def shards(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, end_id, dtype, share)
        part, seq = TaskContext.get().partitionId(), 0
        ids, lengths, held, size = [], [], [], 0
        item = np.dtype(dtype).itemsize

        def closed() -> pa.RecordBatch:
            made = Shard.build(np.frombuffer(b"".join(held), dtype), ids, lengths, width)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([size], pa.int64()),
                                               pa.array([made.write()], pa.binary())], ["part", "seq", "docs", "tokens", "payload"])

        for keys, texts in chunks(parts, CHUNK * share):
            for i, data in zip(keys, encode(texts)):
                n = len(data) // item
                if size and size + n > shard:
                    yield closed()
                    ids, lengths, held, size, seq = [], [], [], 0, seq + 1
                ids.append(i)
                lengths.append(n)
                held.append(data)
                size += n
        if ids:
            yield closed()

    made = ordered.select("doc_id", F.encode("text", "UTF-8").alias("text")).mapInArrow(shards, COLUMNS)
    with small_batches(docs.sparkSession):
        return durable(made)


def read(shards: DataFrame) -> DataFrame:
    """part, seq, idx, doc_id, at (place in the shard), n_tokens, ids_crc32 of every document, from the payloads."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            for part, seq, payload in zip(frame["part"], frame["seq"], frame["payload"]):
                s = Shard.read(payload)
                data = s.ids().astype("<u4")
                ends = np.cumsum(s.lengths.astype(np.int64))
                starts = ends - s.lengths
                view = memoryview(data).cast("B")
                crc = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                ids = pd.array(s.doc_ids, dtype="Int64")
                ids[s.missing == 1] = pd.NA
                yield pd.DataFrame({"part": part, "seq": seq, "idx": np.arange(len(ends)), "doc_id": ids, "at": starts,
                                    "n_tokens": s.lengths.astype(np.int64), "ids_crc32": np.array(crc, dtype=np.int64)})

    return shards.select("part", "seq", "payload").mapInPandas(rows, "part int, seq int, idx long, doc_id long, at long, n_tokens long, ids_crc32 long")


def report(docs: DataFrame, path: str, end_id: int = END_ID, shard: int = SHARD, share: float = 1.0) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the shards."""
    shards = write(docs, path, end_id, shard, share)
    sizes = shards.select("part", "seq", "tokens")
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("_all"))  # one row for each partition
    before = parts.select(F.col("part").alias("_p"), F.coalesce(F.sum("_all").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.coalesce(F.sum("tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = sizes.withColumn("_inner", inner).join(F.broadcast(before), F.col("part") == F.col("_p")).select("part", "seq", (F.col("_before") + F.col("_inner")).alias("_base"))
    out = read(shards).join(if_small(base), ["part", "seq"])
    return out.select("doc_id", (F.col("_base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
