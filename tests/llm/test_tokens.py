"""Round trips of the shard format, and the query against encoding whole texts."""

import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tablewright.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n,width", [(0, 16), (1, 16), (7, 3), (513, 16), (5000, 16), (4096, 1)])
def test_shard_round_trip(n, width):
    r = random.Random(n)
    ids = np.array([r.randrange(min(2**width, r.choice([2, 40, 2**width]))) for _ in range(n)], dtype="<u4")
    lengths = [n // 3, n - n // 3] if n else [0]
    s = tokens.Shard.read(tokens.Shard.build(ids, [5, None][:len(lengths)], lengths, width).write())
    assert s.ids().tolist() == ids.tolist()
    assert s.lengths.tolist() == lengths and s.missing.tolist() == [0, 1][:len(lengths)]
    for i in {0, n // 2, n - 1} if n else ():
        assert s.access(i) == ids[i]
    for v in {*ids[:5].tolist(), 2**width - 1, 2**width}:
        assert s.places(v) == np.nonzero(ids == v)[0].tolist()
        assert s.count(v) == (ids == v).sum()
        assert s.count(v, n // 4, n // 2) == (ids[n // 4:n // 2] == v).sum()


def check(docs, shard=tokens.SHARD, path=PATH):
    t = Tokenizer.from_file(path)
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [tokens.END_ID]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in tokens.report(docs, path, shard=shard).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_whole_table(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_many_shards(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"), shard=700)


def test_odd_rows(odd, spark):
    check(odd, shard=50)
    extra = [(200, "<|endoftext|> x<|startoftext|>y a<|end oftext|>"), (201, "Σας ΌΔΟΣ é ́x \x1c \x85   z"), (202, "don't 12 ab12's !!??"), (203, "q" * 3000)]
    check(spark.createDataFrame(extra, "doc_id bigint, text string"), shard=50)


def test_no_rows(nothing):
    assert tokens.report(nothing, PATH).count() == 0


def test_another_tokenizer(odd):
    """A file with other rules is not taken for one that splits at white space."""
    check(odd, path=public_tokenizers.path("byte_bpe_50k.json"))


def test_generations(monkeypatch):
    """Words forgotten and met again, pieces shared, special and rare words among plain ones."""
    monkeypatch.setattr(tokens, "CACHE", 3)
    monkeypatch.setattr(tokens, "PIECES", 2)
    t, w = Tokenizer.from_file(PATH), tokens.Words(PATH, "<u2")
    texts = ["The cat's 12 hats, naïve <|endoftext|>x", "cat The dog", "ΌΔΟΣ dog", "a b c d e f", "the cat the dog", "", " \t\n", "x<|startoftext|>y 3.14 don't"] * 3
    for at in range(0, len(texts), 2):
        got = w.encode([x.encode() for x in texts[at:at + 2]])
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts[at:at + 2]]


def test_directory_in_the_file():
    """Rank entries are read from the file, and only the planes that a lookup passes are opened."""
    ids = np.arange(5000, dtype="<u2") % 7
    s = tokens.Shard.read(tokens.Shard.build(ids, [1], [5000], 3).write())
    assert not s._open and s.count(8) == 0 and not s._open
    before, plane = s.plane(0)
    assert before.tolist() == tokens.ranks(plane).tolist() and s.count(3) == (ids == 3).sum()


def test_remembered_bytes(monkeypatch):
    """What a worker remembers is bounded in bytes: few long words are as much as many short ones."""
    monkeypatch.setattr(tokens, "CACHE", 1 << 20)
    monkeypatch.setattr(tokens, "PIECES", 1 << 20)
    w, t = tokens.Words(PATH, "<u2"), Tokenizer.from_file(PATH)
    for batch in range(30):
        texts = [" ".join(f"{'stone' * 200}{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + batch % 26)}{batch}" for i in range(200))]
        got = w.encode([texts[0].encode()])
        if batch % 10 == 0:
            assert got[0] == w.packed(t.encode(texts[0], add_special_tokens=False).ids)
        for kept in ((w.words, w.older), (w.pieces, w.older_pieces)):
            assert sum(len(k) + len(v) for d in kept for k, v in d.items()) < 3 << 20


def test_words_met_again():
    """A word that comes again makes no Python object, and a word that is remembered takes few bytes."""
    w, again = tokens.Words(PATH, "<u2"), ["stone"] * 300_000
    w.encode([b"stone"])
    texts = [" ".join(again).encode()]
    tracemalloc.start()
    try:
        got = w.encode(texts)
        assert tracemalloc.get_traced_memory()[1] < 4 << 20
        assert got == [w.encode([b"stone"])[0] * 300_000]
        del got
        rare = [" ".join(f"st{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}ne," for i in range(17_000)).encode()]
        before = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()
        w.encode(rare)
        assert tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before < 17_000 * 120  # words and pieces
    finally:
        tracemalloc.stop()


def test_mixed_words():
    """Plain, rare, special and broken words and none, as lists and as columns, in one call and in several, equal the tokenizer."""
    t, w = Tokenizer.from_file(PATH), tokens.Words(PATH, "<u2")
    texts = [b"\xff\xfe a \xc3", b"", b"  \x0b ", "Ünï ΌΔΟΣ's ×÷ ½ x<|endoftext|>y plain 12ab\x1c".encode(), None, "é ÉÀß it'll'S \x85 \x00".encode()]
    for column in (texts, pa.array(texts, pa.large_binary()), texts[::-1], pa.array([b"x", *texts], pa.large_binary())[1:]):
        want = [t.encode(x.decode("utf-8", "replace") if x else "", add_special_tokens=False).ids for x in (column if isinstance(column, list) else column.to_pylist())]
        assert [np.frombuffer(g, "<u2").tolist() for g in w.encode(column)] == want
    assert w.encode([]) == [] and w.encode([None]) == [b""]


def test_chunks():
    """Rows are handed over by their bytes, in order, over the borders of batches."""
    texts = [None if i % 7 == 3 else b"x" * (i % 50) for i in range(5000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, a + 500), pa.int64()), pa.array(texts[a:a + 500], pa.binary())], ["i", "t"]) for a in range(0, 5000, 500)]
    got = list(tokens.chunks(iter(batches), 30_000))
    assert [i for keys, _ in got for i in keys] == list(range(5000)) and [x for _, c in got for x in c.to_pylist()] == texts
    assert max(len(keys) for keys, _ in got) > 500 and len(got) > 3
    assert list(tokens.chunks(iter([]), 30_000)) == []
