"""Alignment against a plain version that encodes whole texts and compares all byte ranges."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from conftest import same
from tokenizers import Tokenizer

from tablewright.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {}
    n = 0
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
            letters[chr(byte)] = byte
        else:
            letters[chr(256 + n)] = byte
            n += 1
    names = {i: t for t, i in a.get_vocab().items()}

    def ranges(pieces):
        out, at = [], 0
        for p in pieces:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    def of(text):
        """A ids, B ids, groups and links, or None."""
        if not text:
            return None
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        pa = [bytes(letters[c] for c in names[i]) for i in ia]
        pb = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if b"".join(pa) != (" " + text).encode() or b"".join(pb) != (" " + text).encode():
            return None
        ra, rb = ranges(pa), ranges(pb)
        ends = sorted({e for _, e in ra} & {e for _, e in rb})
        groups, last = [], 0
        for e in ends:
            groups.append(",".join(str(i) for i, r in zip(ia, ra) if last < r[1] <= e) + "|" + ",".join(str(i) for i, r in zip(ib, rb) if last < r[1] <= e))
            last = e
        links = [(i, j) for i, r in zip(ia, ra) for j, s in zip(ib, rb) if r[0] < s[1] and s[0] < r[1]]
        return ia, ib, groups, links

    return of


def expected(rows, plain):
    found = {t: plain(t) for t in {t for _, t in rows}}
    count = Counter(link for _, t in rows if found[t] for link in found[t][3])
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    for i, t in rows:
        if not found[t]:
            yield (i, 0, 0, 0, 0, 0, 0, "")
        else:
            ia, ib, groups, links = found[t]
            best = sum(count[x] == top[x[1]] for x in links)
            yield (i, len(ia), len(ib), len(groups), len(links), best, sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest())


def check(docs, plain):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    out = alignment.report(docs, A, B)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    same([tuple(r) for r in out.collect()], list(expected(rows, plain)))


def test_documents(spark, sf, plain):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(docs.where("length(text) < 2000"), plain)


def test_odd_rows(odd, nothing, plain):
    check(odd.where("coalesce(length(text), 0) < 5000"), plain)
    assert alignment.report(nothing, A, B).count() == 0


def test_pieces_of_any_kind(spark, plain):
    """Chunks end only where both tokenizers end a token: runs of white space of all kinds, marks, controls, special strings."""
    parts = [" ", "  ", "\n", "\t", "\r\n", " ", " ", "\x1c", "\x85", "▁", "​", "　", "a", "the", "word", "Straße", "naïve", "ﬁ", "é", "日本語", "🙂", "👩‍👩‍👧", "'s", "'ll",
             ",", "...", "123", "1,000.50", "<s>", "</s>", "<|endoftext|>", "<0x41>", "<unk>", "\x00", "\x07", "http://a.b/c?d=e", "|", "ÀÉ", "don't", "﻿"]
    r = random.Random(5)
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(700)] + ["x" * 3000, " " * 50, "a" + " " * 40 + "b", "<|endoftext|>", "ab " * 200]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9000 + i, t) for i, t in enumerate(texts[:30] * 3)], "doc_id bigint, text string")
    check(docs, plain)


def test_whole_texts_equal_chunks(plain):
    """With chunks off, and with a memory that is always full, results stay the same."""
    texts = ["the quick brown fox  jumps", " over the lazy dog\n\nagain the quick", "the the the"]
    one, two = alignment.Aligner(A, B), alignment.Aligner(A, B)
    two.by_chunk = False
    x, y = one.align(texts), two.align(texts)
    assert one.by_chunk and all((a == b).all() if hasattr(a, "all") else a == b for a, b in zip(x, y))
    one.forget()
    assert one.align(texts)[1] == x[1]
