import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, _h string, key string, kept int"
WORDS = "the river of green stones and light under old trees near water with many small birds over quiet hills".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice("abcdefgh") if r.random() < 0.4 else "") for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows, and extra columns with clashing names."""
    long = prose(1, 6000)
    rows = [
        (1, prose(2, 40), "en", "b"), (2, prose(2, 40), "en", "b"), (2, prose(2, 40), "en", "b"), (3, None, "en", "a"), (4, "", "de", "a"),
        (5, " \t\n\x0b\f\r ", None, None), (None, prose(3, 30), "en", None), (None, prose(3, 30), "en", None), (6, long, "en", "a"), (7, long + " end", "en", "a"),
        (8, "one", "en", "c"), (9, "One", "en", "c"), (10, "ünï çödé 🙂 wörds\u00a0here ñ", "es", "é"), (11, prose(4, 25) + "\n" + prose(4, 25) + "\n\n" + prose(4, 25), "en", "a"),
        (12, None, None, None), (13, "\n\n", "fr", "")]
    return [(i, t, l, s, None if t is None else len(t), "x", "y", "z", 7) for i, t, l, s in rows]


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))
