"""Periodic run detection by difference-cover longest common extensions.

A run is a maximal stretch of consecutive words that are identical ``q`` apart, q being its smallest period, of at least ``max(6, 4 * q)`` words.

A stretch with period q holds at least 3q consecutive places i whose word equals the one at i + q, so it is met at one of the places 0, 3q, 6q, ... of the text: over
all periods this harmonic grid has about n * ln(n) / 3 places. Where the two words of a grid place are equal, the longest common extensions of (i, i + q) to the
right and to the left give the maximal stretch.

An extension compares a few words until both places, moved on together, are in the difference cover (a set of residues modulo ``PERIOD`` that holds every difference). Only
the suffixes that start at cover places are sorted, only in documents that a query gets that far in, and only until they differ: word by word over one
period, then by doubling over the ranks of the samples behind. Common prefixes of neighbours come with the splits; their minimum over a range, from a sparse table, is the rest of an extension.

Many documents are handled side by side in one array, with a mark of its own after each. A document is never cut: it is one row.

Defined cases: null and empty texts have no words and no runs; a null doc_id leaves its words as they are; repeated rows each get a row; other columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import small_batches
from tablewright.session import durable

COVER, PERIOD = (0, 1, 3, 8, 12, 18), 31  # every number modulo 31 is a difference of two of these
LEAST, TIMES = 6, 4  # shortest run, and periods in a run
WORDS = 1 << 16  # words handled side by side, about
QUERIES = 1 << 20  # grid places tried at a time
COLUMNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
FAR = np.iinfo(np.int64).max


def _shifts() -> np.ndarray:
    """[a, b]: the smallest step that brings both residues into the cover."""
    inside = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    step = [[next(h for h in range(PERIOD) if inside[a + h] and inside[b + h]) for b in range(PERIOD)] for a in range(PERIOD)]
    return np.array(step, dtype=np.int64)


class RangeMin:
    """Minimum of any range of an array, from a sparse table."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 ** len(self.rows) <= len(values):
            half, last = 2 ** (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima of the places first to last, both included."""
        level = np.frexp(last - first + 1)[1] - 1
        out = np.empty(len(first), dtype=np.int64)
        for k in np.unique(level):
            at = level == k
            row = self.rows[k]
            out[at] = np.minimum(row[first[at]], row[last[at] - 2**k + 1])
        return out


class Extensions:
    """Longest common extensions to the right in ``words``; every document ends with a mark of its own that occurs once."""

    def __init__(self, words: np.ndarray, owner: np.ndarray):
        self.words, self.owner, self.shift = words, owner, _shifts()

    def _index(self, docs: np.ndarray) -> None:
        """Sorts the sampled suffixes of some documents."""
        wanted = np.zeros(int(self.owner.max()) + 1, dtype=bool)
        wanted[docs] = True
        place = np.flatnonzero(wanted[self.owner] & np.isin(np.arange(len(self.words)) % PERIOD, COVER))
        m = len(place)
        slot = np.full(len(self.words), -1, dtype=np.int64)
        slot[place] = np.arange(m)
        group, order = np.zeros(m, dtype=np.int64), np.arange(m)
        common = np.full(m, FAR)  # of a sorted suffix and the one before it; unknown inside a group
        common[:1] = 0
        active, reach = np.arange(m), 0
        while len(active):
            known = None
            if reach < PERIOD:
                following = self.words[place[order[active]] + reach]
            else:
                known = RangeMin(common)
                following = group[slot[place[order[active]] + reach]]
            by = np.lexsort((following, group[order[active]]))
            moved, following = order[active][by], following[by]
            order[active] = moved
            own = group[moved]
            fresh = np.concatenate(([True], own[1:] != own[:-1]))
            split = np.concatenate(([False], ~fresh[1:] & (following[1:] != following[:-1])))
            if known is None:
                common[active[split]] = reach
            else:
                common[active[split]] = reach + known.least(following[np.flatnonzero(split) - 1] + 1, following[split])
            start = fresh | split
            group[moved] = np.maximum.accumulate(np.where(start, active, 0))
            alone = start & np.append(start[1:], True)
            active = active[~alone]
            reach = reach + 1 if reach < PERIOD else 2 * reach
        self.slot, self.group, self.least = slot, group, RangeMin(common)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words are equal from i and from j on; i < j."""
        words = self.words
        need = self.shift[i % PERIOD, j % PERIOD]
        out = np.zeros(len(i), dtype=np.int64)
        going, t = np.arange(len(i)), 0
        reached = [going[need[going] == 0]]
        going = going[need[going] > 0]
        while len(going):
            going = going[words[i[going] + t] == words[j[going] + t]]
            t += 1
            out[going] = t
            reached.append(going[need[going] == t])
            going = going[need[going] > t]
        far = np.concatenate(reached)
        if len(far):
            a, b = i[far] + need[far], j[far] + need[far]
            self._index(np.unique(self.owner[a]))
            x, y = self.group[self.slot[a]], self.group[self.slot[b]]
            out[far] += self.least.least(np.minimum(x, y) + 1, np.maximum(x, y))
        return out


def _grid(first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods of the harmonic grids of documents that start at ``first``, some at a time."""
    most = size // TIMES
    doc = np.repeat(np.arange(len(size)), most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    fits = size[doc] >= LEAST
    doc, period = doc[fits], period[fits]
    step = (TIMES - 1) * period
    count = (size[doc] - period + step - 1) // step
    total, at = np.cumsum(count), 0
    while at < len(doc):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + QUERIES, "right")))
        c = count[at:to]
        nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        yield np.repeat(first[doc[at:to]], c) + nth * np.repeat(step[at:to], c), np.repeat(period[at:to], c)
        at = to


def runs(texts: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start, length and smallest period of all runs of lists of words, in order of text, start and period."""
    known: dict = {}
    size = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.cumsum(size + 1) - size  # a mark stands before each text, and one after the last
    n = int(size.sum()) + len(texts) + 1
    words = -1 - np.arange(n, dtype=np.int64)
    inside = np.ones(n, dtype=bool)
    inside[first - 1] = False
    inside[-1] = False
    words[inside] = np.array([known.setdefault(w, len(known)) for t in texts for w in t], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), size + 1)
    before, after = np.append(owner, max(len(texts) - 1, 0)), np.append(0, owner)  # the mark before a text, or the one after it, is its own
    places, periods = [], []
    for i, p in _grid(first, size):
        hit = words[i] == words[i + p]
        i, p = i[hit], p[hit]
        # two equal places in a row, on either side, or the stretch is too short
        hit = (words[i + 1] == words[i + 1 + p]) | (words[i - 1] == words[i - 1 + p])
        places.append(i[hit])
        periods.append(p[hit])
    if not places or not sum(map(len, places)):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    i, p = np.concatenate(places), np.concatenate(periods)
    right = Extensions(words, after).of(i, i + p)
    # to the left: the same on the reversed array, where the later place comes first
    back = n - 1 - i + 1
    left = Extensions(words[::-1].copy(), before[::-1].copy()).of(back - p, back)
    start, length = i - left, left + right + p
    long = length >= np.maximum(LEAST, TIMES * p)
    start, length, p = start[long], length[long], p[long]
    order = np.lexsort((p, length, start))
    start, length, p = start[order], length[order], p[order]
    # the same stretch under a multiple of its period comes later: the smallest period stays
    new = np.concatenate(([True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])))[:len(start)]
    start, length, p = start[new], length[new], p[new]
    doc = after[start]
    order = np.lexsort((p, start))
    return doc[order], (start - first[doc])[order], length[order], p[order]


def prepared(doc_id: int | None, text: str | None) -> list[bytes]:
    """The words of a document; for every tenth hash of a doc_id the tail repeats its own beginning."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a:a + p]
    return words[:a] + (cycle * ((n - a) // p + 1))[:n - a]


def described(ids: list, texts: list[list[bytes]]) -> list[tuple]:
    """The report's rows of some documents."""
    doc, start, length, period = runs(texts)
    at = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
    out = []
    for i, words, x, y in zip(ids, texts, at, at[1:]):
        if x == y:
            best, listed, kept = (None,) * 4, "", words
        else:
            s, n, q = start[x:y], length[x:y], period[x:y]
            k = int(np.lexsort((q, s, -n))[0])
            best = int(s[k]), int(n[k]), int(q[k]), int(1000 * n[k] // q[k])
            listed = "".join([f"{a},{b},{c}\n" for a, b, c in zip(s.tolist(), n.tolist(), q.tolist())])
            depth = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(depth, s + q, 1)
            np.add.at(depth, s + n, -1)
            kept = [w for w, d in zip(words, np.cumsum(depth).tolist()) if not d]
        out.append((i, y - x, *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli) and the hashes of all runs and of the text without repeats, of every document."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.string()] * 2

        def done(ids: list, texts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*described(ids, texts)), kinds)], names)

        for batch in parts:
            ids, texts, size = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(prepared(i, t))
                size += len(texts[-1])
                if size >= WORDS:
                    yield done(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield done(ids, texts)

    with small_batches(docs.sparkSession):
        return durable(docs.select("doc_id", "text").mapInArrow(rows, COLUMNS))
