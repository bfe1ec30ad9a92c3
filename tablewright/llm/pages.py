"""HTML extraction: structure first, a host-wide suffix index for the rest.

A page is parsed into text blocks. Blocks inside elements that are never main text (menus, headers, footers, sidebars, forms,
scripts, adverts, notices, comments) are marked; so are those inside an explicit article. The words of all blocks outside the
article, one after the other, are the page's token stream for its host. Every suffix of a stream is keyed by its first ``DEPTH``
words, across block borders; a shorter block has a key of its own besides. Suffixes of one host with equal keys share a common
prefix of that length, and where they lie in streams that differ the run is boilerplate: longer repeated runs are unions of such
prefixes. This is the host's suffix array sorted to the depth that decides, as a hash grouping, so a host with a third of all pages
is spread over all tasks. Pages whose whole streams are equal (mirrors) are one content and no evidence against each other.

The index judges the words of an explicit article too, as a stream of its own, but articles repeat legitimately: a run inside one goes
only if it stands in at least ``ARTICLES`` articles of the host that differ, and outside articles on no fewer contents than inside; a line that
many articles hold and a few pages quote stays, as do shorter blocks of an article. On a page without one, the words of unmarked blocks that no repeated run covers stay. A block that keeps no word is gone.

Defined cases: null html or url is empty text; a page without text gives an empty string; unclosed and stray tags are tolerated;
repeated rows are one content for the repeats and all get a result; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.llm.common import BROADCAST_ROWS, if_small
from tablewright.llm.urls import host_and_path
from tablewright.session import durable

DEPTH = 8
ARTICLES = 3
FACTOR = 0x9E3779B97F4A7C15  # odd
# fixed values
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe object svg canvas select option textarea button math audio video head title datalist".split())
BOILER = frozenset("nav header footer aside form menu dialog".split())
BLOCK = frozenset(("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li "
                   "main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption").split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
HINTS = frozenset(("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices notification gdpr popup modal "
                   "overlay newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar widget related recommended share sharing "
                   "social comment comments commentlist disqus respond reply replies footer header masthead toolbar pagination pager skip").split())
# a class or id also counts if all its parts are hints or these
PLAIN = frozenset(("site page main top bottom left right primary secondary global box block bar area section container content wrapper wrap inner outer list item items group row "
                   "column panel slot unit form field button link links post posts article articles story stories text title body count thread tools icon icons").split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
PARTS = re.compile(r"[^a-z0-9]+")

CONTAINERS = frozenset("article aside blockquote body div footer form header main nav section td th table button".split())
# element: (elements it closes, elements that such a search does not leave)
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}),
           "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"})}
RAW = frozenset("script style textarea title noscript iframe".split())  # their content is no markup
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|\Z)""", re.I)


def _is_hint(name: str) -> bool:
    """A whole class or id that names no main text: "cookie-notice" and "ad2" do, "ad-hoc" and "related-work" do not."""
    parts = [p.rstrip("0123456789") for p in PARTS.split(name)]
    return not HINTS.isdisjoint(parts) and all(p in HINTS or p in PLAIN or not p for p in parts)


def _role(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """(rules its text out, is an article) of a start tag."""
    out = tag in BOILER and not (tag == "header" and in_article)
    article = tag in ("article", "main")
    for name, *values in ATTRIBUTE.findall(attrs) if attrs.strip(" /") else ():
        name, value = name.lower(), unescape("".join(values)).lower()
        if name in ("class", "id"):
            out = out or (tag not in ("html", "body", "article", "main") and any(_is_hint(n) for n in value.split()))
        elif name == "role":
            out, article = out or value in ROLES, article or value in ("main", "article")
        else:
            out = out or name == "hidden" or value == "true"
    return out, article


class _Page:
    """Open elements and finished blocks; a block is (text, zone): "a" in an article, "x" ruled out, "o" open."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool]] = []  # tag, rules out, is article
        self.silent = self.out = self.article = 0
        self.blocks: list[tuple[str, str]] = []
        self.parts: list[str] = []

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                self.blocks.append((text, "x" if self.out else "a" if self.article else "o"))

    def text(self, data: str) -> None:
        if not self.silent:
            self.parts.append(unescape(data) if "&" in data else data)

    def push(self, tag: str, attrs: str) -> None:
        out, article = _role(tag, attrs, bool(self.article))
        self.stack.append((tag, out, article))
        self.out += out
        self.article += article
        self.silent += tag in SILENT

    def remove(self, at: int) -> None:
        tag, out, article = self.stack.pop(at)
        self.out -= out
        self.article -= article
        self.silent -= tag in SILENT

    def close(self, tags: set | frozenset, stop: set | frozenset) -> None:
        """Closes up to and with the nearest open element of ``tags``, if none of ``stop`` comes first."""
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] in tags:
                self.flush()
                while len(self.stack) > at:
                    self.remove(-1)
                return
            if self.stack[at][0] in stop:
                return

    def start(self, tag: str, attrs: str) -> None:
        if self.silent and (tag == "body" or tag in CLOSES_P):
            self.close({"head"}, {"body"})  # left open
        if tag in BLOCK:
            self.flush()
        if tag in CLOSES_P:
            self.close({"p"}, CONTAINERS)
        if tag in IMPLIED:
            self.close(*IMPLIED[tag])
        if tag == "br":
            self.text("\n")
        elif tag not in VOID:
            self.push(tag, attrs)

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
            self.close({tag}, set() if tag in ("body", "html") else {"body"})
            return
        for at in range(len(self.stack) - 1, -1, -1):  # an inline element may end out of order
            if self.stack[at][0] == tag:
                self.remove(at)
                return
            if self.stack[at][0] in BLOCK:
                return


def blocks(html: str | None) -> list[tuple[str, str]]:
    """(text, zone) of the page in order; comments and markup declarations are gone, character references decoded."""
    html, page, at = html or "", _Page(), 0
    while True:
        m = TAG.search(html, at)
        if m is None:
            page.text(html[at:])
            break
        if m.start() > at:
            page.text(html[at:m.start()])
        at = m.end()
        closing, tag, attrs = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            page.end(tag)
            continue
        page.start(tag, attrs)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>|\Z", re.I).search(html, at)
            at = end.end()
            page.end(tag)
    page.flush()
    return page.blocks


def main_text(found: list[tuple[str, str]], runs: list[tuple[int, int]]) -> list[str]:
    """The article's blocks, on a page without an article the open blocks, without the words that a run (begin, end) of their stream covers."""
    article = any(z == "a" for _, z in found)
    kept = "a" if article else "o"
    if not runs:
        return [t for t, z in found if z == kept]
    gone = {i for begin, end in runs for i in range(begin, end)}
    out, at = [], 0
    for text, zone in found:
        if article and zone != "a":
            continue
        words = text.split()
        if zone == kept:
            out.append(" ".join(w for i, w in enumerate(words, at) if i not in gone))
        at += len(words)
    return [t for t in out if t]


def _key(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")) - (1 << 63)


def _window_keys(words: list[str], depth: int) -> np.ndarray:
    """Keys of all suffixes' first ``depth`` words."""
    known = {w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in set(words)}
    hashes = np.array([known[w] for w in words], dtype=np.uint64)
    n = max(len(words) - depth + 1, 0)
    keys = np.zeros(n, dtype=np.uint64)
    for k in range(depth):
        keys = keys * np.uint64(FACTOR) + hashes[k:k + n]  # modulo 2 ** 64
    return keys.view(np.int64)


def article_keys(found: list[tuple[str, str]], depth: int = DEPTH) -> tuple[int, np.ndarray]:
    """Hash of the article's stream and the keys of its suffixes."""
    words = [w for t, z in found if z == "a" for w in t.split()]
    return _key(words), _window_keys(words, depth)


def suffixes(found: list[tuple[str, str]], depth: int = DEPTH) -> tuple[int, list[tuple[int, int, int, bool]]]:
    """Hash of the stream, and (begin, end, key, whether it can decide anything) of its suffixes' first ``depth`` words and of short blocks.

    Only open blocks of a page without an article wait for a decision.
    """
    words: list[str] = []
    open_: list[bool] = []
    out = []
    free = all(z != "a" for _, z in found)
    for text, zone in found:
        if zone != "a":
            block = text.split()
            if len(block) < depth:
                out.append((len(words), len(words) + len(block), _key(block), free and zone == "o"))
            words += block
            open_ += [free and zone == "o"] * len(block)
    for i, key in enumerate(_window_keys(words, depth).tolist()):
        out.append((i, i + depth, key, any(open_[i:i + depth])))
    return _key(words), out


def _page_key() -> Column:
    return F.xxhash64("page_id", "url", "html")


def stream(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """host, _page, content (hash of the page's stream), begin, end, key and open of every suffix outside articles."""

    @F.pandas_udf("struct<content:bigint,keys:array<struct<begin:int,end:int,key:bigint,open:boolean>>>")
    def cut(htmls: pd.Series) -> pd.DataFrame:
        rows = [suffixes(blocks(h), depth) for h in htmls]
        keys = [[{"begin": b, "end": e, "key": k, "open": o} for b, e, k, o in found] for _, found in rows]
        return pd.DataFrame({"content": pd.Series([c for c, _ in rows], dtype="int64"), "keys": pd.Series(keys, dtype="object")})

    host, _ = host_and_path(F.col("url"))
    rows = pages.select(host.alias("host"), _page_key().alias("_page"), cut("html").alias("c"))
    return rows.select("host", "_page", "c.content", F.explode("c.keys").alias("k")).select("host", "_page", "content", "k.*")


def articles(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """host, _page, content (hash of the article's stream), begin, end and key of every suffix inside articles."""

    @F.pandas_udf("struct<content:bigint,keys:array<bigint>>")
    def cut(htmls: pd.Series) -> pd.DataFrame:
        rows = [article_keys(blocks(h), depth) for h in htmls]
        return pd.DataFrame({"content": pd.Series([c for c, _ in rows], dtype="int64"), "keys": pd.Series([k for _, k in rows], dtype="object")})

    host, _ = host_and_path(F.col("url"))
    rows = pages.select(host.alias("host"), _page_key().alias("_page"), cut("html").alias("c"))
    flat = rows.select("host", "_page", "c.content", F.posexplode("c.keys").alias("begin", "key"))
    return flat.select("host", "_page", "content", "begin", (F.col("begin") + depth).alias("end"), "key")


def boilerplate(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """_page, begin, end: the repeated runs of its stream, joined where they touch, for pages on which they decide."""
    every = durable(stream(pages, depth))
    repeated = every.groupBy("host", "key").agg(F.min("content").alias("_lo"), F.max("content").alias("_hi"), F.max(F.col("end") - F.col("begin")).alias("_n")).where("_lo <> _hi")
    shared = durable(repeated.select("host", "key", "_n"))
    spans = ["_page", "begin", "end"]
    hit = every.where("open").select("host", *spans, "key").distinct().join(shared, ["host", "key"], "left_semi").select(spans)
    inside = durable(articles(pages, depth).join(if_small(shared.where(F.col("_n") == depth).drop("_n")), ["host", "key"], "left_semi"))
    contents = lambda df, n: df.select("host", "key", "content").distinct().groupBy("host", "key").agg(F.count(F.lit(1)).alias(n))
    often = contents(inside, "_in").where(F.col("_in") >= ARTICLES)
    frame = contents(every.join(often, ["host", "key"], "left_semi"), "_out").join(often, ["host", "key"]).where(F.col("_out") >= F.col("_in"))
    hit = hit.unionByName(inside.select("host", *spans, "key").distinct().join(frame, ["host", "key"], "left_semi").select(spans))
    order = W.partitionBy("_page").orderBy("begin", "end")  # bounded by one page
    apart = F.coalesce(F.col("begin") > F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    numbered = hit.withColumn("_new", apart.cast("int")).withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("_page", "_run").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("_run")


def extract(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = pages.select("page_id", "url", "html")
    runs = durable(boilerplate(pages, depth))
    by_page = runs.groupBy(F.col("_page").alias("_p")).agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("_runs"))  # bounded by one page
    if runs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # counts the runs themselves, so it bounds the bytes
        by_page = F.broadcast(by_page)

    @F.pandas_udf("string")
    def text(htmls: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series(["\n\n".join(main_text(blocks(h), [] if r is None else [(x["begin"], x["end"]) for x in r])) for h, r in zip(htmls, runs)], dtype="object")

    joined = pages.withColumn("_page", _page_key()).join(by_page, F.col("_page") == F.col("_p"), "left")
    out = joined.select("page_id", "url", text("html", "_runs").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))
