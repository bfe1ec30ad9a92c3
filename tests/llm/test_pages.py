"""Structure cases and the suffix index against brute force."""

from conftest import prose

from tablewright.llm import pages

SCHEMA = "page_id bigint, url string, html string, text string, host string"


def test_structure():
    html = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body class="page">
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">a</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice">cookies</div>
    <article><h1>Title &amp; more</h1><p><b>First&nbsp;
      block<br>goes on<p>Second <i>one</i></p><div class="ad">buy</div><ul><li>x<li>y</ul><form><p>search</p><button>go</button></form></article>
    <aside>side</aside><section id="comments"><p>nice</p></section><footer>&copy; me</footer></body></html>"""
    assert pages.main_text(pages.blocks(html), []) == ["Title & more", "First block goes on", "Second one", "x", "y"]
    assert pages.blocks(None) == pages.blocks("") == pages.blocks("<p></p><br>") == []
    assert pages.blocks("a < b <p>c") == [("a < b", "o"), ("c", "o")]


def test_hints_are_whole_names():
    html = """<article><p class="ad-hoc">one</p><div class="related-work">two</div><section id="comment-on-method">three</section>
    <div class="lead ad-slot">buy</div><div id="comments2">nice</div><p class="newsletter_signup">mail</p><p class="post-body">four</p></article>"""
    assert pages.main_text(pages.blocks(html), []) == ["one", "two", "three", "four"]


def extract(spark, rows):
    return {r["page_id"]: (r["text"], r["n_chars"]) for r in pages.extract(spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)).collect()}


def test_given_pages(spark, sf):
    out = pages.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    source = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(out) == len(source)
    import html
    import re

    for r in out:
        inner = re.search(r"<article>(.*)</article>", source[r["page_id"]]["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", inner)
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if False else "", re.sub("<br>", " ", p))).split()) for p in parts]
        assert r["text"] == "\n\n".join(p for p in want if p) and r["n_chars"] == len(r["text"]) and r["url"] == source[r["page_id"]]["url"]


def test_runs_repeated_on_a_host(spark):
    """Pages without an article: shared runs go, own words stay, other hosts do not matter, repeats are no evidence."""
    shared, short = prose(1, 30), "Terms of use"
    def page(body):
        return f"<html><body><div>{short}</div><p>{shared} {body[:7]}</p><p>{body}</p></body></html>"
    rows = [(i, f"http://h.com/{i}", page(prose(10 + i, 40))) for i in range(4)]
    rows += [(9, "http://other.com/9", page(prose(99, 40))), (10, "http://once.com/1", page(prose(77, 20))), (10, "http://once.com/1", page(prose(77, 20)))]
    got = extract(spark, rows)
    for i in range(4):
        assert got[i][0] == prose(10 + i, 40)[:7].rstrip() + "\n\n" + prose(10 + i, 40)
    assert got[9][0].split("\n\n")[0] == short and got[9][0].count("\n\n") == 2
    assert got[10][0].startswith(short)


def test_mirrors_keep_their_text(spark):
    """Two URLs with one text are one content; what they share with another page still goes, also across a block border."""
    own, foot = prose(5, 30), [prose(6, 5), prose(7, 6)]
    page = "<p>" + "</p><p>".join([own, *foot]) + "</p>"
    other = "<p>" + "</p><p>".join([prose(8, 30), *foot]) + "</p>"
    assert [r[0] for r in extract(spark, [(1, "http://h.com/1", page), (2, "http://h.com/2", page)]).values()] == ["\n\n".join([own, *foot])] * 2
    got = extract(spark, [(1, "http://h.com/1", page), (2, "http://h.com/2", page), (3, "http://h.com/3", other), (4, "http://h.com/4", "<article>" + other + "</article>")])
    assert got[1][0] == got[2][0] == own and got[3][0] == prose(8, 30) and got[4][0] == "\n\n".join([prose(8, 30), *foot])
    joined = "<p>" + prose(9, 20) + "</p><p>" + " ".join(foot) + "</p>"  # the same run without its border
    assert extract(spark, [(1, "http://h.com/1", page), (5, "http://h.com/5", joined)])[5][0] == prose(9, 20)


def test_runs_by_brute_force(spark):
    """A word goes if it lies in 8 words, or a whole shorter block, that a differing stream of the host has too."""
    rows = [(i, f"http://h{i % 2}.com/", "<p>" + "</p><p>".join(prose(s, n) for s, n in ((i % 3, 12), (i, 12), (i % 4, 5), (i + 20, 12))) + "</p><nav>" + prose(i % 5, 9) + "</nav>") for i in range(12)]
    rows.append((50, "http://h0.com/again", rows[0][2]))
    got = extract(spark, rows)
    cut = {i: pages.blocks(h) for i, _, h in rows}
    host = {i: u.split("/")[2] for i, u, _ in rows}
    flat = {i: [w for t, _ in bs for w in t.split()] for i, bs in cut.items()}
    short = {i: {t for t, _ in bs if len(t.split()) < 8} for i, bs in cut.items()}
    for i, bs in cut.items():
        others = [j for j in cut if host[j] == host[i] and flat[j] != flat[i]]
        windows = {tuple(flat[j][k:k + 8]) for j in others for k in range(len(flat[j]) - 7)}
        gone = {p for k in range(len(flat[i]) - 7) if tuple(flat[i][k:k + 8]) in windows for p in range(k, k + 8)}
        at, want = 0, []
        for t, zone in bs:
            words = t.split()
            if len(words) < 8 and any(t in short[j] for j in others):
                gone |= set(range(at, at + len(words)))
            if zone == "o":
                want.append(" ".join(w for p, w in enumerate(words, at) if p not in gone))
            at += len(words)
        assert got[i][0] == "\n\n".join(t for t in want if t), i


def test_odd_pages(spark):
    rows = [(1, None, None), (None, "x", ""), (2, "http://a.com", "<p>" * 3000 + "deep"), (3, "http://a.com", "<div class='x" + "y" * 5000), (4, "", "just text &lt;b&gt; &#x1F642;"), (4, "", "just text &lt;b&gt; &#x1F642;")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    out = pages.extract(df).collect()
    assert len(out) == 6 and sum(r["text"] == "just text <b> 🙂" for r in out) == 2
    assert {r["page_id"]: r["text"] for r in out}[1] == "" and {r["page_id"]: r["text"] for r in out}[2] == "deep"
    assert pages.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_articles_are_judged_by_the_index(spark):
    """Boilerplate of the host goes from articles that share it; what only articles share, or more of them than frames, stays, as do runs of one article and short blocks."""
    call, quote, title, line = prose(1, 12), prose(2, 12), prose(3, 10), prose(4, 10)
    def page(i, more=""):
        quoted = f"<aside>{line}</aside>" if i < 2 else ""
        return f"<article><h1>Notes</h1><p>{prose(20 + i, 15)} {call} {quote}</p>{more}<p>{line}</p></article>{quoted}<aside><p>{title}</p><p>Notes</p></aside><footer>{call} {prose(50 + i, 9)}</footer>"
    rows = [(i, f"http://h.com/{i}", page(i)) for i in range(3)] + [(3, "http://h.com/3", page(3, f"<p>{title}</p>")), (4, "http://h.com/4", page(3, f"<p>{title}</p>"))]
    rows += [(i, "http://other.com/", page(i)) for i in (5, 6)]
    got = extract(spark, rows)
    for i in range(3):
        assert got[i][0] == f"Notes\n\n{prose(20 + i, 15)} {quote}\n\n{line}"
    assert got[3][0] == got[4][0] == f"Notes\n\n{prose(23, 15)} {quote}\n\n{title}\n\n{line}"
    assert got[5][0] == f"Notes\n\n{prose(25, 15)} {call} {quote}\n\n{line}"
