"""Main-text extraction: made sites with known texts, plain vectors, malformed pages."""

import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewell.llm import htmltext
from tidewell.llm.markup import HIDDEN, read

PAGES = "page_id long, url string, html string"


def essay(rnd, n=40):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def texts_of(spark, contents, host="h.example", **options):
    """The main texts of pages of one host (or of (host, html) pairs), in order."""
    rows = [(k, f"https://{c[0]}/{k}", c[1]) if isinstance(c, tuple) else (k, f"https://{host}/{k}", c) for k, c in enumerate(contents)]
    got = htmltext.main_text(spark.createDataFrame(rows, PAGES), **options).collect()
    assert len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


MENU = "<div class='a'><ul><li><a href='/'>Start here</a></li><li><a href='/b'>All books</a></li></ul></div>"
PLAIN = "<html><body>" + MENU + "<div class='b'><h1>{}</h1><p>{}</p><p>{}</p></div><div class='c'>Copyright of the house</div></body></html>"


def made(rnd, n, page=PLAIN):
    texts = [[essay(rnd, 6), essay(rnd), essay(rnd)] for _ in range(n)]
    return [page.format(*t) for t in texts], ["\n".join(t) for t in texts]


def test_names_decide_where_there_is_no_template(spark):
    page = "<html><head><style>p{{}}</style></head><body><nav><a href='/'>Home</a></nav><article><h1>Title {0}</h1><p>First  text {0} &amp; more words here.</p><p>Second text {0} goes on at length.</p></article><footer><p>All rights reserved</p></footer><script>x()</script></body></html>"
    contents = [(f"{i}.example", page.format(i)) for i in range(2)] + [("x", None), ("y", "")]
    want = [f"Title {i}\nFirst text {i} & more words here.\nSecond text {i} goes on at length." for i in range(2)]
    assert texts_of(spark, contents) == [*want, "", ""]


@pytest.mark.parametrize("n", [3, 10, 1000])
@pytest.mark.parametrize("shuffled", [False, True])
def test_plain_markup_without_telling_names(spark, n, shuffled):
    contents, want = made(random.Random(n), n)
    assert texts_of(spark, contents, **({"broadcast_tokens": 0} if shuffled else {})) == want
    # Without the template the menu and the last line stay.
    assert all("Start here" in "\n".join(htmltext.extract(read(c))) for c in contents[:3])


def test_one_page_alone_keeps_its_text(spark):
    contents, want = made(random.Random(1), 1)
    assert want[0] in texts_of(spark, contents)[0]


def test_template_decides_on_article_pages(spark):
    rnd = random.Random(5)
    page = "<html><body><nav><a href='/'>Home</a></nav><article><h1>{}</h1><p>{}</p><p>Sign up to the daily letter for more</p><p>{}</p></article><footer>Rights</footer></body></html>"
    contents, want = made(rnd, 6, page)
    assert texts_of(spark, contents) == want
    # The article is the same on every page; the text that varies stands elsewhere.
    page = "<html><body><article><p>A fixed teaser of some words</p></article><div class='q'><h1>{}</h1><p>{}</p><p>{}</p></div></body></html>"
    contents, want = made(rnd, 6, page)
    assert texts_of(spark, contents) == want
    assert "\n".join(htmltext.extract(read(contents[0]))) == "A fixed teaser of some words"


def test_main_slot_inside_a_form(spark):
    rnd = random.Random(6)
    page = "<html><body><div class='a'><p>%s</p></div><form id='f'><div class='b'><h1>{}</h1><p>{}</p><p>{}</p></div></form><div class='c'>%s</div></body></html>"
    texts = [[essay(rnd, 6), essay(rnd), essay(rnd)] for _ in range(6)]
    contents = [(page % (essay(rnd, 4), essay(rnd, 5))).format(*t) for t in texts]
    assert texts_of(spark, contents) == ["\n".join(t) for t in texts]


@pytest.mark.parametrize("each", [3, 12])
def test_every_template_of_a_host_is_found(spark, each):
    rnd = random.Random(7)
    pages, want = [], []
    own = {"x": "Prices are shown with all taxes", "y": "Replies close after thirty quiet days", "z": "Printed editions ship within one week"}
    for k in range(3 * each):
        a, b, kind = essay(rnd), essay(rnd), "xyz"[k % 3]
        pages.append(f"<html><body><div class='{kind}1'>{own[kind]}</div><div class='{kind}2'><h2>{a}</h2><p>{own[kind]}</p><p>{b}</p></div><div class='{kind}3'><p>End of page {kind}</p></div></body></html>")
        want.append(f"{a}\n{b}")
    # A line that a third of the pages has at a place that all have is no template: it may be any text.
    assert [t.replace(own["xyz"[k % 3]] + "\n", "") for k, t in enumerate(texts_of(spark, pages))] == want


@pytest.mark.parametrize("exact", [False, True])
def test_copies_of_a_page_are_no_template(spark, exact):
    rnd = random.Random(8)
    page = "<html><body><nav>{}</nav><article><p>{}</p><p>{}</p><p>{}</p></article></body></html>"
    copied = [essay(rnd) for _ in range(3)]
    rows = [copied] * (9 if exact else 3) + [[essay(rnd) for _ in range(3)] for _ in range(6)]
    contents = [page.format("one" if exact and k < 9 else essay(rnd, 3), *t) for k, t in enumerate(rows)]
    assert texts_of(spark, contents) == ["\n".join(t) for t in rows]


@pytest.mark.parametrize(
    "page",
    [
        "<main><div class='social-history'><p>{}</p></div></main>",
        "<article><section id='related-work'><p>{}</p></section></article>",
        "<article><section class='comments'><p>{}</p></section></article>",
        "<div class='ad'><p>{}</p></div>",
    ],
)
def test_a_name_alone_drops_nothing(spark, page):
    assert texts_of(spark, [(f"{k}.example", page.format(f"the text of page {k}")) for k in range(2)]) == ["the text of page 0", "the text of page 1"]


def test_comments_go_however_long(spark):
    rnd = random.Random(9)
    page = "<html><body><article><h1>{}</h1><p>{}</p><p>{}</p><section class='comments'><h3>Replies</h3>%s</section></article></body></html>"
    texts = [[essay(rnd, 6), essay(rnd), essay(rnd)] for _ in range(12)]
    contents = [(page % "".join(f"<div><p>{essay(rnd, 30)}</p></div>" for _ in range(k))).format(*t) for k, t in enumerate(texts)]
    assert texts_of(spark, contents) == ["\n".join(t) for t in texts]


def test_templates_are_those_of_plain_vectors(spark):
    """Class sizes and counts against dictionaries of whole occurrence vectors."""
    sf = "/root/testdata/sf0.001/pages.parquet"
    rows = spark.read.parquet(sf).withColumn("host", F.lower(F.regexp_extract("url", r"://([^/?#:]+)", 1))).withColumn("hash", F.xxhash64("host")).collect()
    by_host = defaultdict(dict)
    for r in rows:
        by_host[r["hash"]].setdefault(r.html, htmltext.tokens(read(r.html)))
    want = {}
    for host, pages in by_host.items():
        vectors, place = defaultdict(dict), {}
        for k, (elements, segments) in enumerate(pages.values()):
            for p, (n, *_) in elements.items():
                vectors[p, 0][k] = n
            for s, (n, _, p) in segments.items():
                vectors[p, s][k] = n
        sizes = Counter()
        for (_, s), v in vectors.items():
            sizes[tuple(v.items())] += 1 if s else 2
        for (p, s), v in vectors.items():
            at = len(vectors[p, 0])
            if len(v) >= (max(htmltext.FREQUENT, htmltext.SHARE * at) if s else 2):
                want[host, p, s] = (len(v), sum(c == 1 for c in v.values()), sizes[tuple(v.items())])
    frame = spark.read.parquet(sf).select(F.xxhash64(F.lower(F.regexp_extract("url", r"://([^/?#:]+)", 1))).alias("host"), F.xxhash64("html").alias("key"), "html").dropDuplicates(["host", "key"])
    counted = frame.mapInArrow(htmltext._count, htmltext._COUNTS).groupBy("host", "path", "seg")
    counted = counted.agg(*(F.sum(c).alias(c) for c in ("n", "once", "words", "a", "b")), F.max("parent").alias("parent"), F.max("flags").alias("flags"))
    got = {(r.host, r.path, r.seg): (r.n, r.once, r["size"]) for r in htmltext._frequent(counted).collect()}
    assert got == want and any(k[2] == 0 for k in got)


MALFORMED = ['<a "x', '<a b="x', "<a b='x> ", "<div>", "<noscript>", "<p>a", "</p>", '<a x="1" ', "<", "<div", '<a x="> ', "<!--", "<![CDATA[", "<span hidden>a</div>", "<ul><li>", "<table><td>"]


@pytest.mark.parametrize("piece", MALFORMED)
def test_time_is_in_proportion_to_a_malformed_page(piece):
    page = piece * (1_000_000 // len(piece)) + "'"
    began = time.perf_counter()
    htmltext.tokens(read(page))
    htmltext.extract(read(page))
    assert time.perf_counter() - began < 30


def test_unclosed_markup_keeps_the_text(spark):
    pages = ["<p>one <b>two<p>three", "<p title=\"x>four</p><p>five", "six < seven <3", "<ul><li>a<li>b</ul>c", "<p>a<span hidden>b</span>c", "<p hidden>no<p>yes", "<p>AT&<b>amp</b> &lt;b&gt;<![CDATA[&lt;]]>"]
    want = ["one two\nthree", "four\nfive", "six < seven <3", "a\nb\nc", "ac", "yes", "AT&amp <b>&lt;"]
    assert texts_of(spark, [(f"{k}.example", p) for k, p in enumerate(pages)]) == want


def test_awkward_tables(spark):
    frame = spark.createDataFrame([(1, None, "<p>a"), (None, "no url", "<p>b"), (1, None, "<p>a"), (2, "http://h/", "x " * 200_000)], PAGES)
    more = frame.withColumns({"host": F.lit(1), "text": F.lit("t"), "n_chars": F.lit("n"), "part": F.lit(None), "key": F.lit("k")})
    got = sorted((r.page_id or 0, r.text) for r in htmltext.main_text(more).collect())
    assert got == [(0, "b"), (1, "a"), (1, "a"), (2, ("x " * 200_000).strip())]
    assert htmltext.main_text(frame.limit(0)).count() == 0


def test_renamed_articles_give_the_same_texts(spark):
    """On the pages of a whole table the template finds the slot without the help of its name."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    plain = pages.withColumn("html", F.regexp_replace("html", "<(/?)article>", "<$1div>"))
    a = {r.page_id: r.text for r in htmltext.main_text(pages).collect()}
    b = {r.page_id: r.text for r in htmltext.main_text(plain).collect()}
    same = sum(a[k] == b[k] for k in a)
    assert same >= 0.9 * len(a)
    assert not any(read(r.html).flags[-1] & HIDDEN for r in pages.limit(5).collect())


def test_numbered_classes_shared_headings_paragraphs_and_near_copies(spark):
    """A host per case; all are read in one run."""
    rnd = random.Random(12)
    rows, want = [], []

    def host(name, pages, texts):
        rows.extend((f"{name}.example", p) for p in pages)
        want.extend("\n".join(t) for t in texts)

    for n in (3, 10, 40):
        texts = [[essay(rnd), essay(rnd)] for _ in range(n)]
        host(f"columns{n}", [f"<html><body><div class='col-md-8'><p>{a}</p><p>{b}</p></div><div class='col-md-4'><p>{essay(rnd, 12)}</p></div></body></html>" for a, b in texts], texts)
    for near, n in ((2, 2), (3, 3), (3, 4), (3, 6), (5, 10), (3, 8)):
        copied = [essay(rnd), essay(rnd)]
        texts = [copied if k < near else [essay(rnd), essay(rnd)] for k in range(n)]
        host(f"near{near}of{n}", [f"<html><body><nav>menu {k}</nav><article><p>{a}</p><p>{b}</p></article></body></html>" for k, (a, b) in enumerate(texts)], texts)
    page = "<html><body><nav><a href='/'>Home</a></nav><article>{}</article><footer>All rights</footer></body></html>"
    shared = essay(rnd, 15)
    texts = [["Weekly report", essay(rnd), *([shared] if k % 2 else []), essay(rnd)] for k in range(10)]
    host("report", [page.format(f"<h2>{t[0]}</h2>" + "".join(f"<p>{x}</p>" for x in t[1:])) for t in texts], texts)
    for name in ("comments", "menu", "cookie", "footer"):
        texts = [[essay(rnd) + ".", essay(rnd) + "."]]
        more = "".join(f"<p>{essay(rnd, 30)}.</p>" for _ in range(8))
        host(name, [f"<html><body><article><p>{t[0]}</p><p>{t[1]}</p><section class='{name}'>{more}</section></article></body></html>" for t in texts], texts)
    assert texts_of(spark, rows) == want


def test_all_numbered_elements_of_a_table(spark):
    """Menu, advert, article and footer as numbered ``div`` elements: nearly all pages keep their texts."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = F.col("html")
    for i, tag in enumerate(("nav", "aside", "article", "footer"), 1):
        html = F.regexp_replace(F.regexp_replace(html, f"<{tag}[^>]*>", f"<div class='k{i}'>"), f"</{tag}>", "</div>")
    a = {r.page_id: r.text for r in htmltext.main_text(pages).collect()}
    b = {r.page_id: r.text for r in htmltext.main_text(pages.withColumn("html", html)).collect()}
    assert sum(a[k] == b[k] for k in a) >= 0.95 * len(a)


def test_the_passage_of_a_page():
    long, short, named = "w " * 25, "v " * 5, "n " * 90
    assert htmltext.passage(read(f"<nav><p>{named}</p></nav><p>{short}</p><p>{long}</p>")) == long.strip()
    assert htmltext.passage(read(f"<div class='cookie'>{named}</div><p>{short}</p>")) is None and htmltext.passage(read(None)) is None
