"""Main text and fixity of pages."""

import html
import re
from collections import Counter

import duckdb
import pytest

from tidewater.llm import fixity, wrappers


def plain(page):
    body = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    body = re.sub(r"</?(p|h1|br)>", "\x01", body)
    body = re.sub(r"</?[a-zA-Z][^>]*>", "", body)
    blocks = (re.sub(r"[ \t\n\r\x0b\x0c]+", " ", html.unescape(b)).strip() for b in body.split("\x01"))
    return " ".join(b for b in blocks if b)


def test_main_text_of_tables(spark, sf):
    rows = duckdb.sql(f"select page_id, url, html from '{sf}/pages.parquet'").fetchall()
    got = [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in wrappers.op6_main_text(spark, sf).collect()]
    assert Counter(got) == Counter((i, u, plain(h), len(plain(h))) for i, u, h in rows)


def page(text, extra="", n=3):
    paragraphs = "".join(f"<p>{text} {k}</p>" for k in range(n))
    return f'<html><body><div class="menu"><a>Home</a></div><div>Site name</div><div>{paragraphs}</div>{extra}<div id="comments"><p>nice!</p></div><div>All rights reserved</div></body></html>'


def test_wrapper_tells_frame_from_slots():
    pages = [page("alpha"), page("beta", '<div class="notice">x</div>'), page("gamma", n=5), page("delta", "<table><tr><td>q</td></tr></table>")]
    frame = wrappers.fit(pages)
    assert {"Site name", "All rights reserved", "Home"} <= frame
    assert wrappers.main_text(pages[2], frame) == " ".join(f"gamma {k}" for k in range(5))
    assert wrappers.main_text(pages[3], frame) == "delta 0 delta 1 delta 2 q"


def test_alignment_makes_repeats_and_options():
    one, five = wrappers.tokens(page("a", n=1)), wrappers.tokens(page("b", n=5))
    assert any(x[0] == "rep" for x in wrappers.align(one, five))
    with_table = wrappers.tokens(page("c", "<table><tr><td>q</td></tr></table>"))
    assert any(x[0] == "opt" for x in wrappers.align(wrappers.tokens(page("d")), with_table))


@pytest.mark.parametrize(
    "text,want",
    [
        ("<article><p>a &amp; b&nbsp;c<br>d <b>e</b>f</article><aside>x</aside>", "a & b c d ef"),
        ("<article><h1>T</h1><script>var a='<p>no</p>'</script><style>p{}</style><!-- c --><form><p>f</p></form><p>x\n y</p></article>", "T x y"),
        ("<nav>n</nav><main><p>m<p>k</main><footer>z</footer>", "m k"),
        ("no tags &lt;at&gt; all", "no tags <at> all"),
        ("", ""),
        ("<article><p>1</p><div class='ad'>buy</div><section id=comments><p>c</p></section><p>2</p></article>", "1 2"),
        ("<article><p>a < b</p></article>", "a < b"),
        ("<article>\n<p><b>a</b> <i>b</i>\n<u>c</u><s>d</s></p> <p> </p>\n<p>e</p></article>", "a b cd e"),
    ],
)
def test_small_pages(text, want):
    assert wrappers.main_text(text, set()) == want


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rows = [(1, "http://a.b/c", page("x")), (1, "http://a.b/c", page("x")), (2, None, None), (3, "http://A.B/", ""), (None, "nohost", "<p>y</p>"), (4, "http://a.b/d", "<p>" + "word " * 200000 + "</p>"), (102, "u", "corrupt this page, please"), (96, "u", None), (185, "u", "cut the end of this")]
    d = str(tmp_path_factory.mktemp("pages"))
    for name, data in (("full", rows), ("none", [])):
        spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 wr_host", "2 fx_id").repartition(2).write.parquet(f"{d}/{name}/pages.parquet")
    return d


def test_odd_pages(spark, odd):
    got = Counter((r["page_id"], r["text"][:20], r["n_chars"]) for r in wrappers.op6_main_text(spark, f"{odd}/full").collect())
    assert got[2, "", 0] == got[3, "", 0] == got[None, "y", 1] == got[4, ("word " * 4), 999999] == 1 and sum(got.values()) == 9
    assert wrappers.op6_main_text(spark, f"{odd}/none").count() == 0


def test_audit(spark, sf, odd):
    for d in (sf, f"{odd}/full", f"{odd}/none"):
        con = duckdb.connect()
        con.sql(f"create view pages as select * from '{d}/pages.parquet{'' if d == sf else '/*.parquet'}'")
        want = Counter(con.sql(fixity.OP8_SQL).fetchall())
        assert Counter(map(tuple, fixity.op8_merkle_audit(spark, d).collect())) == want


def test_missing_and_extra_records(spark):
    a = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "id long, t string")
    b = spark.createDataFrame([(i, f"text {i}" if i != 7 else "TEXT 7") for i in range(301) if i != 250], "id long, t string")
    got = {(r["id"], r["status"]) for r in fixity.audit(a, b, "id", ["t"], 8).collect() if r["status"] != "moved"}
    assert got == {(7, "corrupt"), (250, "missing"), (300, "extra")}
    assert fixity.audit(a, a, "id", ["t"]).count() == 0


def site(words, k, ad="buy now", cls="header-story"):
    """A site whose names mislead: the story stands in a div named like a header, a teaser in <article>, and a slogan in the story is on all pages."""
    story = "".join(f"<p>{words} number {k} part {j} goes on for a while</p>" for j in range(16 + k % 5))
    note = "<p>extra</p>" if k % 2 else ""
    return f'<html><body><div class="top">Site of things</div><article>teaser {k}</article><div class="{cls}"><div>Our slogan here</div>{story}{note}</div><div>{ad} {k % 3}</div><footer>all rights {k}</footer></body></html>'


def test_wrapper_decides_the_region(spark):
    rows = [(k, "http://odd.example/x", site(f"story {k * 7}", k)) for k in range(30)] + [(100, "http://one.example/", site("lonely", 1))]
    got = {r["page_id"]: r["text"] for r in wrappers.with_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), group=4).collect()}
    for k in range(30):
        want = [f"story {k * 7} number {k} part {j} goes on for a while" for j in range(16 + k % 5)] + ["extra"] * (k % 2)
        assert got[k] == " ".join(want)
        assert wrappers.main_text(rows[k][2], set()) == f"teaser {k}"  # what tags alone say
    told = {r["wr_host"]: r for r in wrappers.wrappers(spark.createDataFrame(rows, "page_id long, url string, html string"), group=4).collect()}
    assert told["odd.example"]["wr_region"] == "body:1/div.header-story:1"
    assert {"Our slogan here", "Site of things"} <= set(told["odd.example"]["wr_frame"])


def test_named_parts_of_an_article(spark):
    article = lambda k: f'<body><article><h1>Title {k}</h1><div class="share-story" data-id="ad-1">' + "".join(f"<p>text {k} {j} is long enough</p>" for j in range(9)) + f'</div><div class="share">tell {k}</div><p data-id="menu">ad-hoc {k}</p></article></body>'
    rows = [(k, "http://a.example/x", article(k)) for k in range(6)]
    got = {r["page_id"]: r["text"] for r in wrappers.with_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(6):
        assert got[k] == f"Title {k} " + " ".join(f"text {k} {j} is long enough" for j in range(9)) + f" ad-hoc {k}"


DOUBTED = ['<p class="ad-hoc">{}</p>', '<div class="share-price">{}</div>', '<div id="related-work">{}</div>', '<section class="comment-on-law">{}</section>', '<figure class="header-image">{}</figure>']
CERTAIN = ['<p class="ad">{}</p>', '<div class="x share-buttons">{}</div>', '<div id="comment-list">{}</div>', '<section role="banner">{}</section>', '<div class="ad-unit-3">{}</div>']


@pytest.mark.parametrize("pages", [1, 6])
def test_names_in_doubt_stay_in_an_article(spark, pages):
    """With one page of a host, which no wrapper tells anything of, and with several."""
    article = lambda k: f"<body><div class=share-price>not this</div><article><h1>Title {k}</h1><div class=text>" + "".join(f"<p>long text {k} {j} of the article</p>" for j in range(9)) + "</div>" + "".join(d.format(f"stays {k} {j}") for j, d in enumerate(DOUBTED)) + "".join(d.format(f"goes {k} {j}") for j, d in enumerate(CERTAIN)) + f"<p>the end {k}</p></article></body>"
    rows = [(k, "http://a.example/x", article(k)) for k in range(pages)]
    got = {r["page_id"]: r["text"] for r in wrappers.with_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(pages):
        want = f"Title {k} " + " ".join(f"long text {k} {j} of the article" for j in range(9)) + "".join(f" stays {k} {j}" for j in range(5)) + f" the end {k}"
        assert got[k] == want and wrappers.main_text(rows[k][2], set()) == want


def test_names_in_doubt_go_outside():
    assert wrappers.main_text("<body><div class=header-image>x</div><p>y</p></body>", set()) == "y"
    assert [wrappers.naming(x) for x in ("ad", "x ad-unit", "ad-hoc", "ad-hoc ad", "adhoc", "")] == [".ad", ".ad", ".?ad", ".ad", "", ""]


def test_streams_beyond_the_longest(spark):
    """Long pages of like elements are folded and so aligned; one that nothing folds is extracted with and without the region of its host."""
    part = lambda n: "".join(f"<li>{''.join(f'<{t}>{j}</{t}>' for t in 'abcdefgh')}</li>" for j in range(n))
    short, long_ = (wrappers.stream(wrappers.labelled(f"<ul>{part(n)}</ul>")) for n in (2, 900))
    assert len(long_) < 40 < wrappers.LONGEST < len(wrappers.folded(wrappers.tokens(f"<ul>{part(900)}</ul>")))
    assert wrappers.folded_elements(short) == long_
    uneven = "".join(f"<p>{'<b>w</b>' * (j % 7)}{'<i>v</i> <u>t</u>' * (j % 5)} n{j}</p>" for j in range(3000))
    assert len(wrappers.stream(wrappers.labelled(uneven))) > wrappers.LONGEST
    text = " ".join(f"{'w' * (j % 7)}{'v t' * (j % 5)} n{j}".strip() for j in range(3000))
    huge = f'<html><body><div class="top">Site of things</div><article>teaser</article><div class="header-story"><div>Our slogan here</div>{uneven}</div><footer>f</footer></body></html>'
    rows = [(k, "http://odd.example/x", site(f"story {k * 7}", k)) for k in range(30)] + [(90, "http://odd.example/x", huge), (91, "http://b.example/", f"<article>{uneven}</article>")]
    got = {r["page_id"]: r["text"] for r in wrappers.with_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), group=4).collect()}
    assert got[90] == got[91] == text


def free(k, n=1200):
    """Paragraphs of a form that nothing folds, other ones on each page, and their text."""
    counts = [((j * (k + 3)) % 7, (j * j + k) % 5) for j in range(n)]
    html_ = "".join(f"<p>{'<b>w</b>' * a}{'<i>v</i> <u>t</u>' * b} n{k}.{j}</p>" for j, (a, b) in enumerate(counts))
    return html_, " ".join(f"{'w' * a}{'v t' * b} n{k}.{j}".strip() for j, (a, b) in enumerate(counts))


def test_hosts_of_long_pages_have_a_wrapper(spark):
    """No stream is too long to be aligned: also a host that has only such ones has a region and frame texts."""
    long_ = lambda html_: f'<html><body><div class="top">Site of things</div><article>teaser</article><div class="header-story"><div>Our slogan here</div>{html_}</div><footer>f</footer></body></html>'
    rows = [(k, "http://long.example/x", long_(free(k)[0])) for k in range(6)]
    assert all(len(wrappers.stream(wrappers.labelled(h))) > wrappers.LONGEST for _, _, h in rows)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    told = wrappers.wrappers(pages, group=4).collect()
    assert [(r["wr_host"], r["wr_region"]) for r in told] == [("long.example", "body:1/div.header-story:1")]
    assert {"Our slogan here", "Site of things"} <= set(told[0]["wr_frame"])
    got = {r["page_id"]: r["text"] for r in wrappers.with_main_text(pages, group=4).collect()}
    assert got == {k: free(k)[1] for k in range(6)}


def test_all_streams_of_a_shape_are_aligned(spark):
    """A text that one page of many has otherwise is no frame, whichever page it is."""
    body = lambda k, odd: f"<html><body><h1>All rights reserved</h1><div><p>text {k:02} of the page</p></div><h2>{'Another note' if k == odd else 'The note'}</h2></body></html>"
    rows = [(f"http://h{odd}.example/", body(k, odd)) for odd in range(20) for k in range(20)]
    told = {r["wr_host"]: r["wr_frame"] for r in wrappers.wrappers(spark.createDataFrame(rows, "url string, html string").repartition(3)).collect()}
    assert told == {f"h{odd}.example": ["All rights reserved"] for odd in range(20)}


def test_alignment_takes_time_in_proportion():
    import time

    pages = [wrappers.stream(wrappers.labelled(free(k, 8000)[0])) for k in range(3)]
    assert min(map(len, pages)) > 60_000
    began = time.perf_counter()
    whole = wrappers.merged(pages)
    wrappers.align([("<", f"a{i}") for i in range(100_000)], [("<", f"a{i}") for i in range(100_000, 0, -1)])
    assert time.perf_counter() - began < 10
    assert wrappers.size(whole) <= min(map(len, pages))


def test_wide_wrappers_keep_what_all_pages_share(monkeypatch):
    pages = [wrappers.stream(wrappers.labelled(page(t, e, n))) for t, e, n in (("a", "", 1), ("b", "<ul><li>x</li></ul>", 4), ("c", "<hr>", 2), ("d", "<table><tr><td>q</td></tr></table>", 2))]
    whole = wrappers.merged(pages)
    monkeypatch.setattr(wrappers, "WIDEST", 10)
    least = wrappers.merged(pages)
    assert wrappers.size(least) < wrappers.size(whole) and wrappers.frame_texts(least) == wrappers.frame_texts(whole) == ["All rights reserved", "Home", "Site name", "nice!"]


def test_alignment_of_wrappers_and_long_groups():
    long_ = lambda n: [x for _ in range(n) for x in [("<", "li"), *[y for t in "abcdefgh" for y in (("<", t), ("", t), (">", t))], (">", "li")]]
    assert [x[0] for x in wrappers.align(long_(1), long_(4))] == ["rep"]
    pages = [wrappers.stream(wrappers.labelled(page(t, e, n))) for t, e, n in (("a", "", 1), ("b", "", 4), ("c", "<hr>", 2), ("d", "<table><tr><td>q</td></tr></table>", 2))]
    whole = wrappers.merged([wrappers.merged(pages[:2]), wrappers.merged(pages[2:])])
    assert {"Site name", "All rights reserved"} <= set(wrappers.frame_texts(whole))


@pytest.mark.parametrize("hostile", ["<a" * 500_000, "<a " * 300_000 + '"', '<a b="' * 200_000, "<div>x" * 100_000, "<!--" * 200_000, "<script>" * 100_000, "<p><b>t" * 100_000, "</x>" * 200_000 + "<x>", "<a '>x" * 150_000])
def test_linear_time(hostile):
    import time

    began = time.perf_counter()
    wrappers.main_text(hostile, set())
    wrappers.masses(wrappers.labelled(hostile), set())
    wrappers.stream(wrappers.labelled(hostile))
    assert time.perf_counter() - began < 30


def test_descent_follows_paths_only(spark):
    rows = [(i, f"text {i}") for i in range(5000)]
    faults = {17, 18, 2500, 4999}
    a = spark.createDataFrame(rows, "id long, t string")
    b = spark.createDataFrame([(i, t[:-1] if i in faults else t) for i, t in rows], "id long, t string")
    trees = [fixity.tree(fixity.placed(fixity.records(d, "id", ["t"]))) for d in (a, b)]
    levels = fixity.descent(*trees)
    visited = sum(x.count() for x in levels)
    assert visited <= 1 + len(faults) * len(levels) * fixity.FANOUT < len(rows) / 20
    assert {r["no"] for r in levels[-1].filter("differs").collect()} == faults
    assert {(r["id"], r["status"]) for r in fixity.audit(a, b, "id", ["t"]).collect()} == {(i, "corrupt") for i in faults}


def test_audit_of_any_ids(spark):
    rows = [(f"id{i}" if i % 3 else None, f"text {i}") for i in range(400)]
    a = spark.createDataFrame(rows, "id string, t string")
    b = spark.createDataFrame([(i, "x" if t == "text 7" else t) for i, t in rows], "id string, t string")
    assert {(r["id"], r["status"], r["length"]) for r in fixity.audit(a, b, "id", ["t"]).collect()} == {("id7", "corrupt", 6)}
    wide = [(i * 2**52 - 2**62, f"t{i}") for i in range(1000)]
    wide += [(10**18 * 4, "stray")]
    placed = fixity.placed(fixity.records(spark.createDataFrame(wide, "id long, t string"), "id", ["t"])).collect()
    order = sorted(wide)
    assert sorted((r["fx_no"], r["fx_id"]) for r in placed) == [(i, w[0]) for i, w in enumerate(order)]
    ends = [sum(len(w[1]) for w in order[:i]) for i in range(len(order))]
    assert [r["fx_offset"] for r in sorted(placed, key=lambda r: r["fx_no"])] == ends
    assert [r["status"] for r in fixity.audit(a, a, "id", ["t"]).collect()] == []


def test_audit_of_a_very_long_payload(spark):
    a = spark.createDataFrame([(1, "x" * 20_000_000), (2, "y")], "id long, t string")
    b = spark.createDataFrame([(1, "x" * 19_999_999 + "z"), (2, "y")], "id long, t string")
    assert [tuple(r) for r in fixity.audit(a, b, "id", ["t"]).collect()] == [(1, 0, 0, 20_000_000, "corrupt")]
