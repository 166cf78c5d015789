"""Main text of pages: one rule at a time, and templates of hosts."""

from __future__ import annotations

import pytest
from awkward import outcome

from lyrebird.llm.extraction import extracted, host_of, main_text

PAGES = {
    "<article><h1>T</h1><p><b>a<br><p>b  c</p></article><footer>x</footer>": "T a b c",
    "<nav><ul><li>m</nav><div class=ad>x</div><main><p>a<i>b</i>&amp;&eacute;&#x41;</p></main>": "ab&éA",
    "<header>site</header><article><header><h1>T</h1></header><p>x</p></article>": "T x",
    "<article>a<script>var t='</p>';</script><style>p{}</style><!-- c -->b<form>f</form></article>": "a b",
    "<article><p>a</p><div class='comments'><article>nice</article></div><aside>s</aside></article><div id=sidebar>q</div>": "a",
    "<div class='cookie-notice'>We use</div><p>text</p><div class='site-footer'>f</div>": "text",
    "<p title='a>b'>x</p><p>y<": "x y<",
    "no tags at all\n here": "no tags at all here",
    "<title>t</title>": "",
    "": "",
    "<article><table><tr><td>1<td>2<tr><td>3</table></article>": "1 2 3",
    "<article><p>5 &lt; 6 &copy; &unknown; a&nbsp;b</p></article>": "5 < 6 © &unknown; a b",
    "<body class='home sidebar'><div class='no-sidebar'><p>x</p><p class='author-sidebar'>y</p></div>": "x",
    "<article hidden>x</article><p>y</p>": "y",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    assert main_text(page) == (PAGES[page], False)


def test_hosts():
    assert [host_of(u) for u in ("http://A.b/c", "https://u@h:80/x", "//h/x", "x", None, "")] == ["a.b", "h", "h", "", "", ""]


def test_templates_and_odd_tables(spark):
    body = "<div class=wrap><div class=top>Our site</div><div class=links><a href=/a>one{0}</a><a href=/b>two{0}</a></div><div class=story><p>story {0} goes on</p><p>and ends {0}</p></div></div>"
    rows = [(i, f"http://h{i % 2}.org/{i}", body.format(i)) for i in range(20)]
    rows += [(100, "http://alone.org", "<p>only</p>"), (101, None, None), (102, "", ""), (103, "http://h0.org/q", None), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = extracted(pages)
    wanted = [(i, u, f"story {i} goes on and ends {i}" if u and "//h" in u and h else "only" if i == 100 else "") for i, u, h in rows]
    assert [(a, b, c) for a, b, c, *_ in outcome(got)] == sorted(wanted, key=lambda r: tuple((v is None, str(v)) for v in r))
    assert all(r.n_chars == len(r.text) for r in got.collect())
    from pyspark.sql import functions as F

    odd = pages.select("*", *[F.lit("x").alias(c) for c in ("host", "path", "main", "text", "n_chars", "_host")])
    assert outcome(extracted(odd)) == outcome(got)
    assert extracted(pages.where("false")).count() == 0


def test_many_templates_are_joined(spark, monkeypatch):
    from lyrebird.llm import extraction

    rows = [(i, f"http://h{i % 3}.org/{i}", f"<div class=x>menu</div><div class=y><p>text {i} text</p></div>") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    plain = outcome(extracted(pages))
    monkeypatch.setattr(extraction, "BROADCAST_BYTES", -1)
    assert outcome(extracted(pages)) == plain


def test_template_decides_before_article_tags(spark):
    page = (
        "<body><div class=wrap><article><h1>title {0}</h1><div class=box>We use the same words everywhere, share this</div><p>story {0} goes on and on</p><p>and ends {0}</p>"
        "<ul class=more><li><a href=/x{0}>more of {0}</a></ul><div class=comments><p>nice {0}</p></div></article></div><div class=ad>buy {0}</div></body>"
    )
    odd = "<body><div class=wrap><article><p>tale</p></article></div></body>"
    named = "<body><p>top {0}</p><div class=social-studies><h1>t {0}</h1><p>lesson {0} is long enough to be an article, with some more words</p></div></body>"
    rows = [(i, f"http://a.org/{i}", page.format(i)) for i in range(30)] + [(50 + i, f"http://b.org/{i}", named.format(i) + "<p>x</p>" * (i % 2)) for i in range(5)]
    rows += [(100 + i, "http://copies.org", page.format(7)) for i in range(2)] + [(200, "http://a.org", odd)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extracted(pages).collect()}
    assert [got[i] for i in range(30)] == [f"title {i} story {i} goes on and on and ends {i}" for i in range(30)]
    assert all(got[50 + i].startswith(f"t {i} lesson {i} is long enough to be an article, with some more words") for i in range(5))
    assert got[100] == got[101] and "story 7 goes on and on" in got[100]  # copies have no template
    assert got[200] == "tale"


@pytest.mark.parametrize("joined", [False, True])
def test_containers_named_after_their_page(spark, monkeypatch, joined):
    from lyrebird.llm import extraction

    if joined:
        monkeypatch.setattr(extraction, "BROADCAST_BYTES", -1)
    page = "<body><div class=w-1/2><div class=by>by {1} on day {0}</div><div id='post-{1}' class='{1} entry'><h1>title {1}</h1><p>story {1} goes on and on</p><{2}>and it ends with {1}</{2}></div></div></body>"
    names = ["".join(chr(97 + int(d)) for d in f"{i:03}") for i in range(60)]
    rows = [(i, f"http://h.org/{n}", page.format(i, n, "section" if i == 7 else "p")) for i, n in enumerate(names)]
    got = {r.page_id: r.text for r in extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"title {n} story {n} goes on and on and it ends with {n}" for i, n in enumerate(names))


def test_text_of_rare_paths_counts(spark):
    page = "<body><div class=w><div class=by>by {1}, day {0}</div><div class=x><{2}>story {1} goes on and on for many words and ends</{2}></div></div></body>"
    kinds = ["section", "figure", "pre", "blockquote", "address", "center", *[f"x-{c}" for c in "abcdefghijklmnopqrstuvwxyz"]]
    rows = [(i, f"http://h.org/{i}", page.format(i, f"name{i}", kinds[i % len(kinds)])) for i in range(64)]
    got = {r.page_id: r.text for r in extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"story name{i} goes on and on for many words and ends" for i in range(64))


PLAIN = (
    "<body><div><div>Our site</div><div><a href=/{0}>one {0}</a> <a href=/b>two {0}</a></div></div>"
    "<div><h2>title {0}</h2><p>story {0} goes on and on</p><p>Tell your friends</p>{1}<p>and ends with {0}</p></div><div>All rights reserved, {0}</div></body>"
)
FLAT = "<body><p>Welcome to all</p><h1>title {0}</h1><p>story {0} goes on and on, as long as it is</p>{1}<p>Read on</p><p><a href=/{0}>another story than {0} that can be read</a></p><p>The end</p></body>"


@pytest.mark.parametrize("page", [PLAIN, FLAT])
def test_hosts_without_telling_names(spark, page):
    rows = [(i, f"http://h.org/{i}", page.format(f"n{i}", f"<p>more of n{i}</p>" * (i % 3))) for i in range(12)]
    got = {r.page_id: r for r in extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        more = " ".join([f"more of n{i}"] * (i % 3))
        wanted = f"title n{i} story n{i} goes on and on {more} and ends with n{i}" if page == PLAIN else f"title n{i} story n{i} goes on and on, as long as it is {more}"
        assert got[i].text == " ".join(wanted.split()) and got[i].by_template


@pytest.mark.parametrize("name", ["alert", "legal-analysis", "share-price", "hidden-gems", "search-results", "commentary"])
def test_article_text_stays(name):
    assert main_text(f"<article><p class={name}>not lost</p><p>kept <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p></article>")[0] == "not lost kept x=1"


def test_given_pages_against_their_articles(spark):
    """All given pages have one article; its text is what stands between tags."""
    import html
    import re

    from lyrebird.staging import table

    pages = table(spark, "/root/testdata/sf0.01", "pages")
    inner = {r.page_id: re.search(r"<article>(.*?)</article>", r.html, re.S).group(1) for r in pages.collect()}
    got = extracted(pages).collect()
    for r in got:
        blocks = re.split(r"</?(?:p|h1|div)\b[^>]*>", inner[r.page_id])
        assert r.text == " ".join(filter(None, (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks)))
    assert sum(r.by_template for r in got) > 100


def test_templates_against_plain_vectors(spark):
    """What Spark sums up against whole occurrence vectors in plain Python, for two hosts."""
    from lyrebird.llm import extraction as X

    pages = {h: [(f"http://{h}/{i}", page.format(f"n{i}", f"<p>more of n{i}</p>" * (i % 3)) + "<hr><p>Now and then</p>" * (i % 4 > 0)) for i in range(9)] for h, page in (("a.org", PLAIN), ("b.org", FLAT))}
    rows = [(i, u, p) for i, (u, p) in enumerate(x for own in pages.values() for x in own)]
    found = {r.host: r for r in X.host_templates(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    for host, own in pages.items():
        known = {"words": (), "split": found[host].split}
        vectors: dict = {}
        for i, (_, page) in enumerate(own):
            read = X.Page(page, frozenset(), frozenset(known["split"]))
            for token in [p for p, _ in read.starts] + [X._token(b[0].path, X._joined(b)) for b in read.blocks()]:
                vectors.setdefault(token, [0] * len(own))[i] += 1
        often = {t: v for t, v in vectors.items() if sum(map(bool, v)) >= X.SUPPORT * len(own)}
        assert found[host].single == sorted(t for t, v in often.items() if isinstance(t, str) and max(v) == 1)
        assert found[host].texts == sorted(t for t in often if not isinstance(t, str))
        assert found[host].cuts == sorted(t for t, v in often.items() if not isinstance(t, str) and max(v) == 1)
        assert len(set(map(tuple, often.values()))) >= 2  # several classes
    assert found["a.org"].split == ["/body>div", "/body/div[1]>div"]


SITE = "<body><div{0}>Our site <a href=/>home</a> <a href=/b>news</a></div><{5}{1}><h1>{2}</h1>{3}</{5}><div>Buy our things today</div><div{4}>All rights reserved</div></body>"


def site_page(title: str, paragraphs: list[str], named: bool) -> str:
    names = (' class="nav"', ' class="story"', ' class="footer"') if named else ("", "", "")
    return SITE.format(names[0], names[1], title, "".join(f"<p>{p}</p>" for p in paragraphs), names[2], "article" if named else "div")


def long_text(seed: int, n: int = 30) -> str:
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def check_hosts(spark, hosts: list[list[tuple[str, list[str]]]], named: bool) -> None:
    """Every page's text is its title and paragraphs, whatever the others of its host are."""
    rows, wanted = [], {}
    for h, own in enumerate(hosts):
        for title, paragraphs in own:
            wanted[len(rows)] = " ".join([title, *paragraphs])
            rows.append((len(rows), f"http://h{h}.org/{len(rows)}", site_page(title, paragraphs, named)))
    got = {r.page_id: r.text for r in extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == wanted


@pytest.mark.parametrize("named", [True, False])
def test_text_that_recurs_on_a_host_stays(spark, named):
    shared = [long_text(1000), long_text(1001)]
    hosts = []
    for share, of in ((2, 2), (3, 3), (3, 5), (2, 4), (5, 5), (7, 7)):
        # an opening paragraph, a closing one, and both
        for before, after in ((shared[:1], []), ([], shared[:1]), (shared[:1], shared[1:])):
            pages = [(f"title {len(hosts)} {i}", [*(before if i < share else []), long_text(i + 50 * len(hosts)), long_text(i + 20 + 50 * len(hosts)), *(after if i < share else [])]) for i in range(of)]
            hosts.append(pages)
    check_hosts(spark, hosts, named)


def test_one_article_on_many_pages_of_a_host(spark):
    """The paragraphs are the same on three pages of four, under titles of their own."""
    hosts = [[(f"title {of} {i}", [long_text(1), long_text(2)] if i < share else [long_text(60 + i), long_text(70 + i)]) for i in range(of)] for share, of in ((3, 4), (2, 3), (2, 2), (4, 5), (3, 3))]
    check_hosts(spark, hosts, True)


@pytest.mark.parametrize("named", [True, False])
def test_pages_that_are_crawled_again(spark, named):
    """Copies on hosts of two to five pages; their menu stays out, and other pages are as without them."""
    hosts = []
    for copies, others in ((3, 2), (2, 2), (2, 3), (4, 1), (2, 1)):
        again = (f"again {len(hosts)}", [long_text(len(hosts)), long_text(100 + len(hosts))])
        hosts.append([again] * copies + [(f"other {len(hosts)} {i}", [long_text(200 + i), long_text(300 + i)]) for i in range(others)])
    check_hosts(spark, hosts, named)
    if named:
        check_hosts(spark, [[("only", [long_text(5)])] * 3], named)


@pytest.mark.parametrize("seed", [1, 2])
def test_made_up_hosts_against_what_they_were_made_of(spark, seed):
    """Hosts of two to thirty pages without a telling name, whose templates and articles are drawn at random."""
    import random

    rng, rows, wanted = random.Random(seed), [], {}
    for h in range(14):
        of = rng.choice([2, 3, 4, 5, 8, 30])
        tag, depth = rng.choice(["div", "section", "center"]), rng.randrange(1, 4)
        menu = "".join(f"<li><a href=/{k}>item {k}</a></li>" for k in range(rng.randrange(2, 6)))
        before = [f"<div><ul>{menu}</ul></div>", f"<div>{long_text(900 + h, 6)}</div>"][: rng.randrange(1, 3)]
        after = [f"<div>{long_text(950 + h, 12)}</div>", "<div><a href=/x>imprint</a></div>"][: rng.randrange(1, 3)]
        common = [long_text(5000 + 10 * h + k, 12) for k in range(3)]
        for i in range(of):
            paragraphs = [long_text(10_000 * h + 10 * i + k, rng.randrange(20, 60)) for k in range(rng.randrange(2, 6))]
            if rng.random() < 0.5 and of < 8:
                paragraphs.insert(rng.randrange(len(paragraphs) + 1), rng.choice(common))
            body = f"<{tag}>" * depth + f"<h2>title {h} {i}</h2>" + "".join(f"<p>{p}</p>" for p in paragraphs) + f"</{tag}>" * depth
            wanted[len(rows)] = " ".join([f"title {h} {i}", *paragraphs])
            rows.append((len(rows), f"http://h{h}.org/{i}", f"<html><body>{''.join(before)}{body}{''.join(after)}</body></html>"))
    got = {r.page_id: r.text for r in extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got == wanted


def test_copies_change_no_page(spark):
    body = lambda i: site_page(f"title {i}", [long_text(i), long_text(40 + i)], False)
    rows = [(i, f"http://h.org/{i}", body(i)) for i in range(5)]
    frame = lambda r: spark.createDataFrame(r, "page_id long, url string, html string")
    once = {r.page_id: r.text for r in extracted(frame(rows)).collect()}
    again = extracted(frame(rows + [rows[0]] * 4 + [(90 + k, f"http://h.org/copy{k}", rows[1][2]) for k in range(6)])).collect()
    assert {r.page_id: r.text for r in again if r.page_id < 90} == once and {r.text for r in again if r.page_id >= 90} == {once[1]}
