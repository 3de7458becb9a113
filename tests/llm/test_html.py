import re
from collections import Counter, defaultdict
from html import unescape

import pytest
from pyspark.sql import functions as F

from tillage.llm import common, html as H

D = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string"


def text(page):
    return H.main_text(H.parse(page))


def test_furniture_and_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a>x</a></nav>
    <div class="cookie-notice">We use</div><article><header><h1>Head &amp; line</h1></header><p>One<br>two <b>bo</b>ld&nbsp;&#233;<script>var t="</p>";</script><p>Three
    <ul><li>a<li>b</ul><div id="adBox">buy</div><form>f</form><aside>side</aside><section class="comments"><p>nice</p></section></article><footer>&copy; f</footer></body>"""
    assert text(page) == "Head & line One two bold é Three a b"
    assert text("") == text("<") .replace("<", "") == ""
    assert text("plain &lt;b&gt;") == "plain <b>" and text("<div>a<div>b</div>c</div>") == "a b c"
    assert text("<p>" * 3000 + "deep") == "deep" and text("<div>" * 3000 + "deep") == "deep"
    assert text("<article><p>x</article><article>y</article>") == "x y" and text("a <!-- c > --> b<!-- open") == "a b"
    assert text('<div class="shadow header-less">t</div>') == "t" and text('<p class="lead">t</p>') == "t"
    assert len(text("<div>" + "word <b>x</b> " * 200_000 + "</div>")) > 1_000_000


@pytest.mark.parametrize(
    "page, want",
    [
        ('<article><section id="related-work">Earlier</section><h2 id="notice-periods">Periods</h2><span class="search-term">term</span></article>', "Earlier Periods term"),
        ('<div class="legal-history"><p>Once</p></div>', "Once"),
        ('<p class=x">hello</p><p>two</p>', "hello two"),
        ("<p data-x=it's>one</p><p title='a>b'>two</p>", "one two"),
        ('<p class="x>open</p><p>two</p>', "open two"),
        ("<main><p>intro</p><article>story</article></main>", "intro story"),
        ('<article class="card">teaser</article><div>the long story beside it</div>', "teaser the long story beside it"),
        ("<div>tag line</div><article>the story that is longer</article>", "the story that is longer"),
        ("<a href=/a?b=\"c>x</a> y", "x y"),
    ],
)
def test_nothing_of_the_story_is_lost(page, want):
    assert text(page) == want


def test_pages_against_the_articles(spark):
    """In the given pages the article element is the truth; menus, adverts and footers recur on hosts."""
    pages = spark.read.parquet(f"{D}/pages.parquet")
    got = {r.page_id: r for r in H.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        assert got[r.page_id].text == " ".join(unescape(re.sub(r"<[^<>]*>", " ", inner)).split())
    assert any(r.n_removed for r in got.values())


def brute(rows):
    """Whole subtrees as strings, counted by the lists of long texts beside them."""
    spelled = {}

    def spell(node):
        if id(node) not in spelled:
            spelled[id(node)] = (node, f"<{node.name}|" + "|".join(spell(c) if isinstance(c, H.Node) else " ".join(c.split()) for c in node.children) + ">")
        return spelled[id(node)][1]

    def texts(node, linked=False):
        """(text, length outside links) in page order, without what is dropped by name."""
        out = []
        for c in [] if node.drop else node.children:
            if isinstance(c, H.Node):
                out += texts(c, linked or node.name == "a")
            elif c.strip():
                out.append((" ".join(c.split()), 0 if linked or node.name == "a" else len(" ".join(c.split()))))
        return out

    pages, contents, beside = {}, defaultdict(set), defaultdict(set)
    for _, url, page in rows:
        where = (re.match(r"\w+://([^/]*)", url or "") or [None, ""])[1]
        root = H.parse(page or "")
        found = H.candidates(root)
        pages[where, page or ""] = root, found
        every = texts(root)
        total = sum(n for _, n in every)
        sizes = sorted((n for _, n in every), reverse=True)
        least = next((n for k, n in enumerate(sizes) if sum(sizes[: k + 1]) >= 0.9 * total), 0) if total else 0
        bulk = lambda pieces, least=least: Counter(t for t, n in pieces if n >= least)
        contents[where].add(tuple(sorted(bulk(every).items())))
        for x in found:
            own = texts(x, any(x is y for z in H.subtrees(root) if z.name == "a" for y in H.subtrees(z) if y is not z))
            if 2 * sum(n for _, n in own) <= total:
                beside[where, H.kind(x), spell(x)].add(tuple(sorted((bulk(every) - bulk(own)).items())))
    def recurs(w, k, s):
        n, total = len(beside[w, k, s]), len(contents[w])
        return n >= 2 and n >= (H.RECURS[k][0] if k == H.INSIDE else min(H.RECURS[k][0], total)) and n >= total * H.RECURS[k][1]

    out = {}
    for (where, page), (root, found) in pages.items():
        gone = [x for x in found if recurs(where, H.kind(x), spell(x))]
        inner = {id(y) for x in gone for y in H.subtrees(x) if y is not x}
        top = [x for x in gone if id(x) not in inner]
        for x in top:
            x.drop = True
        out[where, page] = H.main_text(root), len(top)
    return {i: out[(re.match(r"\w+://([^/]*)", url or "") or [None, ""])[1], page or ""] for i, url, page in rows}


STORY = "The mayor opened the new bridge on Monday, and the town came to see it."


@pytest.mark.parametrize("urls", [3, 24, 300])
@pytest.mark.parametrize("form", ["<div>{s}</div>", "<div><h1>Bridge</h1><p>{s}</p><p>It took four years and cost more than was planned at first.</p></div>", "<article><h1>Bridge</h1><p>{s}</p></article>", "<p>{s}</p>"])
def test_a_story_under_many_urls_stays(spark, urls, form):
    """Its pages differ in a changing line; the site's menu goes all the same, and so does its footer."""
    menu, foot = "<div><ul><li><a>Home</a><li><a>News</a></ul></div>", "<div>All rights reserved by us</div>"
    rows = [(i, f"http://a.org/{i}", f"<body>{menu}{form.format(s=STORY)}<div>View {i}</div>{foot}</body>") for i in range(urls)]
    rows += [(1000 + i, f"http://a.org/x{i}", f"<body>{menu}<div><p>Another report, number {i}, of what was seen and said in ward {i * 7}.</p></div>{foot}</body>") for i in range(30)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: t for i, (t, _) in brute(rows).items()}
    assert all(STORY in got[i] for i in range(urls))
    assert not any("Home" in t or "rights" in t for t in got.values())
    assert all(got[1000 + i] == f"Another report, number {i}, of what was seen and said in ward {i * 7}." for i in range(30))


def test_small_hosts_and_half_of_a_host(spark):
    menu = "<div><a>Home</a> <a>News</a></div>"
    rows = [(i, f"http://two.org/{i}", f"{menu}<div><p>Story {i} is told here.</p></div>") for i in range(2)]
    rows += [(10 + i, f"http://six.org/{i}", f"{menu}<p>{STORY if i < 3 else f'Other {i} text of the day'}</p><div>View {i}</div>") for i in range(6)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: t for i, (t, _) in brute(rows).items()}
    assert [got[0], got[1]] == ["Story 0 is told here.", "Story 1 is told here."]
    assert all(got[10 + i].startswith(STORY) for i in range(3))


def test_readers_beside_a_short_article_go():
    talk = "<div class='discussion-thread'>" + "".join(f"<p>I think so too, said reader {i}, at length.</p>" for i in range(30)) + "</div>"
    assert text(f"<article><h1>Head</h1><p>Short.</p></article>{talk}") == "Head Short."
    assert text(f"<main><p>Short.</p></main>{talk}") == "Short."


def test_recurring_subtrees_go(spark):
    menu = "<div class='x1'><ul><li>Home<li>News</ul></div>"
    rows = [(i, f"http://a.org/{i}", f"<body>{menu}<div><p>Story number {i}</p><p>shared line</p></div><div>Terms apply</div></body>") for i in range(12)]
    rows += [(100 + i, "http://b.org/1", f"<div>copy of one page</div>{menu}") for i in range(12)]
    rows += [(200, None, None), (201, "x", ""), (202, None, "<p>z")]
    rows += [(300 + i, f"http://short.org/{i}", f"<div><a>Home</a> <a>News</a></div><div><p>Story {i}</p></div>") for i in range(7)]
    # a hot host: blocks without class that rotate, each on 2 % of the pages, and a passage that 5 % of the stories quote
    rows += [(1000 + i, f"http://hot.org/{i}", f"<div><span>Buy thing {i % 50}</span> now</div><div><h1>Number {i}</h1><p>{'quoted' if i % 20 == 0 else f'own {i}'}</p></div>") for i in range(300)]
    rows += [(2000 + i, f"http://marked.org/{i}", f"<div>Rotating {i % 9}</div><article><h1>T {i}</h1><p>Join our list</p><p>{'quoted' if i % 3 else f'own {i}'}</p></article>") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("text", F.lit(1)).withColumn("row", F.lit("clash")).withColumn("host", F.lit(2)).withColumn("key", F.lit(2))
    found = H.extract(df.union(df.where("page_id = 5"))).collect()
    got = {r.page_id: (r.text, r.n_removed) for r in found}
    assert got == brute(rows) and len(found) == len(rows) + 1
    assert all(got[i] == (f"Story number {i}", 3) for i in range(12))
    assert got[100] == ("copy of one page Home News", 0) and (got[200], got[201], got[202]) == (("", 0), ("", 0), ("z", 0))
    assert all(got[300 + i][0] == f"Story {i}" for i in range(7))
    assert all(got[1000 + i][0] == f"Number {i} " + ("quoted" if i % 20 == 0 else f"own {i}") for i in range(300))
    assert all(got[2000 + i][0] == f"T {i} " + ("quoted" if i % 3 else f"own {i}") for i in range(60) if i % 3 == 0)
    assert H.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_keys_take_the_same_way_out(spark, monkeypatch):
    """With a low bound the hot subtrees and hosts are looked up by broadcast, the others by the join."""
    rows = [(i, f"http://h{i % 3}.org/{i}", f"<div>Menu {i % 3}</div><div>Block {i % 7}</div><p>Story {i}</p>") for i in range(90)]
    want = brute(rows)
    for hot in (1, 8, 1 << 20):
        monkeypatch.setattr(common, "HOT", hot)
        assert {r.page_id: (r.text, r.n_removed) for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()} == want
    assert defaultdict(int, Counter(t.split()[0] for t, _ in want.values())) == {"Story": 90}
