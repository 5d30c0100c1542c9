"""Wrappers and main texts: planted templates, odd pages, and the pages table beside plain cutting."""

import html
import random
import re

import pytest

from tidegauge.llm import html_wrappers as hw
from tidegauge.llm.queries import QUERIES


def site(rng, n, article=True):
    """Pages of one site and their texts: lists of any length, a motto on every page, varying adverts and menus."""
    pages = []
    for i in range(n):
        paragraphs = [" ".join(rng.choices(["alpha", "beta", "ga &amp; mma", "del\n ta", "<i>eps</i>"], k=rng.randint(3, 30))) + f" {i}" for _ in range(rng.randint(1, 9))]
        body = f"<h1>Title {i}</h1><div class=lead>Read all of our stories</div>" + "".join(f"<p>{p}" for p in paragraphs)
        boxes = "".join(f"<li><a href=/x>menu {rng.random()}</a>" for _ in range(rng.randint(2, 7)))
        pages.append((
            f"<!doctype html><head><title>t {i}</title></head><body class='has-sidebar'><div class=top>The site of sites</div><ul>{boxes}</ul>"
            f"<{'article' if article else 'div'}>{body}</{'article' if article else 'div'}><div id='ad-{i}'>Buy {rng.random()}</div><section>All rights kept</section></body>",
            "\n".join(" ".join(html.unescape(re.sub("<.*?>", "", x)).split()) for x in [f"Title {i}", *paragraphs])))
    return pages


@pytest.mark.parametrize("article", [True, False])
def test_constant_nodes_are_template(spark, monkeypatch, article):
    pages = site(random.Random(1), 12, article)
    rows = [(i, f"http://A.example/{i}", page, "x", 1) for i, (page, _) in enumerate(pages)]
    rows += rows[:3]
    rows += [(100 + i, f"http://one-{i}.example/", page, None, None) for i, (page, _) in enumerate(pages[:2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _host string, text int").repartition(3)
    plain = sorted(map(tuple, hw.extract(df).select("page_id", "text").collect()))
    alone = {i: t for i, t in plain if i >= 100}
    assert plain == sorted([(r[0], pages[r[0]][1]) for r in rows if r[0] < 100] + list(alone.items()))
    assert all("Read all of our stories" in t and ("All rights" in t) != article for t in alone.values())
    monkeypatch.setattr(hw, "_hot", lambda rows, host: ["a.example"])
    assert sorted(map(tuple, hw.extract(df).select("page_id", "text").collect())) == plain
    assert hw.extract(df).columns == ["page_id", "url", "html", "_host", "text"]


def test_copies_of_one_article_are_content(spark):
    page = "<nav>{}</nav><article><div class=a><p>One same text.</p></div></article><footer>{}</footer>"
    df = spark.createDataFrame([(i, "http://b.example/", page.format(i, i)) for i in range(20)], "page_id long, url string, html string")
    assert {r.text for r in hw.extract(df).collect()} == {"One same text."}


ODD = [
    (None, ""), ("", ""), ("   ", ""), ("plain text", "plain text"), ("a < b &lt; c &copy &notit; &#x41;&#0;", "a < b < c © ¬it; A�"),
    ("<p>one<p>two<b>three<br>four</p>five", "one\ntwothree four\nfive"), ("<!-- x > y --><p>a</p><!-- open", "a"),
    ("<script>if (a<b) '</p>'</script><style>p{}</style><p>b", "b"), ("<p title='a>b'>c</p><p title=\"open>d", "c\nd"),
    ("<div>" * 3000 + "deep" + "<p>er" + "</div>" * 3000 + "<p>after", "deep\ner\nafter"), ("</p></div></html>x</body>", "x"),
    ("<main><header><h1>T</h1></header><p>x</p><form>q</form><aside>s</aside></main><p>out", "T\nx"),
    ("<article><p>a</p><section class='comments'><p>c</p><article><p>d</p></article></section></article><article class=comment>e</article>", "a"),
    ("<header>h</header><div class='cookie-notice'>n</div><div class=menu>m</div><p>a \t b</p><div class=newsletterBox>s</div>", "a b"),
    ("<table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e</ul>", "a\nb\nc\nd\ne"), ("<form><p>all of the page</p></form>", "all of the page"),
    ("<ul><li><a href=x>one</a><li><a href=y>two</a></ul><p>text <a href=z>l</a>", "text l"), ("<article></article><p>x", "x"),
]


def test_odd_pages(spark):
    for page, text in ODD:
        assert hw.main_text(page) == text, page
    rows = [(i, None if i % 2 else "no host", page) for i, (page, _) in enumerate(ODD)]
    df = spark.createDataFrame(rows + rows[:5] + [(None, "http://x.example", "<p>y"), (900, "http://x.example", "<p>" + "é word " * 500_000)],
                               "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in hw.report(df).collect()}
    assert all(got[i] == (t, len(t)) for i, (_, t) in enumerate(ODD)) and got[None] == ("y", 1) and got[900][1] == 3_499_999
    assert hw.report(df).count() == len(ODD) + 7
    assert hw.report(df.limit(0)).count() == 0


def test_alignment_matches_most_nodes():
    """Beside a search of all order-keeping matches of small trees."""
    rng = random.Random(5)

    def tree(depth=0):
        return (rng.choice("ab"), [tree(depth + 1) for _ in range(rng.randint(0, 3) if depth < 3 else 0)])

    def flat(t, depth=0):
        return [(depth, t[0])] + [x for c in t[1] for x in flat(c, depth + 1)]

    def most(a, b):
        if a[0] != b[0]:
            return 0
        def best(x, y):
            if not x or not y:
                return 0
            return max(best(x[1:], y), best(x, y[1:]), most(x[0], y[0]) + best(x[1:], y[1:]))
        return 1 + best(a[1], b[1])

    for _ in range(150):
        a, b = ("r", [tree(1), tree(1)]), ("r", [tree(1), tree(1)])
        one, two = (hw.Slim([d for d, _ in flat(t)], [x for _, x in flat(t)], [k * 2 + m for k, _ in enumerate(flat(t))]) for m, t in enumerate((a, b)))
        pairs = hw.align(one, two)
        assert len(pairs) == most(a, b) == len(set(pairs.values())) and sorted(pairs.values()) == [pairs[k] for k in sorted(pairs)]
        assert all(one.labels[i] == two.labels[j] and one.depths[i] == two.depths[j] for i, j in pairs.items())


def test_pages_table(spark):
    def plain(page):
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = [html.unescape(re.sub("<[^>]*>", " ", x)) for x in re.split("</?(?:p|h1)>", article)]
        return "\n".join(" ".join(x.split()) for x in parts if x.split())

    for sf in ("sf0.001", "sf0.01"):
        pages = {r.page_id: r for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").collect()}
        got = QUERIES["op12_html_wrappers"](spark, f"/root/testdata/{sf}").collect()
        assert len(got) == len(pages) and all(r.text == plain(pages[r.page_id].html) and r.url == pages[r.page_id].url for r in got)
