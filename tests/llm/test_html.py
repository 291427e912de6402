"""HTML extraction: templates by counts, rules, broken pages, against a plain version."""

from __future__ import annotations

import re
import time
from collections import defaultdict
from html.parser import HTMLParser

from pyspark.sql import functions as F

from visbag.llm import html_extract as H

SF = "/root/testdata/sf0.01"


def text_of(page: str) -> str:
    return "\n\n".join(H.Page(page).blocks())


def plain(rows) -> dict:
    """page_id -> text, from counts over all pages in one place, exact sets of texts."""
    trees = {i: (H.Page(page or ""), H.host_of(url)) for i, url, page in rows}
    texts, hosts, keys = defaultdict(set), defaultdict(set), {}
    for i, (tree, host) in trees.items():
        text = "\n".join(tree.blocks())
        keys[i] = tree.hash(H._salt(host))
        hosts[host].add(text)
        for k in keys[i]:
            texts[k].add(text)  # keys of a host are its own
    return {i: "\n\n".join(tree.blocks(tree.recurring(lambda k: len(texts[k]), H.least(len(hosts[host]))))) for i, (tree, host) in trees.items()}


class Article(HTMLParser):
    """Blocks of the article elements, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks, self.part = 0, [], []

    def flush(self):
        text = " ".join("".join(self.part).split())
        self.part = []
        if text and self.depth:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in H.BLOCK:
            self.flush()
        self.depth += tag == "article"
        if tag == "br":
            self.part.append(" ")

    def handle_endtag(self, tag):
        if tag in H.BLOCK:
            self.flush()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.part.append(data)


def site(n: int, head: str = "http://a.example/", wrap: str = "{}") -> list[tuple]:
    """Pages without article or main: what recurs is told by counts alone."""
    menu = "<div class='x1'><span>Home</span> <span>News</span></div>"
    note = "<div>We value your privacy. <b>Accept</b></div>"
    return [(i, f"{head}{i}", "<html><body>" + menu + wrap.format(f"<div><h1>Title {i}</h1><p>Body of page {i} &amp; more.</p><p>Shared words.</p></div>") + note + "<p>Imprint and terms</p></body></html>") for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"text": F.lit("x"), "chunk": F.lit(1)})


def test_counts_remove_templates_without_article(spark):
    rows = site(12) + [(100 + i, f"http://b.example/{i}", "<body><div>Home</div><p>One</p></body>") for i in range(9)]  # copies of one page
    rows += [(200, "http://c.example/", "<body><div>Home News</div><p>Alone</p></body>")]
    got = {r.page_id: r for r in H.extracted(frame(spark, rows), chunk_bytes=700).collect()}
    want = plain(rows)
    assert {i: r.text for i, r in got.items()} == want
    # "Shared words." recurs too, but in the element that holds most of the page's words
    assert got[3].text == "Title 3\n\nBody of page 3 & more.\n\nShared words." and got[3].n_templates >= 3
    assert got[100].text == "Home\n\nOne" and got[200].text == "Home News\n\nAlone"


def test_counts_inside_articles(spark):
    rows = site(12, wrap="<article>{}<div>Share this page <a>now</a></div></article>")
    got = {r.page_id: r.text for r in H.extracted(frame(spark, rows), chunk_bytes=900).collect()}
    assert got == plain(rows) and got[5] == "Title 5\n\nBody of page 5 & more.\n\nShared words."


def test_counts_decide_on_the_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    got = H.extracted(pages).collect()
    assert sum(r.n_templates for r in got) > 50
    want = plain(rows)
    assert {r.page_id: r.text for r in got} == want
    for i, _, page in rows:
        parser = Article()
        parser.feed(page or "")
        assert "\n\n".join(parser.blocks) == want[i]


def stripped(page: str | None) -> str:
    """The page without what tells an article by name: its elements are divs, without class, id and role."""
    page = re.sub(r"<(/?)(?:article|main|nav|footer|header|aside)\b", r"<\1div", page or "")
    return re.sub(r"""(<div\b[^>]*?)\s(?:class|id|role)=(?:"[^"]*"|'[^']*'|[^\s>]+)""", r"\1", re.sub(r"""(<[a-z0-9]+\b[^>]*?)\s(?:class|id|role)=(?:"[^"]*"|'[^']*'|[^\s>]+)""", r"\1", page))


def test_counts_decide_without_names(spark):
    """No page of the given ones loses a block of its article when nothing but counts can tell it; without the counts
    menus and footers stay on all of them."""
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()]
    want = {i: "\n\n".join(H.Page(page or "").blocks()) for i, _, page in rows}
    bare = [(i, url, stripped(page)) for i, url, page in rows]
    got = {r.page_id: r.text for r in H.extracted(frame(spark, bare)).collect()}
    assert [i for i, text in want.items() if not set(text.split("\n\n")) - {""} <= set(got[i].split("\n\n"))] == []
    same = sum(got[i] == text for i, text in want.items())  # on the others, footers of hosts with few pages stay
    uncounted = sum("\n\n".join(H.Page(page).blocks()) == want[i] for i, _, page in bare)
    assert same > 0.25 * len(rows) and uncounted == 0, (same, uncounted)


def test_recurring_content_stays(spark):
    """Headings, steps, lists, tables and paragraphs that recur in the content of a host's pages are content; a slot whose
    texts change, a menu and a share box are not."""
    adverts = ["Buy our soap today", "Fly to the sea", "Cheap loans here"]
    body = "<h1>Dish {0}</h1><h2>Ingredients</h2><ul><li>salt</li><li>pepper</li></ul><h2 id=comments>Comments on method</h2><p>Preheat the oven.</p><div class=step><p>Wash the rice.</p></div><table><tr><td>Serves</td><td>four</td></tr></table><p>Dish number {0} is made of {0} things and takes {0} minutes.</p><div>Share this <a>now</a></div>"
    for wrap in ("<div class='content'>{}</div>", "<article>{}</article>"):
        rows = [(i, f"http://{'abc'[i % 3]}.example/{i}", f"<body><div><a>Home</a> <a>About</a></div><div>{adverts[i // 3 % 3]}</div>{wrap.format(body.format(i))}<div>All rights reserved</div></body>") for i in range(36)]
        got = {r.page_id: r.text for r in H.extracted(frame(spark, rows)).collect()}
        assert got == plain(rows)
        assert got[7].split("\n\n") == ["Dish 7", "Ingredients", "salt", "pepper", "Comments on method", "Preheat the oven.", "Wash the rice.", "Serves", "four", "Dish number 7 is made of 7 things and takes 7 minutes."]
    for gone in ("<ol class='commentlist'><li>c</ol>", "<div id=respond>r</div>", "<div class='cookiebar'>c</div>", "<div id='onetrust-consent-sdk'>c</div>", "<div class='cc-banner'>c</div>"):
        assert text_of(f"<body><div><p>Text.</p></div>{gone}</body>") == "Text.", gone
    for kept in ("<h2 id=search>k</h2>", "<h2 class='comments'>k</h2>", "<p class='notice'>k</p>", "<ul class='related'><li>k</ul>", "<p id=comment>k</p>"):
        assert text_of(f"<article><p>Text.</p>{kept}</article>") == "Text.\n\nk", kept


def test_rules():
    article = "<article><h1>T</h1><p>Text one.</p>{}</article>"
    clean = "T\n\nText one."
    for wrap in ("<div class='with-sidebar'>{}</div>", "<div class='site nav-open'>{}</div>", "<div class='sidebar'>{}</div>", "<form>{}</form>", "<div id=comments>{}</div>"):
        assert text_of(f"<body><nav>menu</nav>{wrap.format(article.format(''))}<footer>f</footer></body>") == clean
    assert text_of(article.format("<p class='search-term'>kept</p><section id='related-work'><p>also</p></section>")) == clean + "\n\nkept\n\nalso"
    for gone in ("<div class=comments>c</div>", "<section id='comment-list'>c</section>", "<aside>a</aside>", "<div class='ad-box-2'>a</div>", "<div hidden>h</div>", "<p style='display: none'>h</p>", "<div role=alert>r</div>", "<article class='comment'>c</article>", "<p class='ad'>x</p>", "<form><input>f</form>", "<noscript>n</noscript>", "<template>t</template>"):
        assert text_of("<body>" + article.format(gone)) == clean, gone
    assert text_of("<body><header>top</header><main><header><h1>T</h1></header><p>x</p></main></body>") == "T\n\nx"
    assert text_of("<body><div class='cookie-notice'>c</div><p>x</p><ul class='menu'><li>m</ul><p>y") == "x\n\ny"


def test_broken_pages():
    assert text_of("<article><p>a<svg/>b</p><p>c</p></article>") == "ab\n\nc"
    assert text_of("<article><p>a<svg><path d='x'/><text>no</text></svg>b</p></article>") == "ab"
    assert text_of("<article><p>a</p><iframe src=x><p>b</p></article>") == "a\n\nb"
    assert text_of("<article><p>a</p><script>no") == "a"
    assert text_of("<article><p>it</p><p class=it's>b</p><p>c'</p>") == "it\n\nb\n\nc'"
    assert text_of('<article><p title="x>a</p><p>b</p>') in ("a\n\nb", "b")
    assert text_of("<p>x<a href='") == "x<a href='" and text_of("1 < 2 <3 &lt; 4") == "1 < 2 <3 < 4"
    assert text_of("<p>a<!-- open <p>b</p>") == "a" and text_of("") == "" and text_of("<") == "<"
    assert text_of("<div>" * 50_000 + "deep" + "</div>" * 20_000) == "deep"
    for bad in ("<a ", '<a b=">" ', "<b>", "<li>", "<table><tr><td>", "<p></section>", "<!--", "<![CDATA[", "</div>", "<svg>", "<a b='\">"):
        times = []
        for n in (10_000, 40_000):
            began = time.process_time()
            H.Page(bad * n).blocks()
            times.append(time.process_time() - began)
        assert times[1] < 12 * times[0] + 0.5, bad


def test_edges(spark):
    rows = [(1, None, None), (2, "http://x/", ""), (None, "http://x/", "<p>n</p>"), (3, "http://x/", "<p>a&nbsp;&amp;\n b</p>"), (3, "http://x/", "<p>a&nbsp;&amp;\n b</p>"), (4, None, "<p>" + "w " * 200_000 + "</p>")]
    got = sorted((r.page_id or 0, r.text) for r in H.extracted(frame(spark, rows)).collect())
    assert got[0] == (0, "n") and got[1:5] == [(1, ""), (2, ""), (3, "a & b"), (3, "a & b")] and len(got[5][1]) == 399_999
    assert H.extracted(frame(spark, rows).limit(0)).count() == 0


def test_texts_are_counted():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (2, 3, 15, 400):
        texts = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
        keys, texts = H._smallest(np.full(3 * n, 7, np.uint64), np.tile(texts, 3))
        assert len(keys) == min(n, H.SKETCH) and (np.diff(texts.astype(object)) > 0).all()
    assert re.fullmatch(r"\d+", str(H.MANY))
