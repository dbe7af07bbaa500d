"""Main text: cases by hand, the small table by an independent cut, style trees on made sites."""

import html as H
import re

from corpusgauge.llm.html_main import StyleParams, extract, low_branches, main_text, style_tree

CASES = [
    ("<p>a &amp; b<p>c", "a & b\n\nc"),
    ("<html><head><title>t</title><style>x{}</style></head><body><nav>m</nav><article><h1>T</h1><p>one<br>two</p></article>"
     "<footer>f</footer>", "T\n\none two"),
    ("<article><p><b>bold <p>next</b> x</p>tail</article>after", "bold\n\nnext x\n\ntail"),
    ("<script>var a='<p>no</p>'</script><div>yes&nbsp;&#233;&lt;p&gt;</div><!-- <p>no</p> -->", "yes é<p>"),
    ("<body><header>site</header><div class='cookie-notice'>accept</div><main><p>text</p><aside>side</aside></main>"
     "<form><p>mail</p></form><section id=comments><p>great!</p></section>", "text"),
    ("<article><header><h1>Head</h1></header><p>x</p></article><article class=comment><p>no</p></article>", "Head\n\nx"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\n\nb\n\nc\n\nd"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
    ("1 < 2 <b>x</b> a<b", "1 < 2 x a<b"), ("<p>  \n </p>", ""), ("", ""), (None, ""),
    ("<div hidden>no</div><div style='display: none'>no</div><div role=navigation>no</div><p>yes", "yes"),
    ("<div>" * 3000 + "deep", "deep"), ("<p>" + "long " * 50_000, ("long " * 50_000).strip()),
]


def test_cases():
    for page, want in CASES:
        assert main_text(page) == want, page and page[:80]


KEPT = [
    '<div><a href="/hidden-lake" title="The hidden cost">a</a></div><p aria-hidden="false">b</p>',
    '<div data-id="related">a</div><p><a href="/s?id=comments">b</a></p>',
    '<div class="layout has-sidebar"><article><p>a<p>b</article></div>',
    '<body id="search-page"><div id="search-page"><p>a<p>b</div></body>',
    '<div class="sidebar"><nav>menu</nav><main><p>a<p>b</main></div>',
    '<div class="widget"><div><article><p>a<p>b</article></div></div>',
    '<article><p>a<p>b</article><div class="related"><article><p>teaser</article></div>',
    '<div style="color: red" data-style="display:none">a</div><p>b</p><div style="DISPLAY : none">no</div><div hidden="">no</div>',
]


def test_only_whole_names_drop_content():
    for page in KEPT:
        assert main_text(page) == "a\n\nb", page


def plain(page):
    """An independent reading of the pages of the test table."""
    body = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
    if not body:
        return ""
    blocks = re.split(r"</?(?:p|h1|article)>", body[1].replace("<br>", " "))
    return "\n\n".join(x for b in blocks if (x := " ".join(H.unescape(re.sub(r"</?b>", "", b)).split())))


def test_query_on_the_small_table(spark):
    from corpusgauge.llm.queries import llm_queries

    sf = "/root/testdata/sf0.01"
    want = {r.page_id: (r.url, plain(r.html)) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = llm_queries()["op8_html_main_text"].build(spark, sf).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got) and all(r.text for r in got)


def site(n, host="a.example"):
    return [(i, f"https://{host}/p{i}", f"<body><div class=top>Site name and motto</div><div class=story><p>Story {i} says {i * 7}."
             f"<div class=box>Our offices are open</div></div><div class=side>{'Read more' if i % 5 else 'Read less'}</div></body>")
            for i in range(n)]


def test_low_branches_by_entropy(spark):
    rows = site(30) + [(100 + i, u, h) for i, u, h in site(4, "small.example")]
    rows += [(200 + i, "http://same.example/x", "<div class=only>always this</div>") for i in range(30)]
    rows += [(300, None, "<div class=top>Site name and motto</div>"), (301, "http://n.example", None), (0, *rows[0][1:])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id int, url string, html string, host string").repartition(4)
    text = sorted((r.page_id, r.text) for r in extract(df).collect())
    want = []
    for i, u, h in rows:
        if i < 100:
            want.append((i, f"Story {i} says {i * 7}."))
        elif i < 200:
            want.append((i, f"Site name and motto\n\nStory {i - 100} says {(i - 100) * 7}.\n\nOur offices are open\n\nRead "
                         + ("more" if (i - 100) % 5 else "less")))
        else:
            want.append((i, {300: "Site name and motto", 301: ""}.get(i, "always this")))
    assert text == sorted(want)
    low = {r.host: len(r.styles) for r in low_branches(style_tree(df, "url", "html"), StyleParams()).collect()}
    assert low == {"a.example": 3}
    assert extract(df.limit(0)).count() == 0


def test_copies_of_a_page_do_not_switch_the_tree_off(spark):
    """On a host where 60 of 90 pages are copies of one, the others lose what they lose without the copies."""
    rows = site(30)
    copies = [(1000 + i, f"https://a.example/c{i}", rows[0][2]) for i in range(60)]
    frame = lambda x: spark.createDataFrame(x, "page_id int, url string, html string").repartition(4)
    alone = {r.page_id: r.text for r in extract(frame(rows)).collect()}
    got = {r.page_id: r.text for r in extract(frame(rows + copies)).collect()}
    assert alone == {i: f"Story {i} says {i * 7}." for i in range(30)}
    assert got == alone | {1000 + i: alone[0] for i in range(60)}
