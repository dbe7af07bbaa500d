"""Main text of web pages by site style trees.

1. Every page is parsed into its elements.  An element's style is the path of tags and class
   names from the root; the pages of a host are merged by style, which gives the host's style
   tree.
2. For each node of the tree: on how many pages it occurs, and the entropy of its contents
   over its occurrences, as a share of the highest that so many occurrences can have.  A
   branch that is on most pages of a host and says the same on them is of low importance.
   Pages of a host with the same texts count once, however many copies there are: they are
   grouped by (host, page) with partial aggregates, and their nodes counted as (host, style,
   content), so a host or a page with a third of all rows is combined in the tasks that read it.
3. Presentation decides as well: branches whose tag or class names say what they are (menus,
   footers, adverts, forms, scripts, reader comments ...) have no importance anywhere.  A class
   name or id says so if all its words do (``cookie-notice``, not ``has-sidebar``), and never for
   a branch that holds the main element, or an article on a page with no article elsewhere.
4. Low branches are removed from each page; the rest of its articles (else its main element,
   else its body) is the text.  The table of low branches is small, written, and joined by host.

Entropy alone never removes an article, a paragraph or a heading, and removes nothing on a host
with fewer than ``min_pages`` different pages.

Blocks: character references are decoded, white space becomes one space, empty blocks vanish;
blocks are joined by two line feeds.  A null or empty page gives an empty text, a null url is a
host of its own.  Repeated rows stay repeated; an empty table gives no rows; other columns are
ignored.  Depth and length of pages are not limited; styles are 64-bit hashes, so deep nesting
costs no more than wide.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.llm.common import tune, written


@dataclass(frozen=True)
class StyleParams:
    min_pages: int = 10        # different pages of a host from which its tree counts
    min_share: float = 0.6     # of a host's different pages that have the node
    importance: float = 0.25   # relative content entropy below which a branch goes


# Elements and class names by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
DROP = RAW | frozenset("head nav footer aside form button select option datalist dialog menu svg math canvas audio "
                       "video object template label fieldset input".split())
BLOCK = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody "
                  "tfoot tr td th blockquote pre figure figcaption address header footer nav aside form fieldset hr "
                  "details summary center dialog menu legend option".split())
CLOSES_P = BLOCK - frozenset("html body td th tr thead tbody tfoot caption option legend".split())
KEEP = frozenset("html body article main p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd tr td th".split())
CUES = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
                 "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup nav "
                 "navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer masthead comment "
                 "comments disqus reply replies respond related recommended share sharing social widget widgets pager "
                 "pagination toolbar login search form skip".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar "
                  "toolbar".split())
# an element of the first kind ends an open one of the second, if no one of the third is between
ENDS = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}),
        "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}),
        "tbody": ("tr td th thead tbody", {"table"}), "option": ("option", {"select"})}
ENDS = {k: (frozenset(a.split()), b) for k, (a, b) in ENDS.items()}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<[!?][^>]*>|[^<]+|<""", re.S)
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAMES = re.compile(r"[a-z]+")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>|\Z", re.I) for t in RAW}


class Element:
    """``own``: 2 if its tag, role or style says that it is no content, 1 if its names do."""

    __slots__ = ("tag", "style", "parent", "own", "header", "low", "level", "begin", "end", "block")

    def __init__(self, tag, style, parent, own, header, begin):
        self.tag, self.style, self.parent, self.own, self.header = tag, style, parent, own, header
        self.begin, self.end = begin, begin
        self.place()

    def place(self) -> None:
        """Whether it lies in a low branch, and the level: 2 in an article, 1 in the main element."""
        low, level = (self.parent.low, self.parent.level) if self.parent else (False, 0)
        self.low = low or self.own > 0 or (self.header and not level)
        self.level = 0 if self.low else 2 if self.tag == "article" else max(level, self.tag == "main")


def looks(tag: str, attrs: str) -> tuple[str, int, bool]:
    """(class names as a style, whether the element's own look says it is not content: 2 by tag,
    role or style, 1 by names; whether it is a header, which is content in articles only)."""
    words: list[str] = []
    tokens: list[list[str]] = []
    low, seen = tag in DROP, set()
    for key, value in ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in seen:  # the first one counts
            continue
        seen.add(key)
        if key in ("class", "id"):
            tokens += [NAMES.findall(x) for x in value.split()]
            words += NAMES.findall(value)
        elif key == "role":
            low |= value.strip() in ROLES
        elif key == "hidden":
            low = True
        elif key == "style":
            low |= "display:none" in "".join(value.split())
    cues, header = False, tag == "header"
    if tag not in ("html", "body", "article", "main"):
        cues = any(t and CUES.issuperset(t) for t in tokens)
        header |= ["header"] in tokens
    elif tag == "article":
        cues = any(t and {"comment", "comments", "reply", "replies", "related"}.issuperset(t) for t in tokens)
    return ".".join(sorted(set(words))), 2 if low else int(cues), header


def free_main(elements: list[Element]) -> None:
    """Names never remove a branch with the main element, nor one with an article if no article
    lies elsewhere."""
    held = [e for e in elements if e.own == 0 and e.low and e.tag in ("article", "main")]
    article = any(e.tag == "article" and not e.low for e in elements)
    freed = False
    for e in held:
        if e.tag == "article" and article:
            continue
        above, x = [], e.parent
        while x is not None:
            above.append(x)
            x = x.parent
        if all(x.own < 2 and not (x.own == 1 and x.tag == "article") for x in above):
            freed = True
            for x in above:
                x.own, x.header = 0, False
    if freed:
        for e in elements:
            e.place()


def parse(html: str, low_styles: frozenset[int] = frozenset()) -> tuple[list[Element], list[tuple[str, Element, int]]]:
    """(elements, texts): each text with its element and its block's number."""
    root = Element("", 0, None, 0, False, 0)
    elements, texts, stack, opened = [], [], [root], Counter()
    block, at, size = 0, 0, len(html)

    def close(n: int) -> None:
        nonlocal block
        while len(stack) > n:
            e = stack.pop()
            e.end = len(texts)
            opened[e.tag] -= 1
            if e.tag in BLOCK:
                block += 1

    def nearest(tags, stops) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in stops:
                break
        return 0

    while at < size:
        m = TOKEN.match(html, at)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            text = m.group()
            if text[0] != "<" or text == "<":
                texts.append((text, stack[-1], block))
            continue
        tag = tag.lower()
        if m.group(1):
            if opened[tag]:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                # an inline element's end does not end the blocks inside it
                if tag in BLOCK or not any(e.tag in BLOCK for e in stack[i + 1:]):
                    close(i)
            continue
        if tag == "br":
            texts.append((" ", stack[-1], block))
            continue
        if tag in CLOSES_P and opened["p"] and (i := nearest({"p"}, {"table", "td", "th", "button"})):
            close(i)
        if tag in ENDS and (i := nearest(*ENDS[tag])):
            # rows and cells may be nested in the one that ends
            while (j := nearest(*ENDS[tag])) and j < i:
                i = j
            close(i)
        parent = stack[-1]
        names, own, header = looks(tag, m.group(3))
        style = xxhash.xxh3_64_intdigest(f"{parent.style}>{tag}.{names}")
        if tag not in KEEP and style in low_styles:
            own = 2
        e = Element(tag, style, parent, own, header, len(texts))
        if tag in BLOCK:
            block += 1
        if tag in VOID or (m.group(3).endswith("/") and tag not in BLOCK):
            continue
        elements.append(e)
        if tag in RAW:
            at = RAW_END[tag].search(html, at).end()
            continue
        stack.append(e)
        opened[tag] += 1
    close(1)
    free_main(elements)
    return elements, texts


def main_text(html: str | None, low_styles: frozenset[int] = frozenset()) -> str:
    """The page's text without its low branches."""
    if not html:
        return ""
    _, texts = parse(html, low_styles)
    for level in (2, 1, 0):
        blocks: dict[int, list[str]] = {}
        for text, e, block in texts:
            if not e.low and e.level >= level:
                blocks.setdefault(block, []).append(text)
        out = [x for parts in blocks.values() if (x := " ".join(unescape("".join(parts)).split()))]
        if out:
            return "\n\n".join(out)
    return ""


PRIME = (1 << 61) - 1
BASE = 0x1F3D5B79A3C1E7


def style_contents(html: str | None) -> set[tuple[int, int]]:
    """(style, hash of the content) of every element that entropy may judge, and of the page."""
    elements, texts = parse(html or "")
    sums, words = [0], [0]
    for text, _, _ in texts:
        word = text.strip()
        sums.append((sums[-1] * BASE + xxhash.xxh3_64_intdigest(word)) % PRIME if word else sums[-1])
        words.append(words[-1] + bool(word))
    found = {(0, sums[-1])}
    for e in elements:
        if not e.low and e.tag not in KEEP:
            # the texts of the element, cut out of the running hash
            n = words[e.end] - words[e.begin]
            found.add((e.style - (1 << 63), (sums[e.end] - sums[e.begin] * pow(BASE, n, PRIME)) % PRIME))
    return found


def host_of(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1))


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, style, n_pages, entropy): the nodes of the hosts' style trees over their different
    pages.  Style 0 is the page."""
    tune(pages.sparkSession)

    def run(batches):
        for batch in batches:
            rows = {}
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                nodes = sorted(style_contents(html))
                page = next(c for style, c in nodes if style == 0)
                flat = [x for node in nodes for x in node]
                key = (host, page)
                if key not in rows or flat < rows[key]:
                    rows[key] = flat
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.int64()),
                 pa.array(list(rows.values()), pa.list_(pa.int64()))], names=["host", "page", "nodes"])

    rows = pages.select(host_of(url_col).alias("host"), F.col(f"`{html_col}`").alias("html")).mapInArrow(
        run, "host string, page bigint, nodes array<bigint>")
    # pages with the same texts but other elements: the smallest nodes, the same whatever the order
    distinct = rows.groupBy("host", "page").agg(F.min("nodes").alias("nodes"))
    at = F.sequence(F.lit(0), F.size("nodes") - 1, F.lit(2))
    node = F.transform(at, lambda i: F.struct(F.get("nodes", i).alias("style"), F.get("nodes", i + 1).alias("content")))
    counted = distinct.select("host", F.explode(node).alias("x")).groupBy("host", "x.style", "x.content").agg(
        F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("double")
    return (counted.groupBy("host", "style")
            .agg(F.sum("n").alias("n_pages"),
                 F.when(F.sum(n) > 1, (F.log(F.sum(n)) - F.sum(n * F.log(n)) / F.sum(n)) / F.log(F.sum(n)))
                 .otherwise(1.0).alias("entropy")))


def low_branches(tree: DataFrame, p: StyleParams = StyleParams()) -> DataFrame:
    """(host, styles): the branches of low importance of each host that has any."""
    page = tree.filter("style = 0").select("host", F.col("n_pages").alias("pages"))
    node = tree.filter("style <> 0").join(page.filter(F.col("pages") >= p.min_pages), "host")
    low = node.filter((F.col("n_pages") >= p.min_share * F.col("pages")) & (F.col("entropy") < p.importance))
    return low.groupBy("host").agg(F.collect_set("style").alias("styles"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            p: StyleParams = StyleParams()) -> DataFrame:
    """(page_id, url, host, text) of every page."""
    low = written(low_branches(written(style_tree(pages, url_col, html_col), "style-tree"), p), "low-branches")
    joined = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                          host_of(url_col).alias("host"), F.col(f"`{html_col}`").alias("html")).join(low, "host", "left")
    schema = joined.select("page_id", "url", "host").schema.add("text", "string")

    def run(batches):
        for batch in batches:
            texts = [main_text(html, frozenset(s + (1 << 63) for s in styles or ()))
                     for html, styles in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string())], names=schema.names)

    return joined.select("page_id", "url", "host", "html", "styles").mapInArrow(run, schema)
