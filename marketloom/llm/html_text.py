"""Main text of web pages, with subtrees deleted that a site repeats on many of its pages.

Every block element's markup is hashed, menus and adverts included; Spark counts, for each host, with how many
different articles it occurs; the elements that recur are deleted first. What doesn't recur but whose tag, role or
class says menu, notice, advert and the like goes after them: on small hosts, or where each page has its own. What holds the article is never deleted. Paragraphs and other text blocks
inside an article are never deleted for recurring: passages that articles share are text, not template.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small_side, stash
from .url_filter import url_host

#: A quotation mark quotes only behind an equals sign.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Element names by their part in HTML.
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp template".split())
DROPPED = RAW | frozenset("nav footer aside form dialog menu button select svg canvas object embed audio video head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr tbody table ul ol dl figcaption figure".split())
#: A start tag of the key closes an open element of the value.
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = frozenset("ul ol dl table body html article section div td th".split())
#: What a class or id names a part of the page by: alone, or as the last word of a compound (site-footer).
PARTS = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promos banner sidebar comments comment respond disqus cookies cookie consent gdpr notice notices alert newsletter subscribe signup share sharing social related recommended recommendations breadcrumb breadcrumbs menu nav navbar navigation footer header masthead topbar popup modal overlay paywall toolbar widget widgets pagination pager".split()
)
#: Those that name it also as the first word (ad-slot, comment-list), and whole compounds.
FIRST = frozenset("ad ads advert sponsored comment comments cookie cookies nav navbar menu sidebar footer breadcrumb breadcrumbs newsletter disqus gdpr popup modal".split())
WHOLE = frozenset("side-bar related-posts related-articles share-buttons sharing-buttons social-links".split())
#: Inside an article only these, alone or as the first word, or a notice's name behind a word of NOTICES, and on no text block but a list.
INSIDE = frozenset("ad ads advert adverts advertisement adsense adsbygoogle sponsored promo comments comment respond disqus newsletter subscribe signup popup modal overlay paywall sidebar pagination pager breadcrumb breadcrumbs menu nav navbar navigation cookie cookies consent gdpr share sharing toolbar".split())
INSIDE_ALONE = frozenset("notice notices alert alerts banner social related recommended recommendations widget".split())
NOTICES = frozenset("site page cookie consent gdpr privacy promo ad top legal service maintenance".split())
INSIDE_WHOLE = WHOLE | frozenset("related-links related-stories related-content social-share social-media social-buttons recommended-posts recommended-articles".split())
#: Names, alone, by which a paragraph or list item of an article isn't its text.
INSIDE_PARAGRAPH = frozenset("ad ads advert adverts advertisement sponsored promo notice notices alert".split())
#: A first word that makes a class a trait of the page's layout (no-sidebar, with-sidebar).
LAYOUT = frozenset("no with has without is hide show".split())
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPLIT = re.compile(r"[-_]+")
ROLES = frozenset("navigation banner contentinfo complementary dialog alertdialog alert search menu menubar toolbar".split())
#: Subtrees with at least so many different articles of a host around them are its template, however many pages it has.
TEMPLATE_PAGES = 5


@dataclass(slots=True)
class Element:
    tag: str
    attributes: str
    start: int
    parent: int
    in_article: bool
    end: int = -1
    parts: list = field(default_factory=list)  # texts and indexes of children
    holds: bool = False  # the article, or where there is none most of the page's text

    def dropped(self) -> bool:
        """Whether tag, role or class names a part of the page that isn't its main text; never of what holds the article."""
        if self.holds:
            return False
        if self.tag in DROPPED or self.tag == "header" and not self.in_article:
            return True
        if not self.attributes or self.tag in ("html", "body", "main"):
            return False
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(self.attributes)}
        if found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or HIDING.search(found.get("style", "")):
            return True
        names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
        if self.tag == "article":
            return any(SPLIT.split(n)[0] in ("comment", "comments") for n in names)
        return any(map(self._named, names))

    def _named(self, name: str) -> bool:
        words = [w for w in SPLIT.split(name) if w]
        if not words or len(words) > 1 and words[0] in LAYOUT:
            return False
        if self.in_article:
            if self.tag in ("p", "li") and name in INSIDE_PARAGRAPH:
                return True
            named = words[0] in INSIDE or name in INSIDE_ALONE or name in INSIDE_WHOLE or words[0] in NOTICES and words[-1] in INSIDE_ALONE
            return self.tag not in TEXT_BLOCKS - {"ul", "ol", "table", "figure"} and self.tag != "header" and named
        return words[-1] in PARTS or words[0] in FIRST or name in WHOLE


def parse(page: str) -> list[Element]:
    """The block elements of a page in document order; element 0 stands for the page. Inline markup is dropped, br is white space."""
    nodes, at, pos, n = [Element("", "", 0, -1, False)], 0, 0, len(page)
    while pos < n:
        m = TOKEN.search(page, pos)
        if m is None:
            nodes[at].parts.append(page[pos:])
            break
        if m.start() > pos:
            nodes[at].parts.append(page[pos : m.start()])
        pos = m.end()
        if m[2]:
            tag = m[2].lower()
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, pos)
                pos = close.end() if close else n
            elif tag == "br" or tag == "hr":
                nodes[at].parts.append(" ")
            elif tag in BLOCKS or tag in DROPPED and tag not in VOID:
                if tag in BLOCKS:
                    at = _close_implied(nodes, at, tag, m.start())
                nodes.append(Element(tag, m[3].strip(), m.start(), at, nodes[at].in_article or nodes[at].tag in ("article", "main")))
                nodes[at].parts.append(len(nodes) - 1)
                if m[3].rstrip().endswith("/") and tag not in BLOCKS:
                    nodes[-1].end = pos
                else:
                    at = len(nodes) - 1
        elif m[1]:
            tag, k = m[1].lower(), at
            if tag in BLOCKS or tag in DROPPED:
                while k and nodes[k].tag != tag and not (tag in ("p", "li", "dd", "dt") and nodes[k].tag in SCOPES):
                    k = nodes[k].parent
                if k and nodes[k].tag == tag:
                    while at != k:
                        nodes[at].end, at = m.start(), nodes[at].parent
                    nodes[k].end, at = pos, nodes[k].parent
    while at:
        nodes[at].end, at = n, nodes[at].parent
    nodes[0].end = n
    _mark_holders(nodes)
    return nodes


def _mark_holders(nodes: list[Element]) -> None:
    """Set holds above every article and main element that isn't a comment; without any, above what holds most of the text outside of dropped tags."""
    found = [i for i, e in enumerate(nodes) if e.tag in ("article", "main") and not e.dropped()]
    if found:
        for i in found:
            k = nodes[i].parent
            while k > 0 and not nodes[k].holds and nodes[k].tag not in DROPPED:
                nodes[k].holds = True
                k = nodes[k].parent
        return
    size = [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):  # children come after their parents
        e = nodes[i]
        if e.tag not in DROPPED and e.tag != "header":
            size[i] += sum(len(p.strip()) for p in e.parts if isinstance(p, str))
            if i:
                size[e.parent] += size[i]
    for i, e in enumerate(nodes):
        e.holds = e.tag not in DROPPED and e.tag != "header" and 2 * size[i] > size[0] > 0


def _close_implied(nodes: list[Element], at: int, tag: str, pos: int) -> int:
    closing, k = CLOSES.get(tag, set()), at
    if nodes[at].tag == "p" or closing:
        while k and nodes[k].tag not in SCOPES - closing:
            if nodes[k].tag == "p" or nodes[k].tag in closing:
                while at != k:
                    nodes[at].end, at = pos, nodes[at].parent
                nodes[k].end, at = pos, nodes[k].parent
                k = at
            else:
                k = nodes[k].parent
    return at


def subtree_hashes(page: str, nodes: list[Element]) -> dict[int, int]:
    """The hash of the markup of every element that may be template, by the element's index: all but what holds the article and the text blocks of it."""
    keeps = set()
    for i, e in enumerate(nodes):
        if e.tag in ("article", "main", "body", "html", "") and not (i and e.dropped()):
            k = i
            while k >= 0 and k not in keeps:
                keeps.add(k)
                k = nodes[k].parent
    return {i: xxhash.xxh3_64_intdigest(page[e.start : e.end].encode()) - 2**63 for i, e in enumerate(nodes) if i not in keeps and not (e.in_article and e.tag in TEXT_BLOCKS)}


def main_text(page: str | None, templates: frozenset[int] | set[int] = frozenset(), nodes: list[Element] | None = None, lists: bool = True) -> str:
    """The article's blocks, each with single spaces, joined by two line feeds; the body's where there is no article or main element.

    First what is in templates goes, then what tags and classes name, but with lists=False no more than raw elements (scripts, styles).
    """
    page = page or ""
    nodes = parse(page) if nodes is None else nodes
    hashes = subtree_hashes(page, nodes) if templates else {}

    def gone(i: int) -> bool:
        return hashes.get(i) in templates or (nodes[i].dropped() if lists else nodes[i].tag in RAW)
    out: list[str] = []

    def usable(i: int) -> bool:
        while i > 0:
            if gone(i):
                return False
            i = nodes[i].parent
        return True

    # articles, not those in one that is read already
    roots: list[int] = []
    for kind in ("article", "main"):
        roots = [i for i, e in enumerate(nodes) if e.tag == kind and not (e.in_article and _inside(nodes, i, kind)) and usable(i)]
        if roots:
            break
    for root in roots or [0]:
        current: list[str] = []
        stack: list = [(root, iter(nodes[root].parts))]
        while stack:
            i, parts = stack[-1]
            part = next(parts, None)
            if part is None:
                stack.pop()
            elif isinstance(part, str):
                current.append(part)
                continue
            elif gone(part):
                pass
            else:
                stack.append((part, iter(nodes[part].parts)))
            block = " ".join(html.unescape("".join(current)).split())
            current.clear()
            if block:
                out.append(block)
    return "\n\n".join(out)


def _inside(nodes: list[Element], i: int, tag: str) -> bool:
    i = nodes[i].parent
    while i > 0 and nodes[i].tag != tag:
        i = nodes[i].parent
    return i > 0


def _page_hashes(page: str | None) -> tuple[int, set[int]]:
    """(hash of the main text, hashes of the subtrees that may be template)."""
    if not page:
        return 0, set()
    nodes = parse(page)
    return xxhash.xxh3_64_intdigest(main_text(page, nodes=nodes).encode()) - 2**63, set(subtree_hashes(page, nodes).values())


def page_key(page: Column) -> Column:
    return F.md5(F.coalesce(page, F.lit("")))


def site_templates(pages: DataFrame, min_pages: int = TEMPLATE_PAGES, url="url", page="html") -> DataFrame:
    """(host, key, templates array<long>): for each page, by the hash of its markup, its subtrees that its host repeats around at least min_pages different articles.

    Copies of an article count once. Only hashes are shuffled; what is gathered is no more than one page's own subtrees.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for host, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                article, own = _page_hashes(text)
                out += [(host, key, article, h) for h in own]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["host", "key", "article", "hash"])

    hashed = pages.select(url_host(F.col(url)).alias("host"), page_key(F.col(page)).alias("key"), F.col(page).alias("html"))
    hashed = stash(hashed.mapInArrow(rows, "host string, key string, article long, hash long"))
    around = hashed.select("host", "hash", "article").distinct().groupBy("host", "hash").count()
    recurring = stash(around.filter(F.col("count") >= min_pages).select("host", "hash"))
    own = hashed.select("host", "key", "hash").distinct().join(small_side(recurring), ["host", "hash"])
    return own.groupBy("host", "key").agg(F.collect_list("hash").alias("templates"))


def extract_pages(pages: DataFrame, page_id="page_id", url="url", page="html") -> DataFrame:
    """page_id, url, text, n_chars for every row.

    Null html counts as empty and gives an empty text; a null url belongs to the empty host; very long
    pages are read whole; repeated rows stay (and count once as pages of their host); other columns are ignored; an
    empty table gives no rows.
    """
    templates = stash(site_templates(pages, url=url, page=page))
    rows_in = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    if templates.isEmpty():
        rows_in = rows_in.withColumn("templates", F.lit(None).cast("array<long>"))
    else:
        keyed = rows_in.withColumn("host", url_host(F.col("url"))).withColumn("key", page_key(F.col("html")))
        held = templates.agg(F.sum(F.size("templates"))).first()[0]  # numbers in all arrays, of 8 bytes each, bound the table
        rows_in = keyed.join(F.broadcast(templates) if held <= BROADCAST_ROWS else templates, ["host", "key"], "left").select("page_id", "url", "html", "templates")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, frozenset(t or ())) for p, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows_in.mapInArrow(rows, "page_id long, url string, text string, n_chars long")
