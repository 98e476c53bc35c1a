"""Main text of HTML pages by composite text density.

Every DOM node has C characters of text under it, T tags, and of both those in links, LC and LT. Its
composite density is C / T, scaled down by how much of it is links, relative to the page's body. A
node's density sum is the sum of its children's densities; the node with the greatest sum lies in the
article, among those of <article> elements where the page has any. The least density on its path up to
the body is the threshold.

The article is the <article> around that node, or the first node on the path from the body whose text
stands for a good part in it directly, not in containers of its own. Beside the path, containers belong to it
too if they reach the threshold, hold prose and few links, and so do further <article>s of one parent. Within it,
containers below the threshold go if they are links alone, with the heading right above them, and outside an <article> if they hold
no prose and stand before or after all that does.

Left out beforehand are elements that are never article text by their tag (menus, footers, forms, scripts ...), and
those that a whole token of their class, id or role names as something else. Names are not believed where they would
take the article with them; ambiguous ones never on paragraphs and their like. Those of readers' comments are believed though
there are <article>s in them, and an <article> named as a comment or a teaser is none.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import slices

_TAG = re.compile(r"</?[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?", re.S)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")
_NUMBER = re.compile(r"&#(?:0*([0-9]{8,})|[xX]0*([0-9a-fA-F]{8,}));?")
_ZEROS = re.compile(r"&#([xX]?)0{8,}")

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes"}
_RAW_END = {t: re.compile(rf"</{t}\s*>?", re.I) for t in RAW}
#: Tags whose text is never the article's; a <form> or <header> may be wrapped around it.
NOT_TEXT = RAW | {"head", "nav", "footer", "aside", "button", "select", "option", "datalist", "template", "svg", "object", "canvas", "audio", "video", "dialog", "menu", "input", "label", "fieldset", "map"}
#: Words of names, for parts of a page other than its article. A name counts if all its words are among these and NEUTRAL ones.
NAMED = set(
    "ad ads adv advert adverts advertisement advertising adsbygoogle adsense sponsor sponsored sidebar nav navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent gdpr comments "
    "disqus newsletter subscribe signup login share sharing social pagination pager paging toolbar popup modal skip contentinfo complementary".split()
)
#: The same, but believed of containers only.
NAMED_CONTAINER = set("banner promo promotion promoted aside foot comment respond reply replies discussion notice notification alert overlay subscription related recommended recommendations widget search disclaimer dialog".split())
#: The same, for containers outside an article: it may have a header of its own.
NAMED_HEADER = {"header", "masthead", "hero", "topbar"}
#: Words that say that readers' comments stand there, whatever elements these are made of; and that an <article> is none.
COMMENTS = set("comments commentlist respond disqus".split())
NO_ARTICLE = set("comment reply teaser related recommended promo promoted sponsored sponsor ad advert advertisement widget".split()) | COMMENTS
NEUTRAL = set(
    "in inline site page main left right top bottom box bar list wrapper wrap container area section block inner outer group row col column item items link links icon icons button buttons primary secondary global "
    "post article reader user users form thread unit slot zone mobile desktop sticky fixed float body text message policy".split()
)
_HEADER_NEUTRAL = {"site", "page", "main", "top", "global", "bar", "wrapper", "wrap", "inner", "container"}
#: Elements that hold others; what stands in them is told by their children.
CONTAINER = {"html", "body", "main", "article", "div", "section", "center", "form", "header", "details", "table", "tbody", "thead", "tfoot", "tr", "td", "th"}
#: Characters without link of a block from which on it counts as prose.
PROSE = 80
#: A scan for an element to be closed by implication looks so far up; browsers nest no deeper.
DEPTH = 512
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "listing main menu nav ol option optgroup p plaintext pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: A start tag of the first kind ends open elements of the second, up to one of the third.
_P_ENDS = BLOCK - {"br", "body", "html", "head", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "caption", "title", "legend", "figcaption"}
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_P_SCOPE = {"table", "td", "th", "caption", "button", "html", "body", "article", "section", "main", "blockquote", "div", "li", "dd", "figure", "details"}


class Node:
    __slots__ = ("tag", "parent", "children", "name", "out", "article", "chars", "tags", "link_chars", "link_tags", "density", "total", "plain", "paragraphs", "holds_article", "holds_title")

    def __init__(self, tag: str, parent: Node | None, name: int, article: bool):
        self.tag, self.parent, self.name, self.article = tag, parent, name, article
        self.children: list = []  # nodes and strings in page order
        self.out = self.holds_article = self.holds_title = False
        self.chars = self.tags = self.link_chars = self.link_tags = self.plain = self.paragraphs = 0
        self.density = self.total = 0.0


#: What tag and names say of an element: nothing, not the article unless that is in it, the same unless it is most of the page, not the
#: article unless the page's title or <main> is in it, never.
FREE, WEAK, DOUBTFUL, COMMENT, NEVER = 0, 1, 2, 3, 4


def named(tag: str, value: str, in_article: bool) -> int:
    """What a class, id or role says."""
    found = FREE
    for token in value.split():
        words = {w.lower() for w in _WORD.findall(token) if not w.isdigit()}
        if tag == "article":
            if words & NO_ARTICLE and words <= NO_ARTICLE | NEUTRAL:
                return COMMENT
            continue
        if words & COMMENTS and words <= COMMENTS | NAMED_CONTAINER | NEUTRAL and (tag in CONTAINER or tag in ("ul", "ol", "dl")):
            return COMMENT
        if words and tag in CONTAINER and not in_article and words & NAMED_HEADER and words <= NAMED_HEADER | _HEADER_NEUTRAL:
            found = max(found, DOUBTFUL)
        elif words & NAMED and words <= NAMED | NAMED_CONTAINER | NAMED_HEADER | NEUTRAL:
            return WEAK
        elif tag in CONTAINER or tag in ("ul", "ol", "dl"):
            if words & NAMED_CONTAINER and words <= NAMED_CONTAINER | NEUTRAL:
                found = max(found, DOUBTFUL)
    return found


def _kind(tag: str, attributes: str, in_article: bool) -> int:
    if tag in NOT_TEXT:
        return NEVER
    kind = WEAK if tag == "header" and not in_article else DOUBTFUL if tag == "form" else FREE
    for name, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            if value and kind != COMMENT and tag not in ("html", "body", "main"):
                said = named(tag, value, in_article)
                kind = said if said == COMMENT or said == WEAK else kind if kind == WEAK else max(kind, said)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return NEVER
    return kind


def unescaped(s: str) -> str:
    """Character references decoded; numbers beyond any character, however long, become U+FFFD."""
    if "&" not in s:
        return s
    if "&#" in s:
        s = _NUMBER.sub("\uFFFD", _ZEROS.sub(r"&#\g<1>0", s))
    return html.unescape(s)


class _Tags:
    """Where tags end, in time linear in the page: '>' in quotes doesn't count, unless a tag would then never end."""

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in ">\"'"}
        self.quotes = True

    def end(self, at: int) -> int:
        """The place of the '>' that ends a tag whose name ends at ``at``; -1 if none does."""
        page = self.page
        first = page.find(">", at) if at <= self.last[">"] else -1
        if first < 0 or not self.quotes:
            return first
        here = at
        while m := _QUOTED.search(page, here):
            c, here = m[0], m.end()
            if c == ">":
                return m.start()
            if here <= self.last[c]:
                here = page.find(c, here) + 1
        self.quotes = False
        return first


_QUOTED = re.compile("[>\"']")


def parse(page: str) -> Node:
    """The page as a tree. Tags that are never closed, closed twice or cut off are taken as browsers take them."""
    root = Node("html", None, FREE, False)
    at, here, open_tags, n_open, tags = 0, root, [root], Counter(), _Tags(page)
    held: list[str] = []

    def flush() -> None:
        if held:
            here.children.append(unescaped("".join(held)))
            held.clear()

    def close(to: int) -> None:
        for x in open_tags[to:]:
            n_open[x.tag] -= 1
        del open_tags[to:]

    while (start := page.find("<", at)) >= 0:
        if start > at:
            held.append(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = end + 1 if end >= 0 else len(page)
            continue
        m = _TAG.match(page, start)
        if not m:
            if page.startswith("</", start) and start < tags.last[">"]:
                at = page.find(">", start) + 1
            else:
                held.append("<")
                at = start + 1
            continue
        end = tags.end(m.end())
        if end < 0:  # cut off: what follows is no text
            at = len(page)
            break
        at = end + 1
        closing, tag = m[0][1] == "/", m[0].lstrip("</").lower()
        attributes = page[m.end() : end]
        flush()
        if closing:
            if n_open[tag]:
                k = len(open_tags) - 1
                while open_tags[k].tag != tag:
                    k -= 1
                close(k)
                here = open_tags[-1]
            continue
        if tag == "html":
            continue
        ends, scope = ({"p"}, _P_SCOPE) if tag in _P_ENDS else IMPLIED.get(tag, ((), ()))
        if any(n_open[x] for x in ends):
            for i in range(len(open_tags) - 1, max(0, len(open_tags) - 1 - DEPTH), -1):
                if open_tags[i].tag in ends:
                    close(i)
                    here = open_tags[-1]
                    break
                if open_tags[i].tag in scope:
                    break
        node = Node(tag, here, _kind(tag, attributes, here.article), here.article or tag in ("article", "main"))
        here.children.append(node)
        if tag in RAW and not attributes.endswith("/"):
            stop = _RAW_END[tag].search(page, at)
            at = stop.end() if stop else len(page)
        elif tag not in VOID:
            open_tags.append(node)
            n_open[tag] += 1
            here = node
    held.append(page[at:])
    flush()
    return root


def leave_out(root: Node) -> None:
    """Mark the elements that aren't the article's by tag or name."""
    order, stack = [], [(root, False)]
    while stack:
        x, linked = stack.pop()
        order.append((x, linked))
        stack += [(c, linked or x.tag == "a") for c in x.children if isinstance(c, Node) and c.name != NEVER]
    for x, linked in reversed(order):
        x.paragraphs += x.tag == "p"
        x.holds_article |= x.tag == "article" and x.name != COMMENT or x.tag == "main"
        x.holds_title |= x.tag in ("h1", "main")
        for c in x.children:
            if not isinstance(c, str):
                x.plain += c.plain
                x.paragraphs += c.paragraphs
                x.holds_article |= c.holds_article
                x.holds_title |= c.holds_title
            elif not linked and x.tag != "a":
                x.plain += len(c.strip())
    most = next((x.plain for x, _ in order if x.tag == "body"), root.plain) / 2
    stack = [root]
    while stack:
        x = stack.pop()
        for c in x.children:
            if isinstance(c, Node):
                wraps = c.holds_article or c.name == DOUBTFUL and c.plain > most and c.paragraphs > 1
                wraps = c.holds_title and c.tag != "article" if c.name == COMMENT else wraps
                c.out = x.out or c.name == NEVER or c.name != FREE and not wraps
                stack.append(c)


def measure(root: Node) -> list[Node]:
    """Fill in counts, densities and sums of all nodes that may hold text; the nodes in page order."""
    leave_out(root)
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [c for c in reversed(x.children) if isinstance(c, Node) and not c.out]
    for x in reversed(order):
        for c in x.children:
            if isinstance(c, str):
                x.chars += len(c.strip())
            elif not c.out:
                x.chars += c.chars
                x.tags += c.tags + 1
                x.link_chars += c.link_chars
                x.link_tags += c.link_tags + (c.tag == "a")
        if x.tag == "a":
            x.link_chars = x.chars
    body = next((x for x in order if x.tag == "body"), root)
    share = body.link_chars / max(body.chars, 1)
    for x in order:
        if x.chars:
            tags, link_chars, link_tags = max(x.tags, 1), max(x.link_chars, 1), max(x.link_tags, 1)
            base = math.log(x.chars / max(x.chars - x.link_chars, 1) * x.link_chars + share * x.chars + math.e)
            ratio = x.chars / link_chars * tags / link_tags
            x.density = x.chars / tags * max(0.0, math.log(max(ratio, 1.0)) / math.log(max(base, 1.001)))
    for x in order:
        x.total = sum(c.density for c in x.children if isinstance(c, Node) and not c.out)
    return order


def is_prose(x: Node | str) -> bool:
    """Text, paragraphs, lists and their like, and containers of nothing else."""
    return isinstance(x, str) or x.tag not in CONTAINER or not any(isinstance(c, Node) and not c.out and (c.tag in CONTAINER or c.tag in BLOCK and c.tag != "br") for c in x.children)


def _plain(x: Node | str) -> int:
    return len(x.strip()) if isinstance(x, str) else 0 if x.out else x.chars - x.link_chars


def stands_in(x: Node) -> bool:
    """Whether a good part of the text under x stands in it directly."""
    return 4 * sum(_plain(c) for c in x.children if is_prose(c)) >= x.chars - x.link_chars


def longest(x: Node) -> int:
    """Characters without link of the longest prose element under x."""
    most, stack = 0, [x]
    while stack:
        y = stack.pop()
        if is_prose(y):
            most = max(most, _plain(y))
        else:
            stack += [c for c in y.children if isinstance(c, str) or not c.out]
    return most


def chosen(root: Node) -> tuple[list[Node], float, Node | None]:
    """(the subtrees that hold the article, in page order; the threshold; the one in which containers must hold prose)."""
    order = measure(root)
    inside, articles = set(), False
    for x in order:
        if x.tag == "article" and x.chars or id(x.parent) in inside:
            inside.add(id(x))
    pool = [x for x in order if id(x) in inside] or order
    articles = bool(inside)
    best = max(pool, key=lambda x: (x.total, x.tag == "article" and x.chars))
    if best.total == 0 and not articles:
        return [root], 0.0, None
    path, x = [], best
    while x is not None and x.tag != "html":
        path.append(x)
        if x.tag == "body":
            break
        x = x.parent
    least = min((x.density for x in path), default=0.0)
    if articles:
        own = [x for x in path if x.tag == "article"][0]
        return [x for x in own.parent.children if x is own or isinstance(x, Node) and x.tag == "article" and not x.out and is_sister(x, least)], least, None
    top = next((x for x in reversed(path) if stands_in(x)), best)
    while not stands_in(top):
        heavy = [c for c in top.children if isinstance(c, Node) and not c.out and 2 * _plain(c) > _plain(top)]
        if not heavy:
            break
        top = heavy[0]
    found, x, before = [top], top, set()
    place = {id(y): i for i, y in enumerate(order)}
    while x.parent is not None and x.tag not in ("body", "html"):
        for c in x.parent.children:
            if isinstance(c, Node) and c is not x and not c.out and c.chars:
                title = c.tag == "h1" and not c.link_chars and place[id(c)] < place[id(x)]
                if title or is_sister(c, least):
                    found.append(c)
        x = x.parent
    return sorted(found, key=lambda y: place[id(y)]), least, top


def is_sister(x: Node, least: float) -> bool:
    """Whether a container beside the article's belongs to it too: it reaches the threshold, holds prose and few links."""
    return x.density >= least and 10 * x.link_chars <= x.chars and longest(x) >= PROSE


def beside(x: Node, least: float, strict: bool) -> bool:
    """Whether a container in the article is links alone or, under strict, no prose either."""
    if x.density >= least or x.tag not in CONTAINER and x.tag not in ("ul", "ol", "dl"):
        return False
    return x.link_tags > 2 and 10 * x.link_chars >= 9 * x.chars or strict and x.tag in CONTAINER and longest(x) < PROSE


def blocks(node: Node, least: float = 0.0, strict: bool = False) -> list[str]:
    """Texts of the blocks under node, white space collapsed; empty ones left out."""
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        s = _SPACE.sub(" ", "".join(held)).strip()
        if s:
            out.append(s)
        held.clear()

    around: set[int] = set()
    if strict:  # short blocks among titles and paragraphs, such as a byline or a caption, belong to them
        kids = [c for c in node.children if isinstance(c, Node) and not c.out]
        prose = [i for i, c in enumerate(kids) if c.tag in ("p", "h1") or longest(c) >= PROSE]
        around = {id(c) for i, c in enumerate(kids) if not prose or i < prose[0] or i > prose[-1]}
    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            held.append(x)
        elif not x.out and (x is node or not beside(x, least, id(x) in around)):
            if x.tag in BLOCK:
                close()
                stack.append(None)
            stack += reversed(_without_titles_of_links(x, least))
    close()
    return out


def _without_titles_of_links(x: Node, least: float) -> list:
    """The children of x but for a heading right above links alone, which are left out."""
    gone, after = set(), None
    for c in reversed(x.children):
        if isinstance(c, Node) and not c.out and c.chars:
            if c.tag in ("h2", "h3", "h4", "h5", "h6") and after is not None and beside(after, least, False):
                gone.add(id(c))
            after = c
        elif isinstance(c, str) and c.strip():
            after = None
    return [c for c in x.children if id(c) not in gone] if gone else x.children


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found, least, top = chosen(parse(page))
    # where most of the text is in paragraphs, containers before and after them must hold prose
    strict = top is not None and 2 * sum(_plain(c) for c in top.children if isinstance(c, Node) and c.tag == "p") >= _plain(top)
    return " ".join(b for x in found for b in blocks(x, least, strict and x is top))


def _extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (x for whole in batches for x in slices(whole, 2)):
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(x) for x in b.column(2).to_pylist()], pa.string())], ["id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id_col, url_col, text ('' if the page is null or empty or has no article), n_chars.

    Null ids and urls stay null; repeated rows are extracted each; an empty table gives an empty result. Only the three
    columns are read.
    """
    src = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    out = src.mapInArrow(_extracted, "id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
