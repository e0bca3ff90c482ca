"""Main text of web pages by tree scoring.

A page's tags become a tree. Runs of text between block tags are paragraphs; each gives points for its length and its commas to the
containers above it: all to the nearest, half to the next, a third and so on to those beyond. A container's points are discounted by the share of its text that
lies in links. The best container is kept, as a whole article if it lies in one, with those of its siblings that score or read like it. Menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, hidden parts and comments are no part of the tree, wherever
they stand: they are known by their tags, roles, and words of their class and id.

Pages are independent, so each task works through its rows and nothing is shuffled. Null and empty pages, and pages without text,
give an empty text. Pages are read whole, however long, in time proportional to their length, unclosed and stray tags included. Ties go to the container that opens first. Repeated
rows give a result each. Columns besides page_id, url and html are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import staging

# Names of HTML elements, by what they mean here.
#: Never part of the main text, with all that they hold.
LEFT_OUT = frozenset("head title script style noscript template nav footer aside form button input select textarea option label fieldset iframe object embed svg canvas audio video map dialog menu".split())
#: Their content is plain characters up to the end tag.
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Within text; all other elements are blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: A block ends an open p; these end an open element of the same group, up to its list or table.
GROUPS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "tbody", "thead", "tfoot"), "thead": ("tr", "td", "th", "tbody", "thead", "tfoot"), "tfoot": ("tr", "td", "th", "tbody", "thead", "tfoot")}
SCOPES = frozenset("ul ol dl table body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of a class or id of what is no main text.
UNLIKELY = frozenset("""ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices notification notifications
    nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars side rail widget widgets footer foot masthead topbar header toolbar pager pagination share sharing social related recommended recommendations newsletter subscribe
    subscription signup login popup modal overlay disclaimer skip hidden""".split())
#: Reader comments, whatever else the class says.
COMMENTS = frozenset("comment comments commentlist commenter disqus respond replies reply discussion".split())
#: A word of a box around the main text and others (`content-sidebar-wrap`), and what makes it one.
LIKELY = frozenset("article content entry main page post story text blog".split())
WRAPS = frozenset("wrap wrapper container layout columns".split())
#: First words of what belongs to an article, so that its header is no page's header.
OF_ARTICLE = frozenset("article entry post story".split())

_TAG = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))|(\bhidden\b)""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WITH = re.compile(r"\b(?:with|has|no|without|is)[-_]\w+", re.I)
_QUOTE_OR_END = re.compile("[\"'>]")
_SPACE = re.compile(r"\s+")


class Node:
    """An element of the tree, or a run of text (tag None)."""

    __slots__ = ("tag", "up", "parts", "size", "linked", "text", "points", "paragraph")

    def __init__(self, tag: str | None, up: Node | None, text: str = "", in_links: int = 0):
        self.tag, self.up, self.parts, self.text, self.points = tag, up, [], text, 0.0
        self.size, self.linked = len(text), in_links  # characters of the whole subtree, and of those in links
        # the p that a block's start would close
        self.paragraph = self if tag == "p" else None if up is None or tag in SCOPES or tag in ("td", "th") else up.paragraph


def _tag_end(page: str, at: int, none_after: dict[str, int]) -> int:
    """Where the tag that begins before `at` ends: its `>`, outside quoted values. none_after: where a quote was looked for in vain."""
    while m := _QUOTE_OR_END.search(page, at):
        at = m.end()
        if m.group() == ">":
            return m.start()
        if page[max(0, m.start() - 64) : m.start()].rstrip().endswith("=") and at < none_after.get(m.group(), len(page) + 1):
            end = page.find(m.group(), at)
            if end < 0:
                none_after[m.group()] = at
            else:
                at = end + 1
    return -1


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", characters, ""), ("open", tag, attributes) and ("close", tag, "") of a page, in time linear in its length."""
    at, n, none_after = 0, len(page), {}
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            yield "text", page[at:lt], ""
        if lt == n:
            return
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        closing = page.startswith("</", lt)
        m = _TAG.match(page, lt + 1 + closing)
        if m is None:
            if page[lt + 1 : lt + 2] in ("!", "?") or closing:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                yield "text", "<", ""
                at = lt + 1
            continue
        tag = m.group().lower()
        end = _tag_end(page, m.end(), none_after)
        if end < 0:
            return  # a tag that the page's end cuts off
        at = end + 1
        if closing:
            yield "close", tag, ""
            continue
        yield "open", tag, page[m.end() : end]
        if tag in RAW:
            stop = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            at = stop.start() if stop else n


def left_out(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element and all in it is no main text."""
    if tag in LEFT_OUT or tag == "header" and not in_article:
        return True
    if not attributes.strip():
        return False
    values = {}
    for m in _ATTRIBUTE.finditer(attributes):
        values.setdefault((m.group(1) or m.group(5)).lower(), next((g for g in m.groups()[1:4] if g is not None), ""))
    if tag in ("html", "body", "main"):
        return False
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or values.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", ""), re.I):
        return True
    names = [[w.lower() for w in _WORDS.findall(name)] for name in _WITH.sub(" ", f"{values.get('class', '')} {values.get('id', '')}").split()]
    if any(COMMENTS.intersection(words) for words in names):
        return True
    return tag != "article" and tag not in HEADINGS and any(_unlikely(words, in_article) for words in names)


def _unlikely(words: list[str], in_article: bool) -> bool:
    """Whether the words of one name of a class or id are those of no main text."""
    found = UNLIKELY.intersection(words)
    if found == {"header"} and (in_article or words[0] in OF_ARTICLE):
        return False
    return bool(found) and not (words[-1] in WRAPS and LIKELY.intersection(words))


def tree(page: str) -> Node:
    """The page's tree of what may be main text."""
    root = node = Node("html", None)
    run: list[tuple[str, bool]] = []
    links = articles = 0  # open a elements; open articles
    opened: dict[str, int] = {}  # open elements by tag
    gone: list[str] = []  # open elements of a part that is left out

    def flush() -> None:
        if run:
            whole = _SPACE.sub(" ", "".join(s for s, _ in run)).strip()
            if whole:
                linked = min(len(whole), len(_SPACE.sub(" ", "".join(s for s, in_link in run if in_link)).strip()))
                node.parts.append(Node(None, node, whole, linked))
            run.clear()

    def leave(until: Node) -> Node:
        """Closes the open elements below `until`, and it."""
        nonlocal articles
        flush()
        at = node
        while True:
            articles -= at.tag == "article"
            opened[at.tag] -= 1
            if at is until:
                return at.up
            at = at.up

    def nearest(tags: tuple[str, ...], scopes: frozenset[str]) -> Node | None:
        at, found = node, None
        if not any(opened.get(tag) for tag in tags):
            return None
        while at.up is not None and at.tag not in scopes:
            if at.tag in tags:
                found = at
                if len(tags) == 1:
                    break
            at = at.up
        return found

    for kind, what, attributes in tokens(page):
        if gone:
            if kind == "open" and what == gone[0] and what not in VOID:
                gone.append(what)
            elif kind == "close" and what == gone[0]:
                gone.pop()
            elif kind == "close" and what in ("body", "html"):
                gone.clear()
            continue
        if kind == "text":
            run.append((references.unescape(what), links > 0))
        elif what == "br" or what in ("hr", "wbr") and kind == "open":
            if what == "br":
                run.append((" ", links > 0))
            elif what == "hr":
                flush()
        elif kind == "open":
            inline = what in INLINE
            if not inline:
                flush()
                links = 0
                if node.paragraph is not None:
                    node = leave(node.paragraph)
                if what in GROUPS:
                    same = nearest(GROUPS[what], SCOPES - {what})
                    if same is not None:
                        node = leave(same)
            if left_out(what, attributes, articles > 0):
                if what not in VOID and not attributes.rstrip().endswith("/"):
                    gone.append(what)
                    flush()
            elif what == "a":
                links = 1
            elif not inline and what not in VOID and what != "html":
                child = Node(what, node)
                node.parts.append(child)
                node, articles = child, articles + (what == "article")
                opened[what] = opened.get(what, 0) + 1
        elif what == "a":
            links = 0
        elif what not in INLINE:
            flush()
            links = 0
            mine = nearest((what,), frozenset())
            if mine is not None:
                node = leave(mine)
    flush()
    return root


def _walk(root: Node) -> list[Node]:
    """All nodes, each before its parts, in page order."""
    out, open_ = [], [root]
    while open_:
        node = open_.pop()
        out.append(node)
        open_ += reversed(node.parts)
    return out


def _density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def main_text(page: str) -> str:
    """The main text of a page: its blocks in page order, joined by empty lines."""
    root = tree(page)
    nodes = _walk(root)
    for node in reversed(nodes):
        if node.up is not None:
            node.up.size += node.size
            node.up.linked += node.linked
    for run in nodes:
        if run.tag is None:
            length = len(run.text)
            points = (length >= 25) + length / 100 + run.text.count(",")
            at = run.up.up if run.up.tag in ("p", "pre", "blockquote", *HEADINGS) and run.up.up is not None else run.up
            level = 1
            while at is not None and level <= 6:
                at.points += points / level
                at, level = at.up, level + 1
    containers = [x for x in nodes if x.tag is not None and x.size]
    if not containers:
        return ""
    score = lambda x: x.points * (1 - _density(x))
    best = max(containers, key=score)
    at = best
    while at is not None:
        if at.tag == "article":
            best = at
        at = at.up
    kept = [best]
    if best.up is not None:
        kept = [x for x in best.up.parts if x is best or _belongs(x, best, score)]
    return "\n\n".join(x.text for top in kept for x in _clean(top))


def _belongs(node: Node, best: Node, score) -> bool:
    """Whether a sibling of the best container is main text too."""
    if not node.size or _density(node) > 0.25:
        return False
    if best.tag == "article":
        return node.tag == "article" and score(node) >= 0.2 * score(best)
    return node.tag in HEADINGS or node.tag in (None, "p", "pre", "blockquote", best.tag) or score(node) >= 0.1 * score(best)


def _clean(top: Node) -> list[Node]:
    """The runs of a kept container, without lists and boxes of links."""
    out, open_ = [], [top]
    while open_:
        node = open_.pop()
        if node.tag is None:
            out.append(node)
        elif node is top or node.tag in ("p", *HEADINGS, "li", "td", "th", "tr", "blockquote") or _density(node) <= 0.5:
            open_ += reversed(node.parts)
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) if page else "" for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    with staging.narrow_batches(pages.sparkSession):
        out = pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
    return out
