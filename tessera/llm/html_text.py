"""Main text of web pages by tree scoring.

Paragraphs give points for their length and commas to their ancestors, less for farther ones; an ancestor's
points are discounted by the share of its text that is links. The best container is kept with those of its siblings
that score well. Parts that a page marks by elements as no content (navigation, scripts, hidden parts) leave the tree first;
names of classes, first words and forms only make a part suspect, and a suspect part leaves only if the page's points
are elsewhere.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: From behind a tag's name to its end; quoted values may hold ">". It never goes back.
_REST = re.compile(r"""[^"'>]*+(?:(?:"[^"]*+"|'[^']*+')[^"'>]*+)*+>""")
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
_ENDS_P = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split())
#: Opening the key closes the nearest open element of the first set, unless one of the second is nearer.
_SAME = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
_DROP = frozenset("head script style noscript template svg nav footer aside button select option input textarea iframe object dialog menu title canvas audio video".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
_BAD = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promos promotion cookie cookies consent gdpr comment comments commentlist disqus replies respond discussion reactions "
    "nav navbar navigation menu breadcrumb breadcrumbs footer share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay pagination pager paywall".split()
)
_WEAK = frozenset("sidebar aside banner notice notices header masthead topbar toolbar widget widgets alert legal copyright promo teaser tags meta byline".split())
_GOOD = frozenset("article main content post entry story body text".split())
#: Words that make a class name say how a page is laid out, not what a part holds.
_STATE = frozenset("has no not with without is closed open opened enabled disabled off on layout page site wrapper wrap".split())
_PARAGRAPH = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6".split())
_SECTIONS = frozenset("div section table ul ol dl form fieldset center".split())
#: First words of a part that holds readers' comments, and sentences that only notices have, in the languages that pages come in.
_COMMENTS = re.compile(r"\W*(?:\d+\s+)?(?:comments?|replies|responses|leave a (?:reply|comment)|kommentare?|commentaires?|comentarios?)\b[^.,;]{0,40}$", re.I)
_NOTICE = re.compile(
    r"\b(?:(?:uses?|accept(?: all)?) cookies|cookies? (?:policy|settings|notice)|subscribe to our|sign up (?:for|to) our|all rights reserved|terms of (?:use|service)|privacy policy|enable javascript|"
    r"verwendet? cookies|alle rechte vorbehalten|utilis\w+ (?:des|les) cookies|tous droits réservés|(?:usa|utiliza)\w* cookies|todos los derechos reservados)\b",
    re.I,
)
#: A notice is no longer than this, and a suspect part stays if it holds more than this share of the page's points.
_NOTICE_CHARS, _MOST = 400, 0.75
#: Ancestors that a paragraph gives points to, and open elements that one tag is held against.
_FAR, _DEEP = 12, 512


class _Node:
    __slots__ = ("attrs", "bad", "commas", "first", "kids", "links", "marks", "own", "parent", "score", "size", "tag", "total")

    def __init__(self, tag, parent, attrs=""):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.kids: list = []
        self.score, self.size, self.links, self.commas, self.bad = 0.0, 0, 0, 0, False
        self.own, self.total, self.marks, self.first = 0.0, 0.0, 0, ""


def parse(html: str) -> _Node:
    """A forgiving tree, in time proportional to the length; comments and raw text elements leave nothing."""
    root = _Node("#", None)
    at, stack, n = 0, [root], len(html)
    opened: dict[str, int] = {}
    last = html.rfind(">")

    def close(i):
        for node in stack[i:]:
            opened[node.tag] -= 1
        del stack[i:]

    while at < n:
        lt = html.find("<", at)
        if lt < 0 or lt > last:
            # an unclosed tag at the end is cut off there
            cut = n if lt < 0 else next((i for i in _openers(html, lt)), n)
            stack[-1].kids.append(unescape(html[at:cut]))
            break
        if lt > at:
            stack[-1].kids.append(unescape(html[at:lt]))
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = end + 3 if end >= 0 else n
            continue
        if html.startswith("<![CDATA[", lt):
            end = html.find("]]>", lt)
            if end >= 0:
                stack[-1].kids.append(html[lt + 9 : end])
                at = end + 3
                continue
        ends = html.startswith("</", lt)
        m = _NAME.match(html, lt + 2 if ends else lt + 1)
        if not m:
            if ends or html.startswith(("<!", "<?"), lt):
                at = html.find(">", lt) + 1
            else:
                stack[-1].kids.append("<")
                at = lt + 1
            continue
        rest = _REST.match(html, m.end())
        at = rest.end() if rest else html.find(">", m.end()) + 1 or n
        tag, attrs = m[0].lower(), html[m.end() : at - 1]
        if ends:
            if opened.get(tag):
                for i in range(len(stack) - 1, max(0, len(stack) - 1 - _DEEP) if tag in _INLINE else 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if tag in _INLINE and stack[i].tag not in _INLINE:
                        break
            continue
        floor = max(0, len(stack) - 1 - _DEEP)
        if tag in _ENDS_P and opened.get("p"):
            for i in range(len(stack) - 1, floor, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag not in _INLINE:
                    break
        if tag in _SAME and any(opened.get(x) for x in _SAME[tag][0]):
            shut, walls = _SAME[tag]
            for i in range(len(stack) - 1, max(0, len(stack) - 1 - _DEEP), -1):
                if stack[i].tag in walls:
                    break
                if stack[i].tag in shut:
                    close(i)
                    if tag in ("td", "th", "li", "dt", "dd", "option"):
                        break
        node = _Node(tag, stack[-1], attrs)
        stack[-1].kids.append(node)
        if tag in _VOID or attrs.endswith("/") and tag in ("svg", "path"):
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        stack.append(node)
        opened[tag] = opened.get(tag, 0) + 1
    return root


def _openers(html: str, lt: int):
    """Where, from ``lt`` on, a tag or a comment begins."""
    return (m.start() for m in re.compile(r"<(?:[a-zA-Z/!?])").finditer(html, lt))


_H1, _HEAD, _MAIN = 1, 2, 4


def _kind(node: _Node, in_article: bool) -> str:
    """gone: no content, whatever it holds; suspect: no content if the page's points are elsewhere; else empty."""
    if node.tag in _DROP:
        return "gone"
    if node.tag == "header":
        return "" if node.marks & _HEAD and in_article else "suspect" if node.marks & _HEAD else "gone"
    suspect = node.tag == "form"
    tokens, role = [], ""
    for k, a, b, c in _ATTR.findall(node.attrs) if node.attrs else ():
        k, v = k.lower(), a or b or c
        if k in ("class", "id"):
            tokens += v.split()
        elif k == "role":
            role = v.lower()
        elif (k == "hidden" or k == "aria-hidden" and v.lower() == "true" or k == "style" and re.search(r"display\s*:\s*none", v, re.I)) and node.tag not in ("body", "html"):
            return "gone"
    if node.tag in ("body", "html", "main", "#"):
        return ""
    words = set()
    for t in tokens:
        parts = {w.lower() for w in _SPLIT.split(t) if w}
        if not parts & _STATE:
            words |= parts
    if role in _ROLES or words & _BAD or words & _WEAK and not words & _GOOD:
        if not (words & {"header"} and in_article and node.marks & _HEAD):
            return "suspect"
    if node.tag in _SECTIONS and node.first and (_COMMENTS.match(node.first) and node.size > len(node.first) or node.size <= _NOTICE_CHARS and _NOTICE.search(node.first)):
        return "suspect"
    return "suspect" if suspect else ""


def _walk(root: _Node) -> list[_Node]:
    """Nodes that are left, in page order."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(k for k in reversed(node.kids) if not isinstance(k, str) and not k.bad)
    return order


def _sizes(order: list[_Node]) -> None:
    """Text, links, commas, points, headings of each node and all that it holds."""
    for node in order:
        node.size = node.links = node.commas = node.marks = 0
        node.own = node.total = node.score = 0.0
        node.first = ""
    for node in reversed(order):
        direct = [k for k in node.kids if isinstance(k, str)]
        node.size += sum(len(" ".join(k.split())) for k in direct)
        node.commas += sum(k.count(",") for k in direct)
        if node.tag == "a":
            node.links = node.size
        node.marks |= _H1 | _HEAD if node.tag == "h1" else _HEAD if node.tag in ("h2", "h3") else _MAIN if node.tag in ("article", "main") else 0
        own = node.tag in _PARAGRAPH or node.tag not in _INLINE and any(not k.isspace() and k for k in direct)
        if own and node.size and (node.tag == "p" or not any(not isinstance(k, str) and not k.bad and k.tag in ("p", "li", "table", "ul", "ol", "div") for k in node.kids)):
            node.own = (1 + node.commas + min(3.0, node.size / 100)) * (1 - node.links / node.size)
        node.total += node.own
        if node.tag in _SECTIONS or node.tag in _PARAGRAPH:
            # what the part begins with: its first block, or its own text
            held = next((k for k in node.kids if not isinstance(k, str) and not k.bad and k.size), None)
            text = " ".join("".join(direct).split())
            node.first = held.first if held is not None and held.first and not text else text if held is None or len(text) > 3 else held.first or text
            node.first = node.first[:_NOTICE_CHARS]
        elif node.tag in _INLINE:
            node.first = " ".join("".join(direct).split())[:_NOTICE_CHARS]
        if node.parent is not None:
            up = node.parent
            up.size, up.links, up.commas = up.size + node.size, up.links + node.links, up.commas + node.commas
            up.total, up.marks = up.total + node.total, up.marks | node.marks


def _prune(root: _Node) -> list[_Node]:
    """Mark what is no content; the nodes that are left, with their sizes."""
    order = _walk(root)
    _sizes(order)
    inside, suspects, todo = {id(root): False}, [], []
    for node in order:
        if node is root:
            continue
        held = inside.get(id(node.parent))
        if held is None:  # in something that has gone
            continue
        kind = _kind(node, held)
        if kind == "gone":
            node.bad = True
            continue
        inside[id(node)] = held or node.tag in ("article", "main")
        if kind:
            suspects.append(node)
    for node in order:
        if node.bad:
            todo.append(node)
    if todo:
        order = _walk(root)
        _sizes(order)
    left, h1 = root.total, root.marks & _H1
    for node in suspects:  # outer ones first
        up = node.parent
        while up is not None and not up.bad and up.tag in _INLINE:
            up = up.parent
        if up is not None and up.bad:
            node.bad = True
            continue
        most = node.total > _MOST * left
        if node.marks & _H1 or most and not (h1 and left > node.total) or node.marks & _MAIN and not _COMMENTS.match(node.first) and not _about_comments(node):
            continue
        node.bad = True
        left -= node.total
        gone = [node]
        while gone:  # what it holds is settled too
            for k in gone.pop().kids:
                if not isinstance(k, str) and not k.bad:
                    k.bad = True
                    gone.append(k)
    order = _walk(root)
    _sizes(order)
    return order


def _about_comments(node: _Node) -> bool:
    return any("comment" in (a or b or c).lower() for k, a, b, c in _ATTR.findall(node.attrs) if k.lower() in ("class", "id"))


def _scored(order: list[_Node]) -> None:
    """Paragraphs give their points to their ancestors."""
    for node in order:
        if node.own:
            up, far = node.parent if node.tag in _PARAGRAPH else node, 0
            while up is not None and up.tag != "#" and far < _FAR:
                up.score += node.own / (1 if far == 0 else 2 if far == 1 else 3 * far)
                up, far = up.parent, far + 1


def _weight(node: _Node) -> float:
    bonus = 25.0 if node.tag in ("article", "main") else 0.0
    if node.attrs and any(w in _GOOD for k, a, b, c in _ATTR.findall(node.attrs) if k.lower() in ("class", "id") for w in {x.lower() for x in _SPLIT.split(a or b or c)}):
        bonus += 10.0
    if node.marks & _H1:
        bonus += 10.0
    return (node.score + bonus) * (1 - node.links / node.size)


def _titled(order: list[_Node]) -> _Node | None:
    """The nearest part around the first main heading that holds a fair share of the page's points."""
    up = next((n for n in order if n.tag == "h1"), None)
    while up is not None and up.total < 0.15 * order[0].total:
        up = up.parent
    return up


def _holds(node: _Node | None, other: _Node | None) -> bool:
    while other is not None and other is not node:
        other = other.parent
    return other is not None


def _text(nodes: list[_Node]) -> str:
    blocks, now = [], []

    def flush():
        t = " ".join("".join(now).split())
        if t:
            blocks.append(t)
        now.clear()

    for top in nodes:
        flush()
        todo: list = [top]
        while todo:
            k = todo.pop()
            if k is None:
                flush()
            elif isinstance(k, str):
                now.append(k)
            elif k.tag == "br":
                now.append(" ")
            elif not k.bad:
                if k.tag not in _INLINE:
                    flush()
                    todo.append(None)
                todo.extend(reversed(k.kids))
        flush()
    return " ".join(blocks)


def extract(html: str | None) -> str:
    """The main text; empty for null, empty or blank input, and for pages without any."""
    if not html or not html.strip():
        return ""
    root = parse(html)
    order = _prune(root)
    _scored(order)
    scored = [n for n in order if n.score > 0 and n.size and n.tag not in _INLINE]
    if not scored:
        return _text([next((n for n in order if n.tag in ("article", "main") and n.size), root)])
    best, top = None, 0.0
    for n in scored:
        w = _weight(n)
        if w > top or best is None:
            best, top = n, w
    titled = _titled(order)
    if titled is not None and not _holds(titled, best) and not _holds(best, titled):
        best, top = titled, max(1e-9, _weight(titled))
    up = best.parent
    while up is not None and up.tag not in ("body", "html", "#"):  # parts of one article belong together
        if up.tag in ("article", "main") and up.size:
            best, top = up, max(top, _weight(up))
            if up.tag == "article":
                break
        up = up.parent
    if best.tag in ("body", "html", "#", "main") or best.parent is None:
        return _text([best])
    keep = []
    for s in best.parent.kids:
        if isinstance(s, str) or s.bad or not s.size:
            continue
        density = s.links / s.size
        alike = s.tag == best.tag and s.attrs.split() == best.attrs.split()
        if s is best or alike and s.score > 0 and _weight(s) >= max(min(10.0, top), 0.2 * top) or s.tag in ("p", "h1", "h2", "h3", "pre", "blockquote") and best.tag not in ("article",) and density < 0.25:
            keep.append(s)
    return _text(keep)


def _run(batches):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    for batch in batches:
        texts = [extract(h) for h in column(batch, "html").to_pylist()]
        yield pa.record_batch([column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of ``pages``.

    Null, empty and blank pages have empty text; equal pages have equal text; broken markup is read as far as it goes, in
    time proportional to its length; of containers that score alike the first on the page is the best and its like stay as siblings; nothing is capped: long
    pages are read whole. Rows that share an id, or have none, keep one row each. Other columns are ignored, whatever their names; an empty table gives an empty table.
    """
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(_run, "page_id long, url string, text string, n_chars long")
