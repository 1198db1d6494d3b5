"""Main text of web pages by tree scoring.

Text blocks pass points for length and commas to their ancestors; an element's points are discounted by its
link density; the best container and those siblings that score well beside it are kept. Elements that by
their tag or role hold menus, headers, footers, sidebars, notices, adverts or forms are cut before. Words of a
class or id are evidence against an element, weighed by what it holds: one marked by a weak word stays if half
of the page's points are in it, one marked by a strong word (a sidebar, a menu) if next to nothing is outside of
it; adverts, consent and reader comments never do. Each page is read once, by one pass over its tags; work and memory are linear in it.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import per_batch, tune

_TAG = re.compile(r"""<!--(?:.*?-->|.*)|(<!\[CDATA\[)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RAW_END = {name: re.compile(rf"</{name}[\s/>]|</{name}$", re.I) for name in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is never text of the article.
DROPPED = frozenset("head script style noscript template nav footer aside form fieldset button select option textarea iframe object embed svg math canvas audio video menu dialog search noembed noframes title xmp datalist".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of a class or id that mark what never is the article,
_NEVER = frozenset(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr "
    "newsletter subscribe subscription signup comment comments commentlist respond replies disqus footer".split()
)
#: what is not, unless all else on the page is next to nothing,
_STRONG = frozenset("login popup modal overlay sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager masthead".split())
#: and what hardly is, if they stand alone or among words of layout: a section on related work is one of the article.
_WEAK = frozenset("aside banner banners notice notices alert rail widget widgets related recommended share sharing social discussion foot toolbar tags skip".split())
_LAYOUT = frozenset(
    "area article articles bar block body bottom box button buttons col column container content entries footer grid group head header icons inner item items "
    "left link links list main module news outer page panel post posts primary read reading right row secondary section site stories story title to top wrap wrapper".split()
)
#: Before a mark they say that an element stands beside such a thing, or doesn't.
_BESIDE = frozenset("has have with no not without".split())
_HEAD_MARKS = frozenset("header topbar".split())
#: A strongly marked element is all there is if it holds so many times the points outside of it.
_ALONE = 10.0
_KEPT = frozenset("html body article main".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A start tag ends these open elements first (up to the nearest element that holds them).
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dd", "dt"), ("dl",)), "dd": (("dd", "dt"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select", "datalist")),
}
_SCOPES = ("table", "td", "th", "button", "object", "svg", "caption")
_ENDS_P = BLOCK - frozenset("html body head title option optgroup tr td th tbody thead tfoot legend".split())

#: Generations that a block passes points to: all of them to its own element and that one's parent, then shares.
_SHARES = (1.0, 1.0, 0.5, 1 / 3, 1 / 4)


#: What speaks against an element: nothing, a weak or a strong mark, or what cuts it at once.
_FINE, _MARKED, _BAD, _CUT = range(4)


def _marks(value: str, in_article: bool, only: frozenset[str] | None) -> int:
    """The strongest mark among a class's or id's names; only: the words that count."""
    found = _FINE
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if _BESIDE.intersection(words):
            continue
        counted = words if only is None else [w for w in words if w in only]
        if _NEVER.intersection(counted) or (not in_article and _HEAD_MARKS.intersection(counted)):
            return _CUT
        if _STRONG.intersection(counted):
            found = _BAD
        elif not found and _WEAK.intersection(counted) and all(w in _WEAK or w in _LAYOUT for w in words):
            found = _MARKED
    return found


def _against(name: str, attrs: str, in_article: bool) -> int:
    if name in DROPPED or (name == "header" and not in_article):
        return _CUT
    if not attrs or attrs.isspace():
        return _FINE
    found = _FINE
    for key, *values in _ATTR.findall(attrs):
        key, value = key.lower(), next((v for v in values if v), "")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return _CUT
        if name in _KEPT and not (name == "article" and key in ("class", "id")):
            continue
        if key == "role" and value.lower() in _ROLES:
            return _CUT
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return _CUT
        if key in ("class", "id"):
            found = max(found, _marks(value, in_article, _OF_ARTICLES if name == "article" else None))
    return found


#: Marks that count for an article element, which may be a comment or an advert.
_OF_ARTICLES = frozenset("comment comments ad advert sponsored promo related".split())


class _Page:
    """Elements in document order (so a subtree is a range) and the text blocks found in them."""

    def __init__(self) -> None:
        self.name, self.parent, self.last = ["#root"], [-1], [0]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self.marked: dict[int, int] = {}

    def parse(self, source: str) -> None:
        stack, dropped, links = [0], 0, 0
        opened: dict[str, list[int]] = {}  # places in the stack of each name's open elements
        shut_in: list[int] = []  # and of open blocks
        articles = 0
        text: list[str] = []
        linked = 0
        pos, end = 0, len(source)

        def flush() -> None:
            nonlocal linked
            if text:
                block = " ".join("".join(text).split())
                if block:
                    self.blocks.append((stack[-1], block, min(linked, len(block))))
                text.clear()
            linked = 0

        def add(raw: str) -> None:
            nonlocal linked
            if raw and not dropped:
                if "&" in raw:
                    raw = html.unescape(raw)
                text.append(raw)
                if links:
                    linked += len(raw)

        def pop() -> None:
            nonlocal links, articles, dropped
            node = stack.pop()
            name = self.name[node]
            opened[name].pop()
            if name in BLOCK:
                shut_in.pop()
            self.last[node] = len(self.name) - 1
            if name == "a":
                links -= 1
            elif name in ("article", "main"):
                articles -= 1
            if dropped and node == dropped:
                dropped = 0

        def nearest(names) -> int:  # noqa: ANN001
            """The place in the stack of the innermost open element of these names, or -1."""
            return max((opened[n][-1] for n in names if opened.get(n)), default=-1)

        def close(name: str) -> None:
            if opened.get(name):
                at = opened[name][-1]
                if shut_in and shut_in[-1] >= at:
                    flush()
                while len(stack) > at:
                    pop()

        sections = True
        while pos < end:
            found = _TAG.search(source, pos)
            if found is None:
                add(source[pos:])
                break
            if found.start() > pos:
                add(source[pos : found.start()])
            pos = found.end()
            cdata, slash, name, attrs, slash2, name2, attrs2 = found.groups()
            if cdata is not None:
                stop = source.find("]]>", pos) if sections else -1
                if stop >= 0:
                    add(source[pos:stop].replace("&", "&amp;"))
                    pos = stop + 3
                else:  # nor is there one for a later section: a declaration, up to the next >
                    sections = False
                    shut = source.find(">", pos)
                    pos = end if shut < 0 else shut + 1
                continue
            if name is None:
                slash, name, attrs = slash2, name2, attrs2
            if name is None:
                continue
            name = name.lower()
            if slash:
                # An inline end tag doesn't reach over the block it stands in.
                if name in BLOCK or (opened.get(name) and not (shut_in and shut_in[-1] > opened[name][-1])):
                    close(name)
                elif name == "br":
                    add(" ")
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                elif name == "br":
                    add(" ")
                continue
            if name in _RAW_END:  # its content is no markup
                stop = _RAW_END[name].search(source, pos)
                if stop is None:
                    pos = end
                else:
                    shut = source.find(">", stop.start())
                    pos = end if shut < 0 else shut + 1
                if name in BLOCK:
                    flush()
                continue
            if name in BLOCK:
                flush()
                # A table cell, list or other scope between keeps a paragraph open.
                if name in _ENDS_P and opened.get("p") and nearest(_SCOPES) < opened["p"][-1]:
                    close("p")
                if name in _ENDS:
                    ends, within = _ENDS[name]
                    at = nearest(ends)
                    if at > nearest(within):
                        close(self.name[stack[at]])
            if name in ("a", "article", "main"):
                if name == "a" and opened.get("a"):
                    close("a")
                links += name == "a"
                articles += name != "a"
            node = len(self.name)
            self.name.append(name)
            self.parent.append(stack[-1])
            self.last.append(node)
            opened.setdefault(name, []).append(len(stack))
            if name in BLOCK:
                shut_in.append(len(stack))
            stack.append(node)
            if not dropped and (against := _against(name, attrs, articles > 0)):
                if name in BLOCK and against < _CUT:
                    self.marked[node] = against
                    continue
                if name not in BLOCK and text:  # what stood before stays one block with what follows
                    add(" ")
                dropped = node
        flush()
        while len(stack) > 1:
            pop()
        self.last[0] = len(self.name) - 1


def _points(text: str, links: int) -> float:
    return (1.0 + text.count(",") + text.count("、") + text.count("，") + len(text) / 100.0) * (1.0 - links / len(text))


def _without_marked(page: _Page) -> None:
    """Cut marked elements, from the outside in, by what they hold of the points that are left."""
    n = len(page.name)
    held = [0.0] * n
    for node, text, links in page.blocks:
        held[node] += _points(text, links)
    for node in range(n - 1, 0, -1):
        held[page.parent[node]] += held[node]
    left, cut = held[0], [False] * n
    for node in range(1, n):
        cut[node] = cut[page.parent[node]]
        against = page.marked.get(node)
        if against and not cut[node]:
            alone = held[node] > _ALONE * (left - held[node]) if against == _BAD else 2 * held[node] >= left
            if not alone:
                cut[node], left = True, left - held[node]
    page.blocks = [b for b in page.blocks if not cut[b[0]]]


def extract_text(source: str | None) -> str:
    """The article's blocks joined by newlines; '' for null, empty or text-free pages."""
    if not source:
        return ""
    page = _Page()
    page.parse(source)
    if page.marked:
        _without_marked(page)
    if not page.blocks:
        return ""
    n = len(page.name)
    score, chars, linked = [0.0] * n, [0] * n, [0] * n
    for node, text, links in page.blocks:
        chars[node] += len(text)
        linked[node] += links
        points, up = _points(text, links), node
        for share in _SHARES:
            if up < 0:
                break
            score[up] += points * share
            up = page.parent[up]
    for node in range(n - 1, 0, -1):
        chars[page.parent[node]] += chars[node]
        linked[page.parent[node]] += linked[node]

    def value(node: int) -> float:
        return score[node] * (1.0 - linked[node] / chars[node]) if chars[node] else 0.0

    best = max(range(n), key=lambda k: (value(k), -k))
    # Sections of one article belong together: the article around the best container is the container.
    up = best
    while up >= 0 and page.name[up] not in ("article", "main"):
        up = page.parent[up]
    if up >= 0:
        best = up
    else:  # paragraphs side by side: their parent holds them
        while page.name[best] not in ("#root", "html", "body") and page.name[best] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "tr", "b", "i", "em", "strong", "span", "a", "font"):
            best = page.parent[best]
    kept = [(best, page.last[best])]
    above = page.parent[best]
    if above >= 0:
        floor = max(10.0, 0.2 * value(best))
        child = above + 1
        while child <= page.last[above]:
            if child != best and chars[child]:
                dense = linked[child] / chars[child]
                if value(child) >= floor and dense < 0.5 or page.name[child] == "p" and chars[child] > 80 and dense < 0.25:
                    kept.append((child, page.last[child]))
            child = page.last[child] + 1
    kept.sort()
    out, k = [], 0
    for node, text, _ in page.blocks:
        while k < len(kept) and kept[k][1] < node:
            k += 1
        if k < len(kept) and kept[k][0] <= node:
            out.append(text)
    return "\n".join(out)


def _batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [extract_text(x) for x in batch.column("source").to_pylist()]
    return pa.record_batch([batch.column("row_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["row_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, row_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """Return one row per input row: row_id, url, text, n_chars.

    A null or empty page, and one without text outside of what is cut, give the text ''. Character references
    are decoded, white space inside a block becomes one space, blocks follow in page order, one newline between
    two. Null ids and urls pass through, repeated rows are repeated, other columns aren't read. No shuffle.
    """
    tune(pages.sparkSession)
    rows = pages.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(url).alias("url"), F.col(source).alias("source"))
    out = rows.mapInArrow(per_batch(_batch), "row_id bigint, url string, text string, n_chars bigint")
    return out.select(F.col("row_id").alias(row_id), "url", "text", "n_chars")
