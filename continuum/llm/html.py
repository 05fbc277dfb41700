"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into blocks of text, the stretches between block-level tags, each with its chain
of open elements. A linear classifier turns the chain (element names, roles, words of ``class``
and ``id``), the share of linked characters and the length into log-odds for content. Evidence
adds up without bound, so a cost saturates: ``MOST * tanh(odds / SCALE)``, which puts it on the
scale of the smoothness edges. Costs become capacities: from the source if content is likelier,
to the sink if boilerplate is. Neighbouring blocks, and the next blocks of one container, are
tied by smoothness edges that are stronger the closer they are in the tree. A minimum cut
separates content from boilerplate: a block of weak odds goes with its surroundings, and only
evidence that outweighs all its ties stands against them. Such blocks are decided first and
handed to their neighbours, which leaves the cut minimal; maximum flow decides the rest.

Reading never fails: unclosed, crossed and cut-off tags are repaired the way browsers do for the
common cases. What only fills in for a picture or a script is silent: it is read, but its text is
left out, until it ends or what holds it ends; drawings end at the next block. White space, no-break spaces included, becomes one space inside a block.

Defined results: null and empty pages, and pages without content, give an empty text; equal rows
are extracted each; an empty table gives no rows; null ids and addresses pass through; other
columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)"
    r"|</[^>]*(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"(?i)\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none|visibility\s*:\s*hidden")

# HTML element kinds.
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details",
    "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main",
    "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "select", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
}
CLOSES_P = BLOCK - {"button", "caption", "head", "html", "body", "legend", "option", "optgroup", "td", "th", "tr"}
#: An opening tag that ends an open one of the same kind, and the elements that shield it.
SAME = {
    "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
    "th": {"tr", "table"}, "option": {"select"}, "a": set(), "button": set(),
}
#: What is drawn or played, and stand-ins for it; their text is not shown.
SILENT = {"template", "svg", "canvas", "object", "audio", "video", "noscript", "datalist"}
#: Drawings and formulas, which have no blocks inside, and may end in their opening tag.
FOREIGN = {"svg", "math"}

# Weights of the classifier, as log-odds for content.
BIAS = -0.5
ELEMENT = {
    "article": 3.0, "main": 3.0, "p": 1.0, "blockquote": 0.5, "pre": 0.5, "h1": 0.5, "h2": 0.5, "h3": 0.5,
    "nav": -12.0, "footer": -12.0, "aside": -12.0, "form": -12.0, "menu": -12.0, "dialog": -12.0, "button": -12.0,
    "select": -12.0, "fieldset": -12.0, "label": -12.0,
}
ROLE = {
    "main": 3.0, "article": 3.0, "navigation": -12.0, "banner": -12.0, "contentinfo": -12.0, "complementary": -12.0,
    "search": -12.0, "form": -12.0, "dialog": -12.0, "alert": -12.0, "alertdialog": -12.0, "menu": -12.0, "menubar": -12.0,
    "status": -12.0, "toolbar": -12.0, "tooltip": -12.0, "note": -2.0,
}
GOOD_WORDS = {"article", "articlebody", "body", "content", "entry", "main", "maincontent", "post", "story", "text"}
BAD_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb",
    "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "copyright", "disclaimer",
    "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "overlay", "pager", "pagination", "paywall", "popup", "promo", "promotion", "recommended", "related",
    "replies", "reply", "respond", "rail", "search", "share", "sharing", "sidebar", "signup", "skip", "social",
    "sponsor", "sponsored", "subscribe", "subscription", "tags", "toc", "toolbar", "topbar", "widget", "widgets",
}
GOOD_WORD, BAD_WORD, SITE_HEADER, HIDDEN = 1.5, -12.0, -12.0, -16.0
LINKED = -4.0
PER_100_CHARS, MOST_FOR_LENGTH = 0.5, 2.0
# The largest cost of a block, and the odds at which it bends.
MOST, SCALE = 2.0, 4.0
# Smoothness by relation. Siblings are of one element and one container; a block between
# two of them is tied by 1.6 in all.
NEXT, SIBLING, CONTAINER = 0.3, 0.5, 0.3


class Element:
    __slots__ = ("name", "odds", "linked", "inside", "silent", "number")

    def __init__(self, name: str, odds: float, linked: bool, inside: bool, silent: bool, number: int):
        self.name, self.odds, self.linked, self.inside = name, odds, linked, inside
        self.silent, self.number = silent, number


def _own_odds(name: str, attributes: str, inside: bool) -> float:
    odds = ELEMENT.get(name, 0.0)
    if name == "header" and not inside:
        odds += SITE_HEADER
    if attributes:
        tokens = []
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values).lower()
            if key == "role":
                odds += ROLE.get(value.strip(), 0.0)
            elif key in ("class", "id"):
                tokens += _WORD.findall(value)
            elif key == "aria-hidden" and value == "true":
                odds += HIDDEN
        if name not in ("body", "html"):
            good = any(t in GOOD_WORDS for t in tokens)
            odds += GOOD_WORD * good
            if any(t in BAD_WORDS for t in tokens) or ("header" in tokens and not good and not inside):
                odds += BAD_WORD
        if "hidden" in attributes.lower() or "none" in attributes:
            odds += HIDDEN * bool(_HIDDEN.search(re.sub(r"aria-hidden", "", attributes)))
    return odds


class Block:
    __slots__ = ("text", "odds", "kind", "parent", "holder")

    def __init__(self, text: str, odds: float, kind: str, parent: int, holder: int):
        self.text, self.odds, self.kind, self.parent, self.holder = text, odds, kind, parent, holder


def blocks(page: str) -> list[Block]:
    """The blocks of text of a page, in order, with their log-odds for content."""
    found: list[Block] = []
    stack = [Element("#page", BIAS, False, False, False, 0)]
    parts: list[str] = []
    linked = 0
    numbers = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            at = max((i for i, e in enumerate(stack) if e.name in BLOCK), default=0)
            odds = stack[-1].odds + LINKED * min(1.0, linked / len(text))
            odds += min(MOST_FOR_LENGTH, PER_100_CHARS * len(text) / 100)
            found.append(Block(text, odds, stack[at].name, stack[max(at - 1, 0)].number, stack[max(at - 2, 0)].number))
        parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not stack[-1].silent:
            parts.append(text)
            if stack[-1].linked:
                linked += len(text.strip())

    def close(name: str, shields=frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name == name:
                if any(e.name in BLOCK for e in stack[i:]):
                    flush()
                del stack[i:]
                return
            if stack[i].name in shields:
                return

    at = 0
    while match := _TAG.search(page, at):
        say(page[at : match.start()])
        at = match.end()
        name = (match[2] or match[5] or "").lower()
        if not name:
            continue
        if match[1] or match[4]:
            if name == "p" and not any(e.name == "p" for e in stack):
                flush()
            close(name)
            continue
        attributes = match[3] or match[6] or ""
        if name in RAW:  # a slash does not end these, and without an end tag they hold what follows
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in FOREIGN and attributes.endswith("/"):
            continue
        if name in BLOCK:
            for foreign in FOREIGN:
                if any(e.name == foreign for e in stack):
                    close(foreign)
        if name in CLOSES_P:
            close("p", {"table", "td", "th", "button", "article", "section", "div"} - {name} | {"caption"})
        if name in SAME:
            close(name, SAME[name])
            if name in ("dt", "dd", "td", "th"):
                close({"dt": "dd", "dd": "dt", "td": "th", "th": "td"}[name], SAME[name])
        if name in BLOCK:
            flush()
        elif name == "br":
            say(" ")
        if name in VOID:
            continue
        top = stack[-1]
        numbers += 1
        inside = top.inside or name in ("article", "main")
        odds = top.odds + _own_odds(name, attributes, top.inside)
        silent = top.silent or name in SILENT
        stack.append(Element(name, odds, top.linked or name == "a", inside, silent, numbers))
    say(page[at:])
    flush()
    return found


def edges(found: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness between blocks by their places in the tree."""
    result: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, block in enumerate(found):
        if i:
            before = found[i - 1]
            alike = block.parent == before.parent and block.kind == before.kind
            weight = NEXT + SIBLING * alike
            result[i - 1, i] = weight
        for holder in {block.parent, block.holder}:
            if holder in last and last[holder] != i - 1:
                key = (last[holder], i)
                result[key] = result.get(key, 0.0) + CONTAINER
            last[holder] = i
    return result


def cut(odds: list[float], ties: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut; ties go to the sink."""
    z = list(odds)
    near: list[dict[int, float]] = [{} for _ in z]
    for (i, j), weight in ties.items():
        near[i][j] = near[j][i] = near[i].get(j, 0.0) + weight
    label: list[bool | None] = [None] * len(z)
    for i in [i for i, own in enumerate(z) if abs(own) > sum(near[i].values())]:
        label[i] = z[i] > 0
    for i, side in enumerate(label):
        if side is not None:
            for j, weight in near[i].items():
                z[j] += weight if side else -weight
                near[j].pop(i)
            near[i] = {}
    rest = [i for i, done in enumerate(label) if done is None]
    for i, side in zip(rest, _max_flow(rest, z, near), strict=True):
        label[i] = side
    return [bool(x) for x in label]


def _max_flow(nodes: list[int], z: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Shortest augmenting paths; returns which nodes the source still reaches."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {source: {}, sink: {}}
    for i in nodes:
        room[i] = dict(near[i])
        room[source][i], room[i][source] = max(z[i], 0.0), 0.0
        room[i][sink], room[sink][i] = max(-z[i], 0.0), 0.0
    while True:
        came = {source: source}
        queue = deque([source])
        while queue and sink not in came:
            i = queue.popleft()
            for j, space in room[i].items():
                if space > 1e-9 and j not in came:
                    came[j] = i
                    queue.append(j)
        if sink not in came:
            return [i in came for i in nodes]
        path = [sink]
        while path[-1] != source:
            path.append(came[path[-1]])
        steps = list(zip(path[1:], path, strict=False))
        least = min(room[i][j] for i, j in steps)
        for i, j in steps:
            room[i][j] -= least
            room[j][i] = room[j].get(i, 0.0) + least


def costs(found: list[Block]) -> list[float]:
    """What it costs to call each block boilerplate (above 0) or content (below)."""
    return [MOST * math.tanh(b.odds / SCALE) for b in found]


def main_text(page: str) -> str:
    found = blocks(page)
    keep = cut(costs(found), edges(found))
    return "\n".join(b.text for b, kept in zip(found, keep, strict=True) if kept)


def _extract(batches):
    for batch in batches:
        text = [main_text(page) for page in batch["html"]]
        yield pd.DataFrame({"key": batch["key"], "url": batch["url"], "text": text, "n_chars": [len(t) for t in text]})


def texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row."""
    # Ids travel as text: in pandas, a null beside them would turn large numbers into floats.
    rows = pages.select(
        F.col("page_id").cast("string").alias("key"), "url", F.coalesce("html", F.lit("")).alias("html")
    )
    made = rows.mapInPandas(_extract, "key string, url string, text string, n_chars long")
    page_id = F.col("key").cast(pages.schema["page_id"].dataType).alias("page_id")
    return made.select(page_id, "url", "text", "n_chars")
