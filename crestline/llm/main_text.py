"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of text. Lines of menus, headers, footers, sidebars, notices, adverts,
forms and reader comments, which markup names, are masked: they are no lines at all. A line's length counts its
characters outside links, and is zero where most of it is links; a line of an article or main element counts BONUS more,
so that three short ones in a row still count as text. Lengths are summed over windows of WINDOW lines. Where the sum
surges to THRESHOLD a block begins, where it dives below one ends; blocks begin and end with a line of some length. The
text is that of the longest block, of all others of the same article element however short they are, and of those that
have at least SHARE of its length, on every page alike.

Defined results: a null or empty page has an empty text; unclosed and truncated markup is read as far as it goes, and a
tag without its bracket ends before the next one; masks of elements that are never closed are lifted where they leave no
text at all; a page
without a window of that length gives its densest one; of equal blocks all stay; a page of any length is read whole, in
time that grows with its length; rows that repeat are extracted each on its own; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, THRESHOLD, BONUS, SHARE = 3, 40, 14, 0.2

#: Each alternative takes what it has read, so that no character is read twice.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']|"[^"]*"|'[^']*'|["'])*+)>?""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_NAME = re.compile(r"[a-z]+")

RAW = {"script", "style", "title", "textarea", "noscript", "template", "svg", "math", "iframe", "object", "select", "button", "canvas", "video", "audio"}
VOID = {"br", "hr", "img", "input", "meta", "link", "source", "col", "area", "base", "embed", "param", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: Elements that may end without a tag of their own.
OPTIONAL = {"p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "option", "optgroup", "caption", "colgroup", "rp", "rt"}
LEFT_OUT = {"nav", "footer", "aside", "form", "menu", "dialog", "head"}
#: Words of class, id and role names that mark blocks outside the article; a name counts by its whole words.
NAMED = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adslot", "adbox", "banner", "promo", "promotion", "sponsor", "sponsored", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer",
    "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "discussion", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup",
    "login", "share", "sharing", "social", "related", "recommended", "recommendations", "pagination", "pager", "toolbar", "widget", "contentinfo", "complementary", "search", "form", "dialog", "masthead", "skip", "disclaimer", "paywall",
}
NOT_A_MARK = {"with", "has", "no", "without", "content"}


def _is_left_out(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in LEFT_OUT:
        return True
    if tag == "header" and not in_article:
        return True
    if not attributes or tag in ("body", "html", "main"):
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "role"):
            for name in value.split():
                words = set(_NAME.findall(name))
                if words & NAMED and not words & NOT_A_MARK or "header" in words and not in_article and not words & NOT_A_MARK:
                    return True
        elif key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)))


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """Text, length outside links, and number of its article (0: none), for each block that is not left out."""
    lines: list[tuple[str, int, int, int]] = []  # the last one: the innermost mask
    parts: list[str] = []
    stack: list[tuple[str, int, int]] = []  # tag, innermost mask, innermost article
    opened: dict[str, int] = {}  # how often a tag stands on the stack
    outer, closed = [0], [False]  # of each mask: the one around it, and whether it ends
    links, linked, at, articles = 0, 0, 0, 0

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            free = max(0, len(text) - linked)
            lines.append((text, free if 2 * free >= len(text) else 0, *((stack[-1][2], stack[-1][1]) if stack else (0, 0))))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html_lib.unescape(raw)
            parts.append(text)
            linked += len(text) if links else 0

    def leave() -> str:
        """Take the last element off the stack; a mask of its own ends where it had or needed no end tag."""
        gone, mask, _ = stack.pop()
        opened[gone] -= 1
        if mask != (stack[-1][1] if stack else 0):
            closed[mask] = gone == ending or gone in OPTIONAL
        return gone

    ending = ""
    while True:
        m = _TOKEN.search(page, at)
        add(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag not in INLINE:
                close()
            ending = tag
            if opened.get(tag):
                while leave() != tag:
                    pass
        elif tag in RAW:
            if tag not in INLINE:
                close()
            end = re.compile(rf"</{re.escape(tag)}\b[^<>]*+>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag in VOID:
            parts.append(" " if tag in ("br", "hr") else "")
        else:
            if tag not in INLINE:
                close()
            mask, article = (stack[-1][1], stack[-1][2]) if stack else (0, 0)
            if tag == "a":
                links += 1
            if tag == "p" and stack and stack[-1][0] == "p":
                leave()
            opened[tag] = opened.get(tag, 0) + 1
            if tag not in INLINE and _is_left_out(tag, m[3], article > 0):
                outer.append(mask)
                closed.append(False)
                mask = len(outer) - 1
            if tag in ("article", "main"):
                articles += 1
                article = articles
            stack.append((tag, mask, article))
    close()
    kept = [(t, n, a) for t, n, a, m in lines if not m]
    if not kept and lines:
        for m in range(1, len(outer)):  # a mask that ends masks all that it holds
            closed[m] = closed[m] or closed[outer[m]]
        kept = [(t, n, a) for t, n, a, m in lines if not closed[m]]
    return kept


def blocks_of(lines: list[tuple[str, int, int]], window: int = WINDOW, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """First line and end of each block of the main text, in order."""
    if not lines:
        return []
    weight = np.array([n + BONUS * (a > 0) if n else 0 for _, n, a in lines])
    total = np.concatenate([[0], np.cumsum(weight)])
    # sums of the windows that begin at each line, shorter ones at the end; a line is dense if one that has it is
    begin = np.arange(max(1, len(lines) - window + 1))
    sums = total[np.minimum(begin + window, len(lines))] - total[begin]
    least = min(threshold, int(sums.max()))
    if least == 0:
        return []
    edges = np.zeros(len(lines) + 1, dtype=np.int64)
    np.add.at(edges, begin[sums >= least], 1)
    np.add.at(edges, np.minimum(begin[sums >= least] + window, len(lines)), -1)
    dense = np.concatenate([[False], np.cumsum(edges)[:-1] > 0, [False]])
    found = []
    for surge, dive in zip(np.flatnonzero(dense[1:] & ~dense[:-1]).tolist(), np.flatnonzero(dense[:-1] & ~dense[1:]).tolist(), strict=True):
        held = np.flatnonzero(weight[surge:dive])
        found.append((surge + int(held[0]), surge + int(held[-1]) + 1))
    longest = max(found, key=lambda f: (total[f[1]] - total[f[0]], -f[0]))
    article = np.array([a for _, _, a in lines])
    weights = np.bincount(article[slice(*longest)], weight[slice(*longest)])
    story = int(weights.argmax())
    same = lambda a, b: story > 0 and bool((article[a:b] == story).any())
    return [(a, b) for a, b in found if same(a, b) or total[b] - total[a] >= SHARE * (total[longest[1]] - total[longest[0]])]


def main_text(page: str) -> tuple[str, int, int, int]:
    """The main text, its number of lines, its first surge and last dive."""
    lines = lines_of(page)
    blocks = blocks_of(lines)
    kept = [t for a, b in blocks for t, _, _ in lines[a:b]]
    return " ".join(kept), len(kept), blocks[0][0] if blocks else 0, blocks[-1][1] if blocks else 0


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_lines, surge, dive of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(p or "") for p in batch.column(2).to_pylist()]
            cols = list(zip(*found, strict=True)) or [()] * 4
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["page_id", "url", "text", "n_lines", "surge", "dive"])

    wanted = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return wanted.mapInArrow(run, "page_id long, url string, text string, n_lines int, surge int, dive int")
