"""HTML cut into leaf blocks: runs of text between block-level tags, each with its path of open tags."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

#: Elements whose start or end ends a block (fixed values, from the HTML standard's flow content and table parts).
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre section select "
    "summary table tbody td textarea tfoot th thead title tr ul video audio canvas label".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Whose text is not content: skipped to their end tag or, as browsers do, to the end of the page. A "/>" closes them in
#: drawings and formulas only.
RAW_TAGS = "script|style|noscript|template|iframe|textarea|title"
#: Parts of drawings and formulas that stand apart, though they are not blocks.
_APART = frozenset("br svg g text tspan math mtr mtd object".split())

# Attributes as the HTML standard reads them: a quote opens a value only after "=", and nowhere else. A quote that is never
# closed, and a tag that is never, end nothing early: the former is a character, the latter runs to the end of the page.
# Every branch consumes what it has looked at, but for the last quote of either kind, so time is linear.
_ATTRIBUTES = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+(?:>|\Z)"
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<({RAW_TAGS})(?=[\s/>])({_ATTRIBUTES})"
    rf"|<(/?)([a-z][^\s/>]*+)({_ATTRIBUTES})|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for t in RAW_TAGS.split("|")}
_HINT = re.compile(r"""\b(class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+", re.I)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _hints(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found = [w.lower() for m in _HINT.finditer(attributes) for w in _NAME.findall(m[2] or m[3] or m[4] or "")]
    if re.search(r"\bhidden\b|display\s*:\s*none", attributes, re.I):
        found.append("hidden")
    return tuple(found)


class Path:
    """An open element, (tag, words of class, id, role ...), and the path of those around it; iterated outermost first. Blocks
    share the paths of their elements, so a page's paths take room in proportion to its elements, however deep."""

    __slots__ = ("element", "outer", "marks")

    def __init__(self, element: tuple[str, ...], outer: Path | None):
        self.element, self.outer, self.marks = element, outer, None

    def __iter__(self):
        held, at = [], self
        while at is not None:
            held.append(at.element)
            at = at.outer
        return reversed(held)


def leaf_blocks(html: str | None) -> list[tuple[Path | tuple, str, float]]:
    """(path, text, share of its characters in links) of each block with text, in page order; an empty path is ().

    A path holds each open block-level element. Character
    references are decoded; white space within a block is one space. Unclosed and stray tags are read as browsers mostly
    do: an end tag closes up to its start if that is open; a block start closes an open paragraph."""
    html = html or ""
    open_: list[Path] = []
    count: Counter[str] = Counter()  # open elements by tag: an end tag without a start looks at none of them
    blocks, parts, linked, in_link = [], [], 0, 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                blocks.append((open_[-1] if open_ else (), text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def close(low: int):
        for p in open_[low:]:
            count[p.element[0]] -= 1
        del open_[low:]

    at = foreign = 0
    while (m := _TOKEN.search(html, at)) is not None:
        low = m.start()
        if low > at:
            parts.append(html[at:low])
            if in_link:
                linked += low - at
        at = m.end()
        tag = m[4]
        if tag is None:
            if m[1]:
                parts.append(" ")
                if not (foreign and m[2].endswith("/>")):
                    last = _RAW_END[m[1].lower()].search(html, at)
                    at = last.end() if last else len(html)
            continue
        tag, end = tag.lower(), m[3]
        if tag in ("svg", "math"):
            foreign = max(0, foreign - 1) if end else foreign + (not m[5].endswith("/>"))
        elif tag in BLOCK_TAGS:
            foreign = 0
        if tag == "a":
            in_link = 0 if end else 1
        elif tag in _APART:
            parts.append(" ")
        elif tag in BLOCK_TAGS:
            flush()
            in_link = 0 if tag not in ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6") else in_link
            if end:
                if count[tag]:
                    close(next(i for i in range(len(open_) - 1, -1, -1) if open_[i].element[0] == tag))
            elif tag not in VOID_TAGS:
                if open_ and open_[-1].element[0] == "p":
                    close(len(open_) - 1)
                if tag in _CLOSES and open_ and open_[-1].element[0] in _CLOSES[tag]:
                    close(len(open_) - 1)
                open_.append(Path((tag, *_hints(m[5])), open_[-1] if open_ else None))
                count[tag] += 1
    if at < len(html):
        parts.append(html[at:])
    flush()
    return blocks
