"""Leaf blocks of a web page: runs of text between block-level tags, with the path of elements around them.

Tags inside a line (links, bold text and the like) do not end a block, and a line break is white space. Scripts, styles, titles,
templates, comments and other elements without visible text give nothing. Markup may be broken: unclosed paragraphs and list items end where
the next one begins, closing tags without an opening one are passed over, and an unclosed comment or script takes the rest of the page.
Character references are decoded and white space becomes one space. All work is linear in the length of the page.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple
from zlib import crc32

PATH_SLOTS = 16384
WORD_SLOTS = 4096

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[/!?a-zA-Z][^>]*+\Z",
    re.S,
)
_NAMES = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"\w+|©")

# Kinds of elements, by the HTML standard.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q s samp small span strike strong sub sup"
    " time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("audio canvas iframe math noembed noframes noscript object script style svg template title video".split())
RAW = frozenset("iframe noembed noframes script style title".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr main menu nav ol p pre section table ul".split()
)
# An element that ends when one of the others begins, up to the elements that enclose both.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "option": (("option",), ("select",)),
}


class Block(NamedTuple):
    text: str
    path: frozenset[int]
    link_chars: int


_slots: dict[str, int] = {}


def path_slot(name: str) -> int:
    if name not in _slots:
        if len(_slots) > 100_000:
            _slots.clear()
        _slots[name] = crc32(name.encode()) % PATH_SLOTS
    return _slots[name]


def element_slots(tag: str, attributes: str) -> set[int]:
    """The places of an element's tag and of the words of its class, id and role."""
    made = {path_slot("<" + tag)}
    if attributes:
        for found in _NAMES.finditer(attributes):
            for part in _PART.findall(found[2] or found[3] or found[4] or ""):
                made.add(path_slot(part.lower()))
        if _HIDDEN.search(attributes):
            made.add(path_slot("<hidden>"))
    return made


def word_slots(text: str) -> list[int]:
    return [crc32(w.encode("utf-8", "surrogatepass")) % WORD_SLOTS for w in _WORD.findall(text.lower())]


class _Reader:
    def __init__(self) -> None:
        self.blocks: list[Block] = []
        # Tag and path of the open elements; links are counted apart.
        self.open: list[tuple[str, frozenset[int]]] = [("", frozenset())]
        self.count: Counter = Counter()
        self.links = 0
        self.pieces: list[str] = []
        self.linked = 0

    def text(self, raw: str) -> None:
        piece = unescape(raw) if "&" in raw else raw
        self.pieces.append(piece)
        if self.links:
            self.linked += len(piece.strip())

    def end_block(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                tag, path = self.open[-1]
                self.blocks.append(Block(text, path | {path_slot("leaf " + tag)}, min(self.linked, len(text))))
            self.pieces, self.linked = [], 0

    def pop(self, place: int) -> None:
        for tag, _ in self.open[place:]:
            self.count[tag] -= 1
        del self.open[place:]

    def close_siblings(self, tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        if not any(self.count[t] for t in tags):
            return
        last = None
        for place in range(len(self.open) - 1, 0, -1):
            tag = self.open[place][0]
            if tag in scope:
                break
            if tag in tags:
                last = place
        if last:
            self.pop(last)

    def start(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            self.links += tag == "a"
            return
        if tag == "br":
            self.pieces.append(" ")
            return
        self.end_block()
        # No block-level element can be inside a paragraph.
        if tag in CLOSES_P and self.open[-1][0] == "p":
            self.pop(len(self.open) - 1)
        if tag in SIBLINGS:
            self.close_siblings(*SIBLINGS[tag])
        if tag not in VOID:
            self.open.append((tag, self.open[-1][1] | element_slots(tag, attributes)))
            self.count[tag] += 1

    def end(self, tag: str) -> None:
        if tag in INLINE:
            self.links = max(0, self.links - (tag == "a"))
            return
        self.end_block()
        if self.count[tag]:
            place = len(self.open) - 1
            while self.open[place][0] != tag:
                place -= 1
            self.pop(place)
        self.links = 0


def blocks_of(html: str) -> list[Block]:
    reader = _Reader()
    at, unseen, depth = 0, "", 0
    position = 0
    while found := _TAG.search(html, position):
        if found.start() > at and not unseen:
            reader.text(html[at : found.start()])
        at = position = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        closing = bool(found[1] or found[4])
        attributes = found[3] or found[6] or ""
        if unseen:
            if tag == unseen and not attributes.endswith("/"):
                depth += -1 if closing else 1
                unseen = unseen if depth else ""
        elif closing:
            reader.end(tag)
        elif tag in RAW:
            reader.end_block()
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I).search(html, at)
            at = position = end.end() if end else len(html)
        elif tag in UNSEEN:
            reader.end_block()
            if not attributes.endswith("/"):
                unseen, depth = tag, 1
        else:
            reader.start(tag, attributes)
    if at < len(html) and not unseen:
        reader.text(html[at:])
    reader.end_block()
    return reader.blocks
