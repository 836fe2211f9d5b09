"""HTML as a sequence of leaf blocks with their tag paths, and the blocks' feature vectors."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np

#: Elements inside a line of text; all others end a block.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track".split())
#: Their content is no text of the page.
RAW = frozenset("script style noscript template iframe svg textarea object".split())
#: An open element of these ends when one of its followers starts.
CLOSED_BY = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
# a quote opens a value only behind an equals sign
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>|<[!?/][^>]*>|<[!?/a-zA-Z][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_TOKEN = re.compile(r"[a-z]+")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
_MAIN = {"article", "main"}
_ASIDE = set("nav header footer aside form .ad .ads .advert .banner .sponsored .promo .sidebar .menu .navigation .comment .comments .commentlist .cookie .notice .newsletter .related .share".split())
PATH_SIZE, WORD_SIZE = 128, 128
_NUMBERS = 10
SIZE = 2 * PATH_SIZE + WORD_SIZE + _NUMBERS
_buckets: dict[tuple[str, int], int] = {}


def _bucket(name: str, size: int) -> int:
    found = _buckets.get((name, size))
    if found is None:
        if len(_buckets) > 200_000:
            _buckets.clear()
        found = _buckets[name, size] = zlib.crc32(f"{size}{name}".encode()) % size
    return found


class _Element:
    """An open element: what its path has, taken over from its parent, so a block's path costs nothing."""

    __slots__ = ("name", "path", "own", "inside", "aside", "depth")

    def __init__(self, name: str, names: list[str], parent: _Element | None):
        self.name = name
        self.own = 0
        for x in names:
            self.own |= 1 << _bucket(x, PATH_SIZE)
        self.path = self.own | (parent.path if parent else 0)
        self.inside = (parent is not None and parent.inside) or name in _MAIN
        self.aside = (parent is not None and parent.aside) or not _ASIDE.isdisjoint(names)
        self.depth = parent.depth + 1 if parent else 1


_OUTSIDE = _Element("", [], None)


@dataclass
class Block:
    text: str
    #: The element that the text is in.
    element: _Element
    #: Characters of it inside links.
    linked: int
    #: Where its source ends in the page.
    at: int


def _names(tag: str, attributes: str) -> list[str]:
    names = [tag]
    if attributes:
        for key, *values in _ATTRIBUTE.findall(attributes):
            if key.lower() in ("class", "id", "role"):
                names += [f".{x}" for x in _TOKEN.findall("".join(values).lower())]
    return names


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order: character references decoded, white space single, not blank.

    Tags cut off at the end of the page are no text. The cost is in proportion to the page's
    length, however deep its elements are nested.
    """
    out: list[Block] = []
    stack: list[_Element] = []
    opened: Counter[str] = Counter()
    text: list[str] = []
    links, linked, end = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        own = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if own:
            out.append(Block(own, stack[-1] if stack else _OUTSIDE, min(linked, len(own)), end))
        linked = 0

    at = 0
    while at < len(page):
        found = _TAG.search(page, at)
        part = page[at : found.start()] if found else page[at:]
        text.append(part)
        end = found.start() if found else len(page)
        if links:
            linked += len(part)
        if not found:
            break
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if name in RAW and not found[1]:
            stop = _RAW_END[name].search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if name in INLINE:
            if name == "a":
                links = 0 if found[1] else 1
            continue
        flush()
        links = 0
        if found[1]:
            if opened[name]:
                while True:
                    last = stack.pop()
                    opened[last.name] -= 1
                    if last.name == name:
                        break
            continue
        while name != "br" and stack and stack[-1].name in CLOSED_BY and (CLOSED_BY[stack[-1].name] is None or name in CLOSED_BY[stack[-1].name]):
            opened[stack.pop().name] -= 1
        if name not in EMPTY:
            stack.append(_Element(name, _names(name, found[3]), stack[-1] if stack else None))
            opened[name] += 1
    flush()
    return out


def features(page: list[Block]) -> np.ndarray:
    """A row for each block: hashed tag path and innermost element, hashed words, and numbers of its shape."""
    out = np.zeros((len(page), SIZE), np.float32)
    masks = b"".join(b.element.path.to_bytes(PATH_SIZE // 8, "little") + b.element.own.to_bytes(PATH_SIZE // 8, "little") for b in page)
    out[:, : 2 * PATH_SIZE] = np.unpackbits(np.frombuffer(masks, np.uint8).reshape(len(page), -1), axis=1, bitorder="little")
    before: _Element | None = None
    for i, (row, b) in enumerate(zip(out, page)):
        words = b.text.lower().split()
        counts = np.bincount([_bucket(w, WORD_SIZE) for w in words], minlength=WORD_SIZE)
        row[2 * PATH_SIZE : 2 * PATH_SIZE + WORD_SIZE] = counts / np.sqrt(1 + (counts * counts).sum())
        row[-_NUMBERS:] = (
            np.log1p(len(b.text)) / 8, np.log1p(len(words)) / 6, b.linked / len(b.text), 1, b.text[-1] in ".!?:;\"'”’…", b.text.count(",") > 0,
            i / len(page), min(b.element.depth, 20) / 20, b.element is before, any(c.isdigit() for c in b.text),
        )
        before = b.element
    return out
