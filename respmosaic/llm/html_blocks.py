"""Leaf blocks of a web page: the text between block-level tags, with the tags that hold it."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+"""
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+(?:>|\Z)|</>|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'/])(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose content is not markup; it is no text of the page either.
_RAW = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)", re.I) for n in ("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp")}
#: Elements that end a block and are part of its path.
_BLOCKS = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup
 html label legend li main menu nav noscript ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul""".split()
)
_BREAKS = frozenset(("hr",))
#: An opening tag ends these elements, unless one of the bounds is met first.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}),
}
#: Elements of a path, the nearest ones.
PATH = 12
#: Ancestors looked at for a tag's end by another tag, names of an element, and their length.
_LOOK, _NAMES, _LENGTH = 16, 8, 24


class Block(NamedTuple):
    """White space is one space; ``path`` holds ``(tag, names)`` of the nearest elements from the outermost in; ``linked`` characters stand in links."""

    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]
    linked: int


def names(attributes: str) -> tuple[str, ...]:
    """Lower-case words of an element's class, id, role and itemprop."""
    if "=" not in attributes:
        return ()
    words = (w.lower() for m in _NAMED.finditer(attributes) for w in _WORD.findall(next(g for g in (*m.groups(), "") if g is not None)))
    return tuple(dict.fromkeys(w[:_LENGTH] for w in words if len(w) > 1))[:_NAMES]


def blocks(html: str | None) -> list[Block]:
    """Blocks in page order; markup, comments, scripts, styles and the title leave none. Broken markup is read as browsers do, in outline."""
    out: list[Block] = []
    if not html:
        return out
    stack: list[tuple[str, tuple[str, ...]]] = []
    open_: dict[str, int] = {}
    pieces: list[tuple[str, bool]] = []
    link, at = False, 0

    def flush():
        if pieces:
            text = " ".join("".join(p for p, _ in pieces).split())
            if text:
                out.append(Block(text, tuple(stack[-PATH:]), sum(len(p.strip()) for p, linked in pieces if linked)))
            pieces.clear()

    def close(depth: int):
        while len(stack) > depth:
            open_[stack.pop()[0]] -= 1

    while True:
        m = _TOKEN.search(html, at)
        piece = html[at : m.start() if m else len(html)]
        if piece:
            pieces.append((unescape(piece) if "&" in piece else piece, link))
        if m is None:
            break
        at = m.end()
        if m.group(2) is None:
            continue
        ending, tag = m.group(1) == "/", m.group(2).lower()
        if tag in _RAW and not ending:
            end = _RAW[tag].search(html, at)
            at = end.start() if end else len(html)
        elif tag in _BLOCKS:
            flush()
            link = False
            if ending:
                if open_.get(tag):
                    depth = len(stack) - 1
                    while stack[depth][0] != tag:
                        depth -= 1
                    close(depth)
                continue
            if open_.get("p") and stack[-1][0] == "p":
                close(len(stack) - 1)
            if tag in _ENDS:
                ended, bounds = _ENDS[tag]
                for depth in range(len(stack) - 1, max(-1, len(stack) - 1 - _LOOK), -1):
                    if stack[depth][0] in bounds:
                        break
                    if stack[depth][0] in ended:
                        close(depth)
                        break
            stack.append((tag, () if tag in ("html", "body") else names(m.group(3))))
            open_[tag] = open_.get(tag, 0) + 1
        elif tag in _BREAKS:
            flush()
        elif tag == "a":
            link = not ending
        elif tag == "br":
            pieces.append((" ", link))
    flush()
    return out
