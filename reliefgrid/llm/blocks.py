"""Splitting HTML into text blocks, shared by the extraction of main text and of plain text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

#: Elements that begin and end a block of text. Fixed values of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is never text of the page.
HIDDEN_TAGS = frozenset("script style noscript template textarea iframe object svg math title canvas audio video datalist".split())
#: Elements without content.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass
class Block:
    """A run of text between block borders: its text, the part inside links, and the elements around it, with their numbers."""

    text: str
    link_chars: int
    tag: str
    path: tuple[tuple[str, str], ...]
    nodes: tuple[int, ...] = ()


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def elements(page: str, name: str) -> Iterator[str]:
    """The attributes of each element of that name, as they stand; none inside comments, scripts and the like."""
    at = 0
    while (m := _TOKEN.search(page, at)) is not None:
        at = m.end()
        if m[2] is None or m[1]:
            continue
        tag = m[2].lower()
        if tag == name:
            yield m[3]
        elif tag in HIDDEN_TAGS and not m[3].rstrip().endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else (len(page) if tag in ("script", "style") else at)


def blocks(page: str, named: bool = True) -> list[Block]:
    """The blocks of a page in order; character references decoded, white space inside a block made one space.

    Without ``named`` classes, ids and roles are left empty.
    """
    out: list[Block] = []
    stack: list[tuple[str, str]] = []  # (tag, class, id and role) of open elements other than inline ones
    numbers: list[int] = []  # of the same elements
    opened = 0
    parts: list[str] = []
    linked: list[str] = []
    links, at, end = 0, 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                path = tuple(stack)
                out.append(Block(text, len(" ".join(html.unescape("".join(linked)).split())) if linked else 0, path[-1][0] if path else "", path, tuple(numbers)))
            parts.clear()
            linked.clear()

    def say(text: str) -> None:
        parts.append(text)
        if links:
            linked.append(text)

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                say(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in HIDDEN_TAGS and not closing:
            if not m[3].rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = close.end() if close else (end if tag in ("script", "style") else at)
            continue
        if tag == "br":
            say(" ")
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in BLOCK_TAGS:
            flush()
            if tag in VOID_TAGS:
                continue
            if closing:
                if stack and stack[-1][0] == tag:
                    stack.pop()
                    del numbers[len(stack) :]
                elif any(t == tag for t, _ in stack):
                    while stack.pop()[0] != tag:
                        pass
                    del numbers[len(stack) :]
                links = 0
            else:
                if tag in ("p", "li", "option", "tr", "td", "th", "dt", "dd") and stack and stack[-1][0] == tag:
                    stack.pop()  # these end where the next one begins
                elif stack and stack[-1][0] == "p":
                    stack.pop()
                del numbers[len(stack) :]
                opened += 1
                numbers.append(opened)
                a = attributes(m[3]) if named and m[3].strip() else {}
                stack.append((tag, " ".join(a.get(k, "") for k in ("class", "id", "role")).lower()))
    flush()
    return out
