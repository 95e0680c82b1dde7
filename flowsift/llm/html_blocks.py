"""Reading HTML into text blocks with their place in the document tree. Plain Python, used inside Arrow functions."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Elements whose content is characters, not markup, up to their end tag or the end of the page.
RAW = ("script", "style", "title", "textarea")
# Elements whose content is not text of the page, if their end tag is there; without one only the tag goes.
UNSHOWN = frozenset("noscript template svg iframe object canvas audio video".split())
# Elements with the syntax of XML inside: a start tag that ends in /> has no content.
FOREIGN = frozenset(("svg", "math"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul button".split())
# A start tag of the key closes open elements of the value, up to the nearest one of the last set.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "body": {"head"}}
SCOPE = frozenset(("ul", "ol", "dl", "table", "select", "menu"))
# Elements beyond which no start tag closes anything.
BOUNDS = SCOPE | {"div", "article", "section", "main", "body"}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
    re.S | re.I)
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Element:
    tag: str
    parent: int
    depth: int
    names: frozenset = frozenset()
    role: str = ""
    hidden: bool = False
    main_below: bool = False


@dataclass
class Block:
    element: int
    text: str
    link_chars: int
    heading: bool


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)

    def path(self, element: int) -> list[int]:
        out = []
        while element >= 0:
            out.append(element)
            element = self.elements[element].parent
        return out

    def distance(self, a: int, b: int) -> int:
        """Steps in the tree between two elements."""
        e, steps = self.elements, 0
        while a != b:
            if a >= 0 and (b < 0 or e[a].depth >= e[b].depth):
                a = e[a].parent
            else:
                b = e[b].parent
            steps += 1
        return steps


def _element(tag: str, attrs: str, parent: int, depth: int) -> Element:
    out = Element(tag, parent, depth)
    if attrs and len(attrs) > 2:
        names: set[str] = set()
        for m in ATTRIBUTE.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id", "itemprop"):
                names.update(p.lower() for p in NAME_PART.findall(value))
                names.update(w.lower() for w in value.split())
            elif key == "role":
                out.role = value.strip().lower()
            elif key == "hidden":
                out.hidden = True
            elif key == "aria-hidden":
                out.hidden = out.hidden or value.strip().lower() == "true"
            elif "none" in value and re.search(r"display\s*:\s*none", value, re.I) or re.search(r"visibility\s*:\s*hidden", value, re.I):
                out.hidden = True
        out.names = frozenset(names)
    return out


def _tokens(source: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, tag, closing, attributes) of all markup; the tag is empty where the whole token just goes.

    An unshown element is one token with its content if its end tag is there, whatever is nested in it. One that
    is never closed, or was closed by /> or by a block inside svg, is a start tag alone.
    """
    found: list[tuple[int, int, str, bool, str]] = []
    starts: dict[str, list[int]] = {tag: [] for tag in UNSHOWN}
    foreign = shown_inside = 0
    ends: dict[int, int] = {}  # unshown start token -> its end token
    place = 0
    while m := TOKEN.search(source, place):
        place = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        closing = bool(m["end"] or m["end2"])
        attrs = m["attrs"] or m["attrs2"] or ""
        empty = attrs.endswith("/")
        if tag in RAW_END:
            if not closing and not (foreign and empty):
                end = RAW_END[tag].search(source, place)
                place = end.end() if end else len(source)
            found.append((m.start(), place, "", False, ""))
            continue
        if tag in FOREIGN:
            foreign = max(0, foreign + (-1 if closing else 0 if empty else 1))
            shown_inside = shown_inside if foreign else 0
        elif tag == "foreignobject":
            shown_inside = max(0, shown_inside + (-1 if closing else 0 if empty else 1))
        elif foreign and not shown_inside and not closing and tag in BLOCK:
            foreign = 0
            starts["svg"].clear()
        if tag in UNSHOWN:
            if not closing:
                if not (tag in FOREIGN and empty):
                    starts[tag].append(len(found))
            elif starts[tag]:
                ends[starts[tag].pop()] = len(found)
        found.append((m.start(), place, tag, closing, attrs))
    if not ends:
        return found
    out = []
    k = 0
    while k < len(found):
        if k in ends:
            out.append((found[k][0], found[ends[k]][1], "", False, ""))
            k = ends[k]
        else:
            out.append(found[k])
        k += 1
    return out


def read_page(source: str) -> Page:
    page = Page()
    elements, blocks = page.elements, page.blocks
    stack: list[int] = []  # open block-level elements
    opened: dict[str, list[int]] = {tag: [] for tag in BLOCK}  # their places in the stack by tag
    bounds: list[int] = []  # places of those in BOUNDS
    text: list[str] = []
    state = {"links": 0, "link_chars": 0}

    def flush() -> None:
        if text:
            plain = " ".join(html.unescape("".join(text)).split())
            if plain:
                at = stack[-1] if stack else -1
                heading = at >= 0 and elements[at].tag in HEADINGS
                blocks.append(Block(at, plain, state["link_chars"], heading))
            text.clear()
        state["link_chars"] = 0

    def put(run: str) -> None:
        text.append(run)
        if state["links"]:
            state["link_chars"] += len(run)

    def close(k: int) -> None:
        """End the open elements from place k on."""
        for e in stack[k:]:
            opened[elements[e].tag].pop()
            if elements[e].tag in BOUNDS:
                bounds.pop()
        del stack[k:]

    place = 0
    for start, end, tag, closing, attrs in _tokens(source):
        if start > place:
            put(source[place:start])
        place = end
        if not tag:
            continue
        if tag not in BLOCK:
            if tag == "br":
                put(" ")
            elif tag == "a":
                state["links"] = 0 if closing else 1
            continue
        flush()
        if closing:
            if opened[tag]:
                close(opened[tag][-1])
                state["links"] = 0
            continue
        # An open paragraph ends where another block starts, and list or table items end their like.
        alike = CLOSES.get(tag, ())
        while True:
            k = max((opened[t][-1] for t in ("p", *alike) if opened[t]), default=-1)
            if k < 0 or bounds and bounds[-1] > k:
                break
            ended = elements[stack[k]].tag
            close(k)
            if ended == "p" or tag != "tr":
                break
        if tag in VOID:
            continue
        parent = stack[-1] if stack else -1
        elements.append(_element(tag, attrs, parent, elements[parent].depth + 1 if parent >= 0 else 0))
        opened[tag].append(len(stack))
        if tag in BOUNDS:
            bounds.append(len(stack))
        stack.append(len(elements) - 1)
        if tag in ("article", "main", "h1"):
            while parent >= 0 and not elements[parent].main_below:
                elements[parent].main_below = True
                parent = elements[parent].parent
    if place < len(source):
        put(source[place:])
    flush()
    return page
