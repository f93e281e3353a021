"""A tolerant HTML tree: standard-library events in, repaired structure and markup out.

Repairs: void elements; cells, rows, sections, paragraphs and list items that a following one ends;
end tags that match nothing, or could only match across a stronger element, are passed over; text
before any element stands in a paragraph of the body.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a b i u em strong span font small big tt s strike sub sup".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset("address blockquote center dir div dl fieldset form hr menu ol pre table ul".split()) | HEADINGS
#: Elements that belong to the head if nothing of the body has begun, and elements whose text is no markup.
HEAD, RAW = frozenset("base link meta noscript script style title".split()), ("script", "style")
CELLS, SECTIONS = frozenset(("td", "th")), frozenset(("thead", "tbody", "tfoot"))
#: Strength of elements against end tags; all others have 100.
STRENGTH = {"p": 10, "div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220}


#: Markup that one pattern cuts into the events that the parser would find: no references, comments or odd
#: attributes, and no elements whose content is not markup.
SIMPLE = re.compile(r'(?:[^<>&]++|</?[a-zA-Z][a-zA-Z0-9]*+(?: [a-zA-Z][a-zA-Z-]*+="[^"<>&]*+")*+>)*+')
TOKEN = re.compile(r'<([a-zA-Z][a-zA-Z0-9]*)((?: [a-zA-Z][a-zA-Z-]*="[^"]*")*)>|</([a-zA-Z][a-zA-Z0-9]*)>|([^<]+)')
ATTRIBUTE = re.compile(r'([a-zA-Z-]+)="([^"]*)"')
OPAQUE = re.compile(r"<(?:iframe|noembed|noframes|noscript|plaintext|script|style|textarea|title|xmp)\b", re.I)


def ended_by(tag: str) -> frozenset[str]:
    """Open elements that the start of tag ends, as long as they are innermost."""
    if tag in CELLS:
        return CELLS | {"p", "caption"} | INLINE
    if tag == "tr":
        return CELLS | {"tr", "p", "caption", "col", "colgroup"} | INLINE
    if tag in SECTIONS:
        return CELLS | SECTIONS | {"tr", "p", "caption", "col", "colgroup"} | INLINE
    if tag == "p":
        return HEADINGS | {"p"}
    if tag == "li":
        return frozenset(("li", "p"))
    if tag in ("dt", "dd"):
        return frozenset(("dt", "dd", "p"))
    if tag == "option":
        return frozenset(("option",))
    return frozenset(("p",)) if tag in BLOCKS else frozenset()


class Node:
    """An element, or with tag None a text, or with tag `#comment` a comment."""

    __slots__ = ("tag", "attrs", "children", "text", "parent")

    def __init__(self, tag: str | None, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.text = tag, attrs or {}, text
        self.children: list[Node] = []
        self.parent: Node | None = None

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order; the tree may not be changed meanwhile."""
        stack = self.children[::-1]
        while stack:
            n = stack.pop()
            if n.tag and n.tag != "#comment":
                yield n
                stack += n.children[::-1]

    def find_all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def has_class(self, name: str) -> bool:
        return name in (self.attrs.get("class") or "").split()

    def all_text(self, comments: bool = False) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if n.tag is None or (comments and n.tag == "#comment"):
                out.append(n.text)
            stack += n.children[::-1]
        return "".join(out)

    def dissolve(self, fate: Callable[[Node], bool | None]) -> None:
        """Each element below for which fate is true gives way to what is in it, and goes with that for which it is false."""
        stack = [self]
        while stack:
            n = stack.pop()
            todo, n.children = n.children[::-1], []
            while todo:
                c = todo.pop()
                end = fate(c) if c.tag and c.tag != "#comment" else None
                if end:
                    todo += c.children[::-1]
                elif end is None:
                    c.parent = n
                    n.children.append(c)
            stack += [c for c in n.children if c.children]

    def inner(self) -> str:
        """The markup of what is in it."""
        return written(self.children)

    def markup(self) -> str:
        return written([self])


def written(nodes: list[Node]) -> str:
    """The markup of nodes, however deep."""
    out: list[str] = []
    stack: list[Node | str] = nodes[::-1]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag is None:
            out.append(n.text if n.parent is not None and n.parent.tag in RAW else escape(n.text, quote=False))
        elif n.tag == "#comment":
            out.append(f"<!--{n.text}-->")
        else:
            attrs = "".join(f' {k}="{escape(v, quote=False).replace(chr(34), "&quot;")}"' for k, v in n.attrs.items())
            out.append(f"<{n.tag}{attrs}/>" if n.tag in VOID else f"<{n.tag}{attrs}>")
            if n.tag not in VOID:
                stack.append(f"</{n.tag}>")
                stack += n.children[::-1]
    return "".join(out)


class Builder(HTMLParser):
    def __init__(self, repair: bool):
        super().__init__(convert_charrefs=True)
        self.repair = repair
        self.html = Node("html")
        self.head, self.body = self.html.add(Node("head")), self.html.add(Node("body"))
        self.open = [self.body]
        self.count: Counter[str] = Counter()
        self.begun = False

    def close_from(self, k: int) -> None:
        self.count.subtract(n.tag for n in self.open[k:])
        del self.open[k:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        found = {k: v or "" for k, v in reversed(attrs)}
        if self.repair:
            if tag in ("html", "head", "body"):
                self.begun |= tag == "body"
                return
            in_head = not self.begun and tag in HEAD
            self.begun |= not in_head
            ends = ended_by(tag)
            while self.open[-1].tag in ends:
                self.close_from(len(self.open) - 1)
            place = self.head if in_head and len(self.open) == 1 else self.open[-1]
        else:
            place = self.open[-1]
        node = place.add(Node(tag, dict(reversed(found.items()))))
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if self.open[-1].tag == tag and tag not in VOID:
            self.close_from(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or (self.repair and tag in ("html", "head", "body")):
            return
        # An end tag that ends nothing is passed over at once, however many elements are open.
        if not self.count[tag]:
            return
        mine = STRENGTH.get(tag, 100)
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                self.close_from(k)
                return
            if self.repair and STRENGTH.get(self.open[k].tag, 100) > mine:
                return

    def handle_data(self, data: str) -> None:
        if self.repair and not self.begun and len(self.open) == 1:
            if not data.strip():
                return
            self.begun = True
            self.open.append(self.body.add(Node("p")))
            self.count["p"] += 1
        last = self.open[-1].children[-1:]
        if last and last[0].tag is None:
            last[0].text += data
        else:
            self.open[-1].add(Node(None, text=data))

    def handle_comment(self, data: str) -> None:
        self.open[-1].add(Node("#comment", text=data))


def parse(html: str, repair: bool = True) -> Node:
    """The body of html. repair: end open elements as browsers' table models ask; else nesting is as written."""
    b = Builder(repair)
    if SIMPLE.fullmatch(html) and not OPAQUE.search(html):
        for tag, attrs, end, text in TOKEN.findall(html):
            if text:
                b.handle_data(text)
            elif end:
                b.handle_endtag(end.lower())
            else:
                b.handle_starttag(tag.lower(), [(k.lower(), v) for k, v in ATTRIBUTE.findall(attrs)])
    else:
        b.feed(html)
        b.close()
    return b.body
