"""Canonical HTML of tables, their rectangular grids, and the trees that are compared."""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np

from .dom import ATTRIBUTE, Node, parse
from .edits import edit_distance, edit_distances
from .trees import tree_distance

#: Tables as canonical() leaves most of them; what matches needs no parser.
PLAIN = re.compile(r'<table>(?:<tr>(?:<td(?: rowspan="[^"<>&]+")?(?: colspan="[^"<>&]+")?>[^<>&]*</td>)*</tr>)*</table>')
#: One or several of them.
PLAIN_TABLES = re.compile(f"(?:{PLAIN.pattern})+")
CELL = re.compile(r'<td(?: rowspan="([^"]+)")?(?: colspan="([^"]+)")?>([^<]*)</td>')
EMPHASIS = ("b", "i", "strong", "em", "span")
UNWRAPPED = ("thead", "tbody", "tfoot", *EMPHASIS)
WHITE = re.compile(r"\s+")


#: Up to so many cells of a row's table are filled in one by one, more a line at once.
FEW_CELLS = 256

#: Markup cut into texts and tags; tags without references and odd attributes.
PIECES = re.compile(r"(<[^>]*>)")
TAG = re.compile(r'<(/?)([a-zA-Z][a-zA-Z0-9]*)((?: [a-zA-Z][a-zA-Z-]*="[^"<>&]*")*)>')
#: What may stand directly in what, in markup that needs no repair: as it is given, and as a tree.
GIVEN = {"": {"table"}, "table": {"thead", "tbody", "tfoot", "tr"}, **dict.fromkeys(("thead", "tbody", "tfoot"), {"tr"}), "tr": {"td", "th"}, **dict.fromkeys(("td", "th", "tsv", *EMPHASIS), {*EMPHASIS, "tsv"})}
GROWN = {"": {"table"}, "table": {"caption", "colgroup", "thead", "tbody", "tfoot", "tr"}, "colgroup": {"col"}, **dict.fromkeys(("thead", "tbody", "tfoot"), {"tr"}), "tr": {"td", "table"}, "td": set(), "caption": set()}
#: Tags read so far: (whether it ends an element, name, attributes), None of those that the pattern does not take.
TAGS: dict[str, tuple[bool, str, dict[str, str]] | None] = {}
MOST_TAGS = 10_000
#: Texts between tags.
TEXTS = re.compile(r">([^<>]+)<")
#: How rows were rewritten, by the elements above them, their tags and which of their texts are blank.
ROWS: dict[tuple, tuple[str, list[int], tuple[str, ...]] | None] = {}
MOST_ROWS, LONGEST_ROW = 2_000, 8_000
#: The same for whole tables.
TABLES: dict[tuple, tuple[str, list[int], tuple[str, ...]] | None] = {}


def tag_of(tag: str) -> tuple[bool, str, dict[str, str]] | None:
    if tag in TAGS:
        return TAGS[tag]
    if len(TAGS) >= MOST_TAGS:
        TAGS.clear()
    found = TAG.fullmatch(tag)
    attrs: dict[str, str] = {}
    for k, v in ATTRIBUTE.findall(found[3]) if found else ():
        attrs.setdefault(k.lower(), v)
    TAGS[tag] = (found[1] == "/", found[2].lower(), attrs) if found and not (found[1] and found[3]) else None
    return TAGS[tag]


def pieces(source: str) -> list[str] | None:
    """Texts and tags in turn, of markup without references that begins and ends with a tag; else None."""
    if "&" in source:
        return None
    parts = PIECES.split(source)
    tags = len(parts) // 2
    return parts if tags and not parts[0] and not parts[-1] and source.count("<") == tags == source.count(">") else None


def one_spaced(text: str) -> str:
    return " ".join(text.split())


@lru_cache(16)
def is_plain(source: str) -> bool:
    return PLAIN.fullmatch(source) is not None


def rewritten(parts: list[str], open_: list[tuple[str, int, int, bool]]) -> list[str | int] | None:
    """What canonical() leaves of texts and tags in turn, given the open elements, which it updates; texts by their number.
    None if they need repair."""
    out: list[str | int] = []
    top, texts, cells, number = open_[-1][0] if open_ else "", 0, 0, 0
    for k in range(1, len(parts), 2):
        if (tag := tag_of(parts[k])) is None:
            return None
        end, name, attrs = tag
        if end:
            if name != top:
                return None
            _, start, before, math = open_.pop()
            if name == "tsv" or (math and texts == before):
                del out[start:]
            elif name in ("td", "th"):
                cells -= 1
                out.append("</td>")
            elif name not in UNWRAPPED:
                out.append(f"</{name}>")
            top = open_[-1][0] if open_ else ""
            if not open_ and k + 2 < len(parts):
                return None
        else:
            if name not in GIVEN[top]:
                return None
            open_.append((name, len(out), texts, name == "span" and "math-inline" in attrs.get("class", "").split()))
            top = name
            if name in ("td", "th"):
                cells += 1
                name = "td"
            if name not in UNWRAPPED and name != "tsv":
                spans = "".join(f' {k}="{attrs[k]}"' for k in ("rowspan", "colspan") if attrs.get(k, "1") != "1") if name != "table" and attrs else ""
                out.append(f"<{name}{spans}>")
        if text := parts[k + 1]:
            if not cells:
                return None
            out.append(number)
            number += 1
            texts += not text.isspace()
    return out


def rewriting(source: str, above: tuple[str, ...]) -> tuple[str, list[int], tuple[str, ...]] | None:
    """How a part of a table is rewritten that stands in the elements above: a pattern, which texts go into it, and the
    elements left open. None if it needs repair."""
    open_ = [(name, 0, 0, False) for name in above]
    if (parts := pieces(source)) is None or (out := rewritten(parts, open_)) is None:
        return None
    return "".join("%s" if isinstance(x, int) else x.replace("%", "%%") for x in out), [x for x in out if isinstance(x, int)], tuple(x[0] for x in open_)


def quick_canonical(source: str) -> str | None:
    """canonical() of one table of sections, rows and cells with emphasis that needs no repair, without a tree; else None.

    A row is rewritten as one before it with the same tags, and with texts and blanks in the same places, was.
    """
    if "&" in source:
        return None
    out: list[str] = []
    above: tuple[str, ...] = ()
    *rows, rest = source.split("</tr>")
    for row in rows:
        parts = TEXTS.split(row)
        texts = parts[1::2]
        key = (above, *parts[::2], *map(str.isspace, texts))
        if key in ROWS:
            found = ROWS[key]
        else:
            found = rewriting(row + "</tr>", above)
            if len(row) <= LONGEST_ROW:
                if len(ROWS) >= MOST_ROWS:
                    ROWS.clear()
                ROWS[key] = found
        if found is None:
            return None
        pattern, kept, above = found
        out.append(pattern % tuple(map(texts.__getitem__, kept)))
    if rest or not out:
        if (found := rewriting(rest, above)) is None:
            return None
        pattern, kept, above = found
        out.append(pattern % tuple(map(TEXTS.findall(rest).__getitem__, kept)))
    return None if above else one_spaced("".join(out))


def canonical(source: str) -> str:
    """The body's markup with the first table stripped of all that is not structure or content.

    Blank math spans and `tsv` go with their contents; other math spans, `inline-tabular` divisions,
    row sections and emphasis are unwrapped; `th` is `td`; the table keeps no attributes and what is
    in it only spans other than exactly "1". Without a table only emphasis is unwrapped.
    """
    if is_plain(source) and "span=" not in source:
        return one_spaced(source)
    if (quick := quick_canonical(source)) is not None:
        return quick
    body = parse(source)
    table = next((n for n in body.walk() if n.tag == "table"), None)
    if table is None:
        body.dissolve(lambda n: True if n.tag in EMPHASIS else None)
        return one_spaced(body.inner())
    blank: dict[int, bool] = {}
    for n in reversed(list(table.walk())):
        blank[id(n)] = all(not c.text.strip() if c.tag is None else c.tag == "#comment" or blank[id(c)] for c in n.children)

    def fate(n: Node) -> bool | None:
        if n.tag == "tsv" or (n.tag == "span" and n.has_class("math-inline") and blank[id(n)]):
            return False
        return True if n.tag in UNWRAPPED or (n.tag == "div" and n.has_class("inline-tabular")) else None

    table.dissolve(fate)
    table.attrs = {}
    for n in table.walk():
        if n.tag == "th":
            n.tag = "td"
        n.attrs = {k: n.attrs[k] for k in ("rowspan", "colspan") if n.attrs.get(k, "1") != "1"}
    return one_spaced(body.inner())


def canonical_alike(source: str) -> str:
    """canonical(); a table with the same tags as one before, and with texts and blanks in the same places, is rewritten as that was."""
    if "&" in source or len(source) > LONGEST_ROW:
        return canonical(source)
    parts = TEXTS.split(source)
    texts = parts[1::2]
    key = (*parts[::2], *map(str.isspace, texts))
    if key not in TABLES:
        if len(TABLES) >= MOST_ROWS:
            TABLES.clear()
        found = rewriting(source, ())
        TABLES[key] = None if found is None or found[2] else found
    if (found := TABLES[key]) is None:
        return canonical(source)
    return one_spaced(found[0] % tuple(map(texts.__getitem__, found[1])))


def span(value: str | None) -> int:
    """A span attribute as a whole number, half to even; 1 for what is no number. Infinity raises."""
    try:
        return round(float(value if value is not None else 1))
    except (ValueError, TypeError):
        return 1


def plain_rows(source: str) -> list[list[tuple[str | None, str | None, str]]] | None:
    """(rowspan, colspan, text) of the cells of each row of a plain table, None of any other text."""
    return rows_in(source) if is_plain(source) else None


def rows_in(source: str) -> list[list[tuple[str | None, str | None, str]]]:
    return [[(down or None, across or None, text) for down, across, text in CELL.findall(r)] for r in source.split("<tr>")[1:]]


def cells_of(source: str) -> tuple[list[list[tuple[str | None, str | None, str]]], list[str]]:
    """(rowspan, colspan, text) of the cells of all rows, and the texts of all paragraphs."""
    if PLAIN_TABLES.fullmatch(source):
        return rows_in(source), []
    body = parse(source)
    rows = [[(c.attrs.get("rowspan"), c.attrs.get("colspan"), c.all_text(comments=True)) for c in tr.children if c.tag in ("td", "th")] for tr in body.find_all("tr")]
    return rows, [p.all_text(comments=True) for p in body.find_all("p")]


def grid(source: str) -> list[list[str]]:
    """All rows of all tables with spans filled in, to the same width, then a row for each paragraph with text.

    A cell that spans rows is due in the rows below wherever its column comes up next, also beyond
    its own table; one that never comes up stays due.
    """
    found, paragraphs = cells_of(source)
    due: dict[int, tuple[str, int]] = {}
    rows: list[list[str]] = []

    def fill(row: list[str], column: int) -> int:
        while column in due and due[column][1] > 0:
            text, left = due.pop(column)
            row.append(text)
            if left > 1:
                due[column] = (text, left - 1)
            column += 1
        return column

    for cells in found:
        if not due and not any(down or across for down, across, _ in cells):
            rows.append([text.strip() for _, _, text in cells])
            continue
        row: list[str] = []
        column = fill(row, 0)
        for cell in cells:
            column = fill(row, column)
            down, across, text = span(cell[0]), span(cell[1]), cell[2].strip()
            if down > 1:
                due.update((column + k, (text, down - 1)) for k in range(across))
            row += [text] * across
            column += across
        fill(row, column)
        rows.append(row)
    if not rows:
        return []
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    extra = [t for t in (p.strip() for p in paragraphs) if t]
    if extra and not width:
        raise ValueError("rows without cells beside a paragraph")
    return rows + [[t] + [""] * (width - 1) for t in extra]


def compared(cell: str) -> str:
    """A cell as the content score compares it: references resolved, no white space, no ASCII hyphens."""
    return WHITE.sub("", html.unescape(cell).replace("-", ""))


def plain_compared(source: str) -> list[list[str]] | None:
    """Rows of a plain table without spans, each cell as compared() leaves it, cleaned all at once; None of any other text
    and of a table without rows."""
    if not is_plain(source) or "span=" in source or "<tr>" not in source:
        return None
    rows = "".join(source.split()).replace("-", "")[len("<table><tr>") : -len("</tr></table>")].split("</tr><tr>")
    return [r[len("<td>") : -len("</td>")].split("</td><td>") if r else [] for r in rows]


def compared_grids(a: str, b: str) -> tuple[list[list[str]], list[list[str]]]:
    """Both grids as they are compared, the narrower one padded with blank columns; empty ones stay empty."""
    plain = plain_compared(a), plain_compared(b)
    if plain[0] is not None and plain[1] is not None:
        width = max(len(r) for g in plain for r in g)
        if not width:
            raise ValueError("no columns on either side")
        return tuple(g if all(len(r) == width for r in g) else [r + [""] * (width - len(r)) for r in g] for g in plain)
    ga, gb = ([[compared(c) for c in r] for r in grid(x)] for x in (a, b))
    if ga and gb:
        width = max(len(ga[0]), len(gb[0]))
        if not width:
            raise ValueError("no columns on either side")
        ga, gb = ([r + [""] * (width - len(r)) for r in g] for g in (ga, gb))
    return ga, gb


#: What stands before each row and each cell of a grid as one text; compared cells hold no white space.
ROW_MARK, CELL_MARK = "\n", " "


def plain_lines(source: str) -> list[str] | None:
    """Rows of a plain table as plain_compared() gives them, each as one text."""
    if not is_plain(source) or "span=" in source or "<tr>" not in source:
        return None
    cells = "".join(source.split()).replace("-", "").replace("<td>", CELL_MARK).replace("</td>", "")
    return cells[len("<table><tr>") : -len("</tr></table>")].split("</tr><tr>")


def compared_texts(a: str, b: str) -> tuple[str, str]:
    """compared_grids() with each grid as one text: rows and cells, each after its mark."""
    first = plain_lines(a)
    plain = first, first if a == b else plain_lines(b)
    if plain[0] is not None and plain[1] is not None:
        widths = {r.count(CELL_MARK) for g in plain for r in g}
        width = max(widths)
        if not width:
            raise ValueError("no columns on either side")
        if len(widths) > 1:
            plain = tuple([r + CELL_MARK * (width - r.count(CELL_MARK)) for r in g] for g in plain)
        return tuple(ROW_MARK + ROW_MARK.join(g) for g in plain)
    return tuple("".join(ROW_MARK + "".join(CELL_MARK + c for c in r) for r in g) for g in compared_grids(a, b))


def content_tokens(cell: Node) -> list[str]:
    """Characters of a cell, with one token for each start and end of inline markup."""
    out: list[str] = []
    stack: list[Node | str] = cell.children[::-1]
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag is None:
            out += c.text
        elif c.tag != "#comment":
            out.append(f"<{c.tag}>")
            stack.append(f"</{c.tag}>")
            stack += c.children[::-1]
    return out


class Tree:
    """A table in post-order: labels (tag, rowspan, colspan), contents, leftmost leaves."""

    def __init__(self, source: str):
        plain = plain_rows(source)
        if plain is not None:
            self.labels, self.contents, self.left = [], [], []
            for row in plain:
                first = len(self.labels)
                for down, across, text in row:
                    self.left.append(len(self.labels))
                    self.labels.append(("td", down or "1", across or "1"))
                    self.contents.append(list(text))
                self.left.append(first)
                self.labels.append(("tr",))
                self.contents.append(None)
            self.left.append(0)
            self.labels.append(("table",))
            self.contents.append(None)
            self.size = len(self.labels) - 1
            return
        if self.grown(source):
            self.size = len(self.labels) - 1
            return
        table = next((n for n in parse(source).children if n.tag == "table"), None)
        self.labels: list[tuple] = []
        self.contents: list[list[str] | None] = []
        self.left: list[int] = []
        self.size = sum(1 for _ in table.walk()) if table else 0
        if table:
            self.add(table)

    def grown(self, source: str) -> bool:
        """Whether source is one table that needs no repair, with text only in its cells; if so, its nodes are added."""
        self.labels, self.contents, self.left = [], [], []
        if (parts := pieces(source)) is None:
            return False
        open_: list[tuple[str, int, dict[str, str]]] = []
        top = ""
        for k in range(1, len(parts), 2):
            if (tag := tag_of(parts[k])) is None:
                return False
            end, name, attrs = tag
            if end and name != "col":
                if name != top:
                    return False
                _, first, attrs = open_.pop()
                top = open_[-1][0] if open_ else ""
                if not open_ and k + 2 < len(parts):
                    return False
            elif not end:
                if name not in GROWN[top]:
                    return False
                if name != "col":
                    open_.append((name, len(self.labels), attrs))
                    top = name
                    continue
                first = len(self.labels)
            else:
                continue
            self.left.append(first)
            self.labels.append(("td", attrs.get("rowspan", "1"), attrs.get("colspan", "1")) if name == "td" else (name,))
            self.contents.append(list(parts[k - 1]) if name == "td" else None)
        return not open_

    def add(self, top: Node) -> None:
        """top and all below it, a node after its children; its leftmost leaf is the first node that is added below it."""
        stack: list[tuple[Node, int | None]] = [(top, None)]
        while stack:
            n, first = stack.pop()
            below = [] if n.tag == "td" or first is not None else [c for c in n.children if c.tag and c.tag != "#comment"]
            if below:
                stack.append((n, len(self.labels)))
                stack += [(c, None) for c in reversed(below)]
                continue
            self.labels.append((n.tag, n.attrs.get("rowspan", "1"), n.attrs.get("colspan", "1")) if n.tag == "td" else (n.tag,))
            self.contents.append(content_tokens(n) if n.tag == "td" else None)
            self.left.append(len(self.labels) - 1 if first is None else first)


    def below(self, k: int) -> list[tuple[int, int]]:
        """First and last node of each subtree directly below node k."""
        out, first, k = [], self.left[k], k - 1
        while k >= first:
            out.append((self.left[k], k))
            k = self.left[k] - 1
        return out[::-1]

    def part(self, first: int, last: int, top: tuple) -> Tree:
        """A tree of the nodes from first to last, which are whole subtrees, below a node of that label."""
        t = Tree.__new__(Tree)
        t.labels, t.contents = [*self.labels[first : last + 1], top], [*self.contents[first : last + 1], None]
        t.left = [*(x - first for x in self.left[first : last + 1]), 0]
        t.size = last + 1 - first
        return t

    def rows(self) -> list[list[tuple]] | None:
        """(rowspan, colspan, content) of the cells of each row, if the table holds only rows and they only cells; else None."""
        out, row, first = [], [], 0
        for label, content, left in zip(self.labels[:-1], self.contents, self.left, strict=False):
            if label[0] == "td":
                row.append((label[1], label[2], tuple(content)))
            elif label[0] == "tr" and left == first:
                out.append(row)
                first += len(row) + 1
                row = []
            else:
                return None
        return None if row or not self.labels or self.labels[-1] != ("table",) or self.left[-1] != 0 else out


def cell_renames(a: list[tuple], b: list[tuple]) -> np.ndarray:
    """The cost of a rename of each cell of a to each of b: 1 between unlike spans, else the share of content that differs."""
    spans: dict[tuple, int] = {}
    kind = [np.array([spans.setdefault((c[0] or "1", c[1] or "1"), len(spans)) for c in t], dtype=int) for t in (a, b)]
    x, y = ([c[2] for c in t] for t in (a, b))
    larger = np.maximum(np.array([len(s) for s in x], dtype=float)[:, None], np.array([len(s) for s in y], dtype=float)[None, :])
    out = edit_distances(x, y) / np.maximum(larger, 1.0)
    out[kind[0][:, None] != kind[1][None, :]] = 1.0
    return out


def leaf_distance(x: list[tuple], y: list[tuple]) -> float:
    """The distance of two rows of cells, given (rowspan, colspan, content)."""
    lo, least = 0, min(len(x), len(y))
    while lo < least and x[lo] == y[lo]:
        lo += 1
    hi = 0
    while hi < least - lo and x[-1 - hi] == y[-1 - hi]:
        hi += 1
    x, y = x[lo : len(x) - hi], y[lo : len(y) - hi]
    if not x or not y:
        return float(len(x) + len(y))
    if len(x) == len(y) == 1:
        (p, q, a), (r, s, b) = x[0], y[0]
        alike = (p or "1", q or "1") == (r or "1", s or "1")
        return edit_distance(a, b) / max(len(a), len(b), 1) if alike else 1.0
    costs = cell_renames(x, y)
    steps = np.arange(len(y) + 1)
    last = steps.astype(float)
    for line in costs:
        best = last + 1.0
        np.minimum(best[1:], last[:-1] + line, out=best[1:])
        last = np.minimum.accumulate(best - steps) + steps
    return float(last[-1])


def distance(a: Tree, b: Tree) -> float:
    """any_distance(), of what is left without the equal subtrees at both ends.

    Under roots of one label, which map to each other, subtrees that are equal and stand first or last on both sides map to
    each other as well: whatever else their nodes map to can be given up at no cost. So do single subtrees with roots of one label.
    """
    i, j = len(a.labels) - 1, len(b.labels) - 1
    while a.labels[i] == b.labels[j] and a.contents[i] is None:
        x, y = a.below(i), b.below(j)

        def equal(p: tuple[int, int], q: tuple[int, int]) -> bool:
            (s, e), (u, v) = p, q
            return e - s == v - u and a.labels[s : e + 1] == b.labels[u : v + 1] and a.contents[s : e + 1] == b.contents[u : v + 1] and all(f - s == g - u for f, g in zip(a.left[s : e + 1], b.left[u : v + 1], strict=True))

        lo, least = 0, min(len(x), len(y))
        while lo < least and equal(x[lo], y[lo]):
            lo += 1
        hi = 0
        while hi < least - lo and equal(x[-1 - hi], y[-1 - hi]):
            hi += 1
        x, y = x[lo : len(x) - hi], y[lo : len(y) - hi]
        if not x or not y:
            return float(sum(e + 1 - s for s, e in (*x, *y)))
        if len(x) == len(y) == 1:
            i, j = x[0][1], y[0][1]
            if a.contents[i] is None:
                continue
        if all(t.contents[e] is not None for t, z in ((a, x), (b, y)) for _, e in z):
            return leaf_distance(*([(*t.labels[e][1:], tuple(t.contents[e])) for _, e in z] for t, z in ((a, x), (b, y))))
        break
    else:
        x, y = [(a.left[i], i)], [(b.left[j], j)]
    a, b = (t.part(z[0][0], z[-1][1], ("table",)) for t, z in ((a, x), (b, y)))
    flat = a.rows(), b.rows()
    return plain_distance(*flat) if flat[0] is not None and flat[1] is not None else any_distance(a, b)


def plain_source_distance(a: str, b: str) -> float:
    """The distance of two plain tables; equal rows at both ends are left out as text."""
    x, y = (t[len("<table>") : -len("</table>")].split("</tr>")[:-1] for t in (a, b))
    lo, least = 0, min(len(x), len(y))
    while lo < least and x[lo] == y[lo]:
        lo += 1
    hi = 0
    while hi < least - lo and x[-1 - hi] == y[-1 - hi]:
        hi += 1
    x, y = x[lo : len(x) - hi], y[lo : len(y) - hi]
    if not x or not y:
        return float(sum(r.count("<td") + 1 for r in (*x, *y)))
    x, y = ([[(down or None, across or None, text) for down, across, text in CELL.findall(r)] for r in t] for t in (x, y))
    return leaf_distance(x[0], y[0]) if len(x) == len(y) == 1 else plain_distance(x, y)


@lru_cache(4)
def tree_of(source: str) -> Tree:
    return Tree(source)


def any_distance(a: Tree, b: Tree) -> float:
    """Least cost of node insertions and deletions at 1 and of renames: 1 between unlike labels, else the share of content that differs."""
    sides = []
    for t in (a, b):
        kinds: dict[tuple, int] = {}
        at = np.array([kinds.setdefault((label, None if content is None else tuple(content)), len(kinds)) for label, content in zip(t.labels, t.contents, strict=True)], dtype=int)
        sides.append((list(kinds), at))
    (x, at_x), (y, at_y) = sides
    cells = [[k for k, (_, content) in enumerate(s) if content is not None] for s in (x, y)]
    costs = np.array([[float(p[0] != q[0]) for q in y] for p in x]).reshape(len(x), len(y))
    costs[np.ix_(*cells)] = cell_renames(*([(*s[k][0][1:], s[k][1]) for k in some] for s, some in zip((x, y), cells, strict=True)))
    return tree_distance(a.left, b.left, costs[at_x[:, None], at_y[None, :]])


def plain_distance(a: list[list[tuple]], b: list[list[tuple]]) -> float:
    """tree_distance() of two tables of rows of cells, given the (rowspan, colspan, content) of the cells of their rows.

    In such trees all distances of subtrees but those of two rows have closed forms: cell to cell is
    a rename, cell to row is the row's cells and the best rename, at most 1. What is left is one
    table of distances of forests, of which each line is filled at once. The roots map to each other.
    """
    known = [sorted({c for r in t for c in r}, key=str) for t in (a, b)]
    number = [{c: k for k, c in enumerate(x)} for x in known]
    renames = cell_renames(*known)
    rows = [[[of[c] for c in r] for r in t] for t, of in zip((a, b), number, strict=True)]
    widths = [np.array([len(r) for r in t], dtype=float) for t in (a, b)]

    def least(to: np.ndarray, others: list[list[int]]) -> np.ndarray:
        """The best rename of each cell to a cell of each row, at most 1."""
        return np.array([np.minimum(1.0, to[:, r].min(axis=1)) if r else np.ones(len(to)) for r in others]).T.reshape(len(to), len(others))

    # From each cell to each row of the other table, and the other way round.
    down, up = widths[1] + least(renames, rows[1]), widths[0] + least(renames.T, rows[0])
    broad = max(map(len, rows[1]), default=0)
    padded = np.array([r + [0] * (broad - len(r)) for r in rows[1]], dtype=int).reshape(len(b), broad)

    def to_rows(k: int) -> list[float] | np.ndarray:
        """From row k of a to each row of b."""
        if padded.size > FEW_CELLS:
            steps = np.arange(broad + 1)
            last = np.tile(steps.astype(float), (len(b), 1))
            for c in rows[0][k]:
                best = last + 1.0
                np.minimum(best[:, 1:], last[:, :-1] + renames[c][padded], out=best[:, 1:])
                last = np.minimum.accumulate(best - steps, axis=1) + steps
            return last[np.arange(len(b)), widths[1].astype(int)]
        return [0.0 if a[k] == b[j] else between(rows[0][k], y) for j, y in enumerate(rows[1])]

    def between(x: list[int], y: list[int]) -> float:
        last = [float(k) for k in range(len(y) + 1)]
        for i in x:
            line, row = renames[i], [last[0] + 1.0]
            for k, j in enumerate(y):
                row.append(min(last[k] + line[j], last[k + 1] + 1.0, row[k] + 1.0))
            last = row
        return last[-1]

    # Nodes of b in post-order: their kinds, numbers and leftmost leaves.
    is_row, which, left = [], [], []
    for k, r in enumerate(rows[1]):
        start = len(left)
        for c in r:
            left.append(len(left))
            is_row.append(False)
            which.append(c)
        left.append(start)
        is_row.append(True)
        which.append(k)
    is_row, which, left = np.array(is_row, dtype=bool), np.array(which), np.array(left)
    cell, place = which[~is_row], np.flatnonzero(~is_row)
    steps = np.arange(len(left) + 1)
    lines = [steps.astype(float)]

    def add(subtree: np.ndarray, start: np.ndarray) -> None:
        """The next line, given the node's distances to the subtrees of b and the line before its leftmost leaf."""
        best = np.empty(len(steps))
        best[0] = lines[-1][0] + 1.0
        np.minimum(lines[-1][1:] + 1.0, start[left] + subtree, out=best[1:])
        lines.append(np.minimum.accumulate(best - steps) + steps)

    for k, r in enumerate(rows[0]):
        start = lines[-1]
        subtree = np.empty(len(left))
        for c in r:
            subtree[place], subtree[is_row] = renames[c, cell], down[c]
            add(subtree, lines[-1])
        subtree[place] = up[cell, k]
        subtree[is_row] = to_rows(k)
        add(subtree, start)
    return float(lines[-1][-1])


def nothing_to_compare(source: str) -> bool:
    return "<tr>" not in source


def tree_score(truth: str, guess: str) -> float:
    """1 less the tree edit distance over the larger number of nodes below `table`; 0 if a side has no row. Two tables
    without a node raise ZeroDivisionError."""
    if nothing_to_compare(truth) or nothing_to_compare(guess):
        return 0.0
    if is_plain(truth) and is_plain(guess):
        return 1.0 if truth == guess else max(0.0, 1.0 - plain_source_distance(truth, guess) / max(t.count("<tr>") + t.count("<td") for t in (truth, guess)))
    a = tree_of(truth)
    b = a if truth == guess else tree_of(guess)
    if not a.labels or not b.labels:
        return 0.0
    if truth == guess:
        return 1.0 - 0.0 / a.size
    return max(0.0, 1.0 - distance(a, b) / max(a.size, b.size))
