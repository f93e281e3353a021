import itertools
import math
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablescore.functions import edits, trees
from tablescore.functions import tables as t
from tablescore.functions.dom import parse


def html(rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


def rows(text):
    return [r.split(",") for r in text.split("/")]


EX1 = rows("Item,Price,Stock,Category/Apple,1.99,100,Fruit/Banana,0.89,150,Fruit/Carrot,1.29,80,Vegetable")
EX2 = rows("Country,Capital,Population/France,Paris,67M/Germany,Berlin,83M/Italy,Rome,60M"), rows("Country,Capital,Population/Mars,RedCity,0/Venus,HotTown,0/Jupiter,GasVille,0")


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("", ""),
        ("<table></table>", "<table></table>"),
        ("ERROR: x", "<p>ERROR: x</p>"),
        ('<table border="1"><thead><tr><th colspan="1" class="a"><b>A</b></th></tr></thead></table>', "<table><tr><td>A</td></tr></table>"),
        ('<table><tr><td colspan="2" rowspan="3" id="x">a</td></tr></table>', '<table><tr><td rowspan="3" colspan="2">a</td></tr></table>'),
        ('<table><tr><td rowspan="01">a</td></tr></table>', '<table><tr><td rowspan="01">a</td></tr></table>'),
        ('<table><tr><td><span class="math-inline">x</span><span class="math-inline"> </span><tsv>q</tsv></td></tr></table>', "<table><tr><td>x</td></tr></table>"),
        ('<table><tr><td><div class="inline-tabular"><table class="n"><tr><th>i</th></tr></table></div></td></tr></table>', "<table><tr><td><table><tr><td>i</td></tr></table></td></tr></table>"),
        ("<table><tr><td>a</td></tr></table><table class=k><thead><tr><th>b</th></tr></thead></table>", '<table><tr><td>a</td></tr></table><table class="k"><thead><tr><th>b</th></tr></thead></table>'),
        ("<table><tr><td>a  \n b</td></tr></table>", "<table><tr><td>a b</td></tr></table>"),
        ("<table><tr><td>a<br>b &amp; c &lt; d</td></tr></table>", "<table><tr><td>a<br/>b &amp; c &lt; d</td></tr></table>"),
        ("see <table><tr><td>a</table>", "<p>see </p><table><tr><td>a</td></tr></table>"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>"),
        ("<table><tr><td>a</div></td></tr></table>", "<table><tr><td>a</td></tr></table>"),
        ("<p>a<p>b", "<p>a</p><p>b</p>"),
        ("<p>a <b>b</b> <i>c</i></p>", "<p>a b c</p>"),
    ],
)
def test_canonical(source, expected):
    assert t.canonical(source) == expected


@pytest.mark.parametrize(("value", "expected"), [(None, 1), ("x", 1), ("2.5", 2), ("1.5", 2), ("0", 0), ("nan", 1), ("-1", -1), ("1_0", 10), ("", 1)])
def test_span(value, expected):
    assert t.span(value) == expected


def test_infinite_span_raises():
    with pytest.raises(OverflowError):
        t.span("inf")


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("", []),
        ("no table", []),
        ("<table></table>", []),
        ('<table><tr><td rowspan="2">a</td><td>b</td></tr><tr><td>c</td></tr></table>', [["a", "b"], ["a", "c"]]),
        ('<table><tr><td colspan="2">a</td></tr><tr><td>b</td></tr></table>', [["a", "a"], ["b", ""]]),
        ('<table><tr><td rowspan="2" colspan="2">a</td><td>b</td></tr><tr><td>c</td></tr></table>', [["a", "a", "b"], ["a", "a", "c"]]),
        ("<table><tr><td><p>x</p></td></tr></table>", [["x"], ["x"]]),
        ("<table><tr><td>a</td></tr></table><table><tr><td>b</td><td>c</td></tr></table>", [["a", ""], ["b", "c"]]),
        ("<table><tr><td>a<table><tr><td>b</td></tr></table></td></tr></table>", [["ab"], ["b"]]),
        ('<table><tr><td colspan="0">a</td><td>b</td></tr></table>', [["b"]]),
        # A cell that is due in column 2 is not reached by a row of one cell, and waits.
        ('<table><tr><td>a</td><td>b</td><td rowspan="2">c</td></tr><tr><td>d</td></tr><tr><td>e</td><td>f</td></tr></table>', [["a", "b", "c"], ["d", "", ""], ["e", "f", "c"]]),
        # It also waits for the next table.
        ('<table><tr><td rowspan="2">a</td></tr></table><table><tr><td>b</td></tr></table>', [["a", ""], ["a", "b"]]),
    ],
)
def test_grid(source, expected):
    assert t.grid(source) == expected


def test_degenerate_grids():
    with pytest.raises(ValueError):
        t.grid("<table><tr></tr></table><p>x</p>")
    with pytest.raises(ValueError):
        t.compared_grids("<table><tr></tr></table>", "<table><tr></tr></table>")


def test_compared_cells():
    assert t.compared("-5") == "5"
    assert t.compared("a b\u00a0c\n") == "abc"
    assert t.compared("&amp;lt;") == "&lt;"
    assert t.compared("&lt;") == "<"


def test_published_tree_scores():
    assert t.tree_score(html(EX1), html([[" ".join(r)] for r in EX1])) == pytest.approx(0.261536, abs=1e-6)
    assert t.tree_score(html(EX2[0]), html(EX2[1])) == pytest.approx(0.503348, abs=1e-6)


def test_tree_score_of_nothing():
    assert t.tree_score("<table></table>", "<table></table>") == 0.0
    assert t.tree_score("", html([["a"]])) == 0.0
    assert t.tree_score("<table><tr class=a></tr></table>", html([["a"]])) == 0.0


def test_tree_counts_spans_and_markup():
    assert t.tree_score('<table><tr><td rowspan="2">a</td></tr></table>', html([["a"]])) == 0.5
    assert t.tree_score("<table><tr><td>a<sub>b</sub></td></tr></table>", html([["ab"]])) == pytest.approx(1 - (2 / 4) / 3)


def brute_distance(a, b):
    """Edit distance of ordered forests by its recursive definition."""
    from functools import cache

    def build(n):
        return (n.tag, n.attrs.get("rowspan", "1"), n.attrs.get("colspan", "1"), tuple(t.content_tokens(n)) if n.tag == "td" else None, () if n.tag == "td" else tuple(build(c) for c in n.children if c.tag))

    def size(f):
        return sum(1 + size(x[4]) for x in f)

    def rename(x, y):
        if x[:3] != y[:3]:
            return 1.0
        if x[0] != "td" or not (x[3] or y[3]):
            return 0.0
        return edits.edit_distance(list(x[3]), list(y[3])) / max(len(x[3]), len(y[3]))

    @cache
    def d(f, g):
        if not f or not g:
            return float(size(f) + size(g))
        x, y = f[-1], g[-1]
        return min(d(f[:-1] + x[4], g) + 1, d(f, g[:-1] + y[4]) + 1, d(f[:-1], g[:-1]) + d(x[4], y[4]) + rename(x, y))

    root = lambda h: (build(next(n for n in parse(h).children if n.tag == "table")),)
    return d(root(a), root(b))


def test_tree_distance_equals_brute_force():
    r = random.Random(5)
    table = lambda: html([["".join(r.choices("ab", k=r.randint(0, 3))) for _ in range(r.randint(0, 3))] for _ in range(r.randint(1, 3))])
    for _ in range(60):
        a, b = table(), table()
        assert t.any_distance(t.Tree(a), t.Tree(b)) == pytest.approx(brute_distance(a, b))


def test_distance_of_other_trees_equals_brute_force(monkeypatch):
    """Captions, column groups, sections and tables in rows, nested at random."""
    r = random.Random(9)

    def some(depth):
        if depth == 0 or r.random() < 0.4:
            return f"<td>{''.join(r.choices('ab', k=r.randint(0, 3)))}</td>"
        tag = r.choice(["tr", "caption", "colgroup", "x", "table"])
        return f"<{tag}>{''.join(some(depth - 1) for _ in range(r.randint(0, 3)))}</{tag}>"

    made = 0
    while made < 150:
        a, b = (t.Tree("<table>" + "".join(some(3) for _ in range(r.randint(0, 3))) + "</table>") for _ in range(2))
        if max(a.size, b.size) > 12:
            continue
        made += 1
        known = lambda x: list(zip(x.labels, map(str, x.contents), x.left, strict=True))
        want = pytest.approx(forest_distance(a, b))
        for few in (trees.FEW_PLACES, 0):
            monkeypatch.setattr(trees, "FEW_PLACES", few)
            assert t.any_distance(a, b) == want, (known(a), known(b))


def forest_distance(a, b):
    """The recursive definition over two trees in post-order."""
    from functools import cache

    def rename(x, y):
        if a.labels[x] != b.labels[y]:
            return 1.0
        p, q = a.contents[x] or [], b.contents[y] or []
        return edits.edit_distance(p, q) / max(len(p), len(q), 1)

    def without(tree, f):
        """A forest (roots) without its last root, whose children take its place."""
        k, out, at = f[-1], [], f[-1] - 1
        while at >= tree.left[k]:
            out.append(at)
            at = tree.left[at] - 1
        return f[:-1], tuple(reversed(out))

    nodes = lambda tree, f: sum(k - tree.left[k] + 1 for k in f)

    @cache
    def d(f, g):
        if not f or not g:
            return float(nodes(a, f) + nodes(b, g))
        (f0, f1), (g0, g1) = without(a, f), without(b, g)
        return min(d(f0 + f1, g) + 1, d(f, g0 + g1) + 1, d(f0, g0) + d(f1, g1) + rename(f[-1], g[-1]))

    return d((len(a.labels) - 1,), (len(b.labels) - 1,))


def test_long_cells_and_other_trees_are_quick():
    r = random.Random(10)
    table = lambda rows, cols, size, more: f"<table>{more}{''.join('<tr>' + ''.join('<td>' + ''.join(r.choices('abcdefgh ', k=size)) + '</td>' for _ in range(cols)) + '</tr>' for _ in range(rows))}</table>"
    for rows, cols, size, more, limit in ((8, 4, 216, "", 1), (20, 4, 1000, "", 15), (100, 8, 6, "<caption>x</caption>", 5)):
        a, b = table(rows, cols, size, more), table(rows, cols, size, more)
        began = time.perf_counter()
        assert 0 < t.tree_score(a, b) < 1
        assert time.perf_counter() - began < limit


def test_plain_distance_equals_the_general_one():
    r = random.Random(6)
    cell = lambda: f"<td{r.choice(['', '', ' rowspan=%s' % chr(34) + '2' + chr(34)])}>{''.join(r.choices('abc', k=r.randint(0, 3)))}</td>"
    table = lambda: "<table>" + "".join("<tr>" + "".join(cell() for _ in range(r.randint(0, 4))) + "</tr>" for _ in range(r.randint(1, 5))) + "</table>"
    for _ in range(300):
        a, b = table(), table()
        assert t.plain_distance(t.plain_rows(a), t.plain_rows(b)) == pytest.approx(t.any_distance(t.Tree(a), t.Tree(b))), (a, b)


def test_many_cells_are_compared_alike(monkeypatch):
    r = random.Random(7)
    cell = lambda: f"<td{r.choice(['', '', ' rowspan=%s' % chr(34) + '2' + chr(34)])}>{''.join(r.choices('abc', k=r.choice([0, 1, 3, 6])))}{r.choice(['', '', '<sub>a</sub>'])}</td>"
    table = lambda: "<table>" + "".join("<tr>" + "".join(cell() for _ in range(r.randint(0, 4))) + "</tr>" for _ in range(r.randint(1, 5))) + "</table>"
    monkeypatch.setattr(t, "FEW_CELLS", 0)
    for _ in range(200):
        a, b = t.Tree(table()), t.Tree(table())
        assert t.plain_distance(a.rows(), b.rows()) == pytest.approx(t.any_distance(a, b))


def test_rows_of_other_trees_are_none():
    assert t.Tree("<table><tr><td>a<b>x</b></td></tr></table>").rows() == [[("1", "1", ("a", "<b>", "x", "</b>"))]]
    assert t.Tree("<table><tr></tr><tr><td>a</td></tr></table>").rows() == [[], [("1", "1", ("a",))]]
    for other in ("<table><caption>x</caption><tr><td>a</td></tr></table>", "<p>x</p>", "<table><thead><tr><td>a</td></tr></thead></table>"):
        assert t.Tree(other).rows() is None


def test_a_large_decorated_pair_is_quick():
    r = random.Random(8)
    table = lambda: html([["".join(r.choices("abcdefghij", k=8)) + "<sub>1</sub>" for _ in range(8)] for _ in range(100)])
    a, b = table(), table()
    began = time.perf_counter()
    assert 0 < t.tree_score(a, b) < 1
    print(time.perf_counter() - began)
    assert time.perf_counter() - began < 10


@given(st.lists(st.text("abcé", max_size=6), max_size=4), st.lists(st.text("abcé", max_size=6), max_size=4))
def test_edit_distances(a, b):
    assert edits.edit_distances(a, b).tolist() == [[edits.edit_distance(x, y) for y in b] for x in a]


@given(st.text("abcé", max_size=8), st.text("abcé", max_size=8))
def test_edit_distance(a, b):
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    assert edits.edit_distance(a, b) == d[-1][-1]
    for most in range(10):
        assert edits.edit_distance(a, b, most) == min(d[-1][-1], most + 1)


def test_long_edit_distances():
    """Beyond one word, one look and the tokens that are marked one by one; against the table of all prefixes."""
    import numpy as np

    r = random.Random(11)
    for _ in range(12):
        a, b = (r.choices("abc", k=r.randint(200, 700)) for _ in range(2))
        last, steps = np.arange(len(b) + 1), np.arange(len(b) + 1)
        for x in a:
            best = last + 1
            best[1:] = np.minimum(best[1:], last[:-1] + np.array([x != y for y in b]))
            last = np.minimum.accumulate(best - steps) + steps
        assert edits.edit_distance(a, b) == edits.edit_distances([a], [[], b, ["z"]])[0, 1] == last[-1]
        for most in (0, 100, int(last[-1]) - 1, int(last[-1]), 900):
            assert edits.edit_distance(a, b, most) == min(last[-1], most + 1)


def test_many_fields(monkeypatch):
    """More sequences than one integer takes."""
    r = random.Random(12)
    words = lambda n: ["".join(r.choices("ab", k=r.randint(0, 9))) for _ in range(n)]
    a, b = words(20), words(60)
    whole = edits.edit_distances(a, b)
    monkeypatch.setattr(edits, "MOST_BITS", 40)
    assert edits.edit_distances(a, b).tolist() == whole.tolist() == [[edits.edit_distance(x, y) for y in b] for x in a]


CELL = st.text("ab<&- \u00a0", max_size=4).map(lambda s: s.replace("<", "&lt;").replace("&l", "&amp;l") if "<" in s else s.replace("&", "&amp;"))
TABLE = st.lists(st.lists(CELL, min_size=1, max_size=3), min_size=1, max_size=4).map(html)


@settings(max_examples=60, deadline=None)
@given(TABLE, TABLE)
def test_properties(a, b):
    assert t.canonical(t.canonical(a)) == t.canonical(a)
    s = t.tree_score(t.canonical(a), t.canonical(b))
    assert 0 <= s <= 1
    assert math.isclose(s, t.tree_score(t.canonical(b), t.canonical(a)))
    assert t.tree_score(t.canonical(a), t.canonical(a)) == 1.0


PIECE = st.sampled_from(["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", '<td rowspan="2">', '<td colspan="2">', '<td rowspan="" colspan="3">', "a", " b\n", "é", "&amp;", "<b>", "<p>"])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(PIECE, max_size=12).map("".join), TABLE, st.lists(st.sampled_from(['<td rowspan="2">a</td>', "<td>b </td>", '<td colspan="0"></td>', "</tr><tr>"]), max_size=8).map(lambda x: f"<table><tr>{''.join(x)}</tr></table>")))
def test_plain_tables_need_no_parser(source):
    """The short way gives what the parser gives."""

    def outcome():
        try:
            rows = t.grid(source)
        except ValueError as e:
            rows = str(e)
        tree = t.Tree(source)
        return t.canonical(source), rows, tree.labels, tree.contents, tree.left, tree.size

    short = outcome()
    pattern, t.PLAIN = t.PLAIN, t.re.compile(r"(?!)")
    try:
        assert outcome() == short
    finally:
        t.PLAIN = pattern


SIMPLE_PIECE = st.sampled_from(["<table>", "</table>", "<TR>", "</tr>", "<td>", "</td>", '<th rowspan="2" class="a b">', '<span class="math-inline">', "</span>", "<p>", "</p>", "<br>", "<b>", "</b>", "text ", "\n", "é", '<td a="1" a="2">', "</x>", "<div>", '<td colspan="2" >', "</td x>", "<br/>"])


@settings(max_examples=400, deadline=None)
@given(st.lists(SIMPLE_PIECE, max_size=14).map("".join))
def test_simple_markup_needs_no_parser(source):
    from tablescore.functions import dom

    short = [dom.parse(source, repair).markup() for repair in (True, False)]
    pattern, dom.SIMPLE = dom.SIMPLE, t.re.compile(r"(?!)")
    try:
        assert [dom.parse(source, repair).markup() for repair in (True, False)] == short
    finally:
        dom.SIMPLE = pattern
