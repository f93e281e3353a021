import random
import re
import sys
import time

import pytest

from tablescore.functions import tables as t

TEXTS = ["", "a", "b c", " ", "-x- \xa0y", "\x1c", "12.0"]


def given(rng, odd=0.0):
    """A table as models write it; some need repair."""
    text = lambda: rng.choice(TEXTS)

    def inline(depth):
        if depth == 0 or rng.random() < 0.4:
            return text()
        tag = rng.choice(['b', 'i', 'strong', 'em', 'span', 'span class="math-inline"', 'span class="x math-inline"', 'tsv', 'SPAN CLASS="math-inline" id="1"'])
        return "".join(inline(depth - 1) for _ in range(rng.randrange(3))).join((f"<{tag}>", f"</{tag.split()[0]}>")) + text()

    def row():
        cells = ((rng.choice(["td", "th"]), rng.choice(["", ' rowspan="1"', ' rowspan="2"', ' colspan="3" rowspan="2"', ' style="q"', ' colspan=""', ' rowspan="2" rowspan="3"'])) for _ in range(rng.randrange(4)))
        return f"<tr{rng.choice(['', ' id="r"', ' rowspan="4"'])}>" + "".join(f"<{c}{a}>{inline(3)}</{c}>" for c, a in cells) + "</tr>"

    parts = [row() if rng.random() < 0.7 else "".join(row() for _ in range(rng.randrange(3))).join(rng.choice([("<thead>", "</thead>"), ("<TBODY>", "</TBODY>")])) for _ in range(rng.randrange(4))]
    s = f"<table{rng.choice(['', ' border="1"', ' rowspan="2"'])}>" + "".join(parts) + "</table>"
    while rng.random() < odd:
        k = rng.randrange(len(s))
        s = s[:k] + rng.choice(["", "<", ">", "&amp;", "</td>", "<p>", "<td>", "x", "<br>", "</table>", "<!-- c -->"]) + s[k + rng.randrange(3) :]
    return s


def grown(rng, depth=2):
    kids = []
    for _ in range(rng.randrange(4)):
        kind = rng.random()
        row = lambda: "<tr>" + "".join(f"<td{rng.choice(['', '', ' rowspan="2"'])}>{rng.choice(TEXTS[:4])}</td>" for _ in range(rng.randrange(4))) + "</tr>"
        kids.append(row() if kind < 0.6 else "<caption>c</caption>" if kind < 0.7 else "<colgroup><col></col><col></colgroup>" if kind < 0.8 or not depth else f"<tr><td>a</td>{grown(rng, depth - 1)}</tr>" if kind < 0.9 else f"<tbody>{row()}</tbody>")
    return "<table>" + "".join(kids) + "</table>"


def test_white_space_is_the_same_by_pattern_and_by_split():
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    assert t.WHITE.sub("", every) == "".join(every.split())


@pytest.mark.parametrize("odd", [0.0, 0.5])
def test_canonical_without_a_tree(odd, monkeypatch):
    rng = random.Random(odd)
    tables = [given(rng, odd) for _ in range(4000)]
    found, quick = [t.canonical(x) for x in tables], sum(t.quick_canonical(x) is not None for x in tables)
    monkeypatch.setattr(t, "quick_canonical", lambda x: None)
    assert [t.canonical(x) for x in tables] == found
    assert quick > (1000 if odd else 3900)


def test_trees_without_a_parser(monkeypatch):
    rng = random.Random(2)
    tables = [grown(rng) for _ in range(2000)] + [given(rng, 0.3) for _ in range(1000)]
    tree = lambda x: (lambda y: (y.labels, y.contents, y.left, y.size))(t.Tree(x))
    found = [tree(x) for x in tables]
    monkeypatch.setattr(t.Tree, "grown", lambda self, x: False)
    assert [tree(x) for x in tables] == found


def test_equal_subtrees_may_be_left_out():
    rng = random.Random(3)
    for _ in range(1500):
        kids = [grown(rng)[7:-8] for _ in range(rng.randrange(1, 4))]
        a = "<table>" + "".join(kids) + "</table>"
        kids[rng.randrange(len(kids))] = grown(rng)[7:-8] if rng.random() < 0.7 else ""
        b = "<table>" + "".join(kids) + "</table>"
        x, y = t.Tree(a), t.Tree(b)
        assert t.distance(x, y) == pytest.approx(t.any_distance(x, y))
        if "<tr>" in a and "<tr>" in b and t.is_plain(a) and t.is_plain(b):
            assert t.plain_source_distance(a, b) == pytest.approx(t.any_distance(x, y))


def test_plain_grids_are_compared_at_once(monkeypatch):
    rng = random.Random(4)
    tables = [t.canonical(given(rng)) for _ in range(300)] + [t.canonical(re.sub(r' (row|col)span="[^"]*"', "", given(rng))) for _ in range(600)] + ["<table></table>", "<table><tr></tr></table>"]

    def grids(a, b):
        try:
            return t.compared_grids(a, b)
        except ValueError as e:
            return str(e)

    pairs = [(rng.choice(tables), rng.choice(tables)) for _ in range(3000)]
    found = [grids(*p) for p in pairs]
    assert sum(t.plain_compared(a) is not None and t.plain_compared(b) is not None for a, b in pairs) > 300
    monkeypatch.setattr(t, "plain_compared", lambda x: None)
    assert [grids(*p) for p in pairs] == found


def test_other_trees_take_time_in_proportion_to_what_differs():
    """Before: some 10 ms a pair."""
    row = "<tr>" + "".join(f"<td>{k}.0</td>" for k in range(4)) + "</tr>"
    tables = ["<table><caption>c</caption>" + row.replace("0.0", str(k)) * 8 + end for k in range(100) for end in ("</table>", "<tr><table></table></tr></table>")]
    began = time.process_time()
    assert all(t.tree_score(a, b) == 1 - 2 / 43 for a, b in zip(tables[::2], tables[1::2], strict=True))
    assert time.process_time() - began < 0.2


def test_several_plain_tables_are_read_without_a_parser(monkeypatch):
    rng = random.Random(6)
    tables = ["".join(t.canonical(given(rng)) for _ in range(rng.randrange(1, 4))) for _ in range(600)]
    found, plain = [t.grid(x) for x in tables], sum(t.PLAIN_TABLES.fullmatch(x) is not None for x in tables)
    monkeypatch.setattr(t, "PLAIN_TABLES", re.compile("(?!)"))
    assert [t.grid(x) for x in tables] == found and plain > 100


def test_table_function_takes_many_texts_at_once(spark):
    """With Arrow each text is a batch of its own."""
    from pyspark.util import PythonEvalType

    from tablescore.operators.rows import TableRows, table_rows

    assert TableRows.evalType == PythonEvalType.SQL_TABLE_UDF
    df = spark.range(300).selectExpr("id", "if(id % 3 = 0, null, concat('<table><tr><td colspan=\"2\">', id, '</td></tr></table><table><tr><td>x</td></tr></table>')) as html")
    got = {(r.id, r.row_index): r.cells for r in table_rows(df, "html").collect()}
    assert got == {(k, i): [[str(k)] * 2, ["x", ""]][i] for k in range(300) if k % 3 for i in (0, 1)}
