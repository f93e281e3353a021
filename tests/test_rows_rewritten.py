import random

from test_quick_tables import given

from tablescore.functions import tables as t


def test_rows_are_rewritten_like_those_before_them(monkeypatch):
    """Before: every tag of every row was looked at."""
    table = lambda a, b: f'<table border="1"><thead><tr><th colspan="1"><b>{a}</b><span class="math-inline"> </span></th></tr></thead><tbody><tr id="r"><td rowspan="2"><em>{b}</em><tsv>0</tsv></td></tr></tbody></table>'
    want = lambda a, b: f'<table><tr><td>{a} </td></tr><tr><td rowspan="2">{b}</td></tr></table>'.replace(" </td>", "</td>")
    assert t.canonical(table("x", "%s 1")) == want("x", "%s 1")
    read = []
    monkeypatch.setattr(t, "rewritten", lambda parts, open_, f=t.rewritten: read.append("".join(parts)) or f(parts, open_))
    assert t.canonical(table("100%", "z")) == want("100%", "z")
    assert read == ["</tbody></table>"]
    # A blank in another place is another row, and what needs repair goes to the parser.
    assert t.canonical(table("y", " ")) == '<table><tr><td>y</td></tr><tr><td rowspan="2"> </td></tr></table>' and len(read) == 3
    assert t.canonical(table("y", "z").replace("</em>", "")) == want("y", "z")


def test_few_rows_are_remembered(monkeypatch):
    monkeypatch.setattr(t, "MOST_ROWS", 3)
    rng = random.Random(7)
    tables = [given(rng, 0.2) for _ in range(300)]
    found = [t.canonical(x) for x in tables]
    assert len(t.ROWS) <= 3
    monkeypatch.setattr(t, "quick_canonical", lambda x: None)
    assert [t.canonical(x) for x in tables] == found


def test_equal_grids_get_the_most(spark):
    """Nulls and blank rows among them; results only, as before."""
    from pyspark.sql import functions as F

    from tablescore.functions.align import rows_alignment

    df = spark.createDataFrame([([["a", None], ["b"], []],), ([["a"], None],), ([None],), (None,), ([],), ([["a"]] * 3,)], "g array<array<string>>")
    assert [r[0] for r in df.select(rows_alignment(F.col("g"), F.col("g"))).collect()] == [18.0, 5.0, 0.0, None, 0.0, 18.0]
