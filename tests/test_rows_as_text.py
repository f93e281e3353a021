import random

import pytest
from pyspark.sql import functions as F
from test_quick_tables import given

from tablescore.functions import tables as t
from tablescore.functions.align import content_score
from tablescore.operators.scoring import grid_of, text_score


def pairs():
    rng = random.Random(8)
    tables = [t.canonical(given(rng)) for _ in range(150)] + ["<table></table>", "<table><tr></tr></table>", "<p>x</p>", "<table><tr></tr></table><p>x</p>"]
    tables += ["<table>" + "".join(f"<tr><td>{k}</td><td>-</td></tr>" for k in range(a, b)) + "</table>" for a, b in ((0, 4), (1, 4), (0, 3), (0, 5), (2, 3))]
    return [(rng.choice(tables), rng.choice(tables)) for _ in range(400)] + [(a, b) for a in tables[-9:] for b in tables[-9:]]


def both(f, a, b):
    try:
        return f(a, b)
    except (ValueError, OverflowError) as e:
        return str(e)


def test_scores_of_texts(spark):
    """Grids as texts are the grids, and score like them."""
    rows = []
    for a, b in pairs():
        texts, grids = both(t.compared_texts, a, b), both(t.compared_grids, a, b)
        if isinstance(grids, str):
            assert texts == grids
        else:
            rows.append((*texts, *grids))
    df = spark.createDataFrame([*rows, (None, "", None, [])], "x string, y string, a array<array<string>>, b array<array<string>>")
    got = df.select("a", "b", grid_of(F.col("x")).alias("ga"), grid_of(F.col("y")).alias("gb"), text_score(F.col("x"), F.col("y")).alias("s"), content_score(F.col("a"), F.col("b")).alias("want")).collect()
    assert len(got) > 300 and all(r.ga == r.a and r.gb == r.b for r in got)
    assert all(r.s == (None if r.want is None else pytest.approx(r.want, abs=1e-12)) for r in got)


def test_equal_grids_are_read_once(monkeypatch):
    """Before: the second of two equal tables was cleaned like the first."""
    read = []
    monkeypatch.setattr(t, "plain_lines", lambda x, f=t.plain_lines: read.append(x) or f(x))
    table = "<table><tr><td>a b</td><td>-1</td></tr></table>"
    assert t.compared_texts(table, table) == ("\n ab 1",) * 2 and read == [table]
