import random

from conftest import SMALL
from pyspark.sql import functions as F
from test_quick_tables import TEXTS, given

from tablescore.functions import tables as t
from tablescore.operators.scoring import canonical_html, simple_tree_score, tree_similarity, with_tree_score
from tablescore.plans.fixtures import html_pairs, scored_pairs
from tablescore.plans.queries import QUERIES


def html(rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


def changed(rng):
    """A table and one that differs a little, or not at all."""
    texts = ["", "a", "b c", " ", "12.0", "@" * 16, "abcd", "x" * 70] + ([*TEXTS, "é", "a  b"] if rng.random() < 0.2 else [])
    text = lambda: rng.choice(texts)
    x = [[text() for _ in range(rng.randrange(4))] for _ in range(rng.randrange(5))]
    y = [list(r) for r in x]
    for _ in range(rng.choice([0, 1, 1, 1, 2])):
        k = rng.randrange(len(y) + 1)
        if rng.random() < 0.4:
            y.insert(k, [text() for _ in range(rng.randrange(4))])
        elif k < len(y):
            if rng.random() < 0.5 or not y[k]:
                del y[k]
            elif rng.random() < 0.7:
                y[k][rng.randrange(len(y[k]))] = text()
            else:
                del y[k][-1]
    return html(x), html(y)


def pairs():
    rng = random.Random(11)
    rows = [changed(rng) for _ in range(1500)] + [(t.canonical(given(rng)), given(rng, 0.3)) for _ in range(300)]
    rows += [(html([["a"], ["b"]]), html([["a", "b"]])), (html([["ab"]]), "<table><tr><td>a</table>"), ("<table></table>",) * 2, ("<p>x</p>",) * 2, ("<table><tr></tr></table>",) * 2]
    rows += [(html([["a"]]) + "\n", html([["a"]])), (html([["1"] * 4] * 20_000), html([["1"] * 4] * 19_999)), (None, "x"), ("x", None), (None, None)]
    return [r for r in rows for r in (r, r[::-1])]


def test_simple_pairs_get_the_same_scores_from_spark(spark):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(pairs())], "k int, gt_html string, pred_html string").repartition(4)
    got = with_tree_score(df).withColumns({"want": tree_similarity("gt_html", canonical_html("pred_html")), "simple": simple_tree_score(F.col("gt_html"), F.col("pred_html"))}).collect()
    assert sum(r.simple is not None for r in got) > 1000
    assert [r.k for r in got if r.teds != r.want or r.simple not in (None, r.want)] == []


def test_only_other_pairs_go_to_python(spark):
    """Before: every pair of t4_tree_score did, twice."""
    p = html_pairs(spark, SMALL)
    left = p.where(simple_tree_score(F.col("gt_html"), F.col("pred_html")).isNull())
    assert {r.kind for r in left.select("kind").distinct().collect()} == {"decorated"}
    plan = QUERIES["t4_tree_score"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("given_tree_similarity") == 1 and "canonical_html" not in plan


def test_pairs_of_texts_are_the_scored_pairs(spark):
    a, b = scored_pairs(spark, SMALL).select("l_orderkey", "kind", "gt_html", "pred_html"), html_pairs(spark, SMALL)
    assert a.count() == b.count() and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_tables_alike_are_rewritten_alike(monkeypatch):
    """Before: each row of each table was looked up, and the end of each table read."""
    monkeypatch.setattr(t, "MOST_ROWS", 50)
    t.TABLES.clear()
    rng = random.Random(12)
    for odd in (0.0, 0.5):
        for x in [given(rng, odd) for _ in range(2000)]:
            for y in (x, x.replace("12.0", "7 %s"), x.replace("a", "b")):
                assert t.canonical_alike(y) == t.canonical(y)
    assert len(t.TABLES) <= 50
    read = []
    monkeypatch.setattr(t, "rewritten", lambda parts, open_, f=t.rewritten: read.append("".join(parts)) or f(parts, open_))
    table = lambda a: f'<table border="1"><tbody><tr><th><b>{a}</b></th><td rowspan="2"><em>1</em></td></tr></tbody></table>'
    assert [t.canonical_alike(table(x)) for x in ("a", "b c", "100%")] == [f'<table><tr><td>{x}</td><td rowspan="2">1</td></tr></table>' for x in ("a", "b c", "100%")]
    assert read == [table("a")]
