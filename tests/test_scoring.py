import random
import time

import pytest
from pyspark.sql import functions as F
from test_tables import EX1, EX2, html

from tablescore.functions.align import best_alignment, content_score, row_alignment
from tablescore.functions.edits import edit_distance
from tablescore.functions.tables import compared
from tablescore.operators.scoring import align_rows, aligned, by_cost, canonical_html, comparable, row_alignment_score, row_pairs, score_tables


def semi_global(n, m, match, gap):
    d = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = max(d[i - 1][j - 1] + match(i - 1, j - 1), d[i - 1][j] - gap, d[i][j - 1] - gap)
    return max(d[n] + [r[m] for r in d])


def like(x, y):
    return 1.0 if x == y else -1 + 2 * (1 - edit_distance(x, y) / max(len(x), len(y)))


def brute(a, b):
    if not a or not b:
        return 0.0
    w = max(map(len, a + b))
    a, b = ([[compared(c) for c in r] + [""] * (w - len(r)) for r in g] for g in (a, b))
    inner = lambda i, j: 5 + semi_global(w, w, lambda x, y: like(a[i][x], b[j][y]), 1)
    return max(0.0, min(1.0, semi_global(len(a), len(b), inner, 3) / (max(len(a), len(b)) * (5 + w))))


def random_grid(r):
    w = r.randint(1, 4)
    return [["".join(r.choices("ab- é", k=r.randint(0, 4))) for _ in range(w)] for _ in range(r.randint(1, 4))]


@pytest.fixture(scope="module")
def pairs():
    r = random.Random(3)
    return [(random_grid(r), random_grid(r)) for _ in range(60)]


def test_content_score_equals_brute_force(spark, pairs):
    ready = [(k, [[compared(c) for c in x] for x in a], [[compared(c) for c in x] for x in b]) for k, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(ready, "k int, a array<array<string>>, b array<array<string>>")
    got = {r.k: (r.s, r.z) for r in df.select("k", content_score(F.col("a"), F.col("b")).alias("s"), content_score(F.col("b"), F.col("a")).alias("z")).collect()}
    for k, (a, b) in enumerate(pairs):
        assert got[k][0] == pytest.approx(brute(a, b), abs=1e-9)
        assert got[k][1] == pytest.approx(got[k][0], abs=1e-9)


def test_rows_that_repeat_are_scored_alike(spark, pairs):
    """Every pair of rows, with and without repeats, and the alignment of all rows."""
    ready = [(k, [[compared(c) for c in x] for x in a * (1 + k % 3)], [[compared(c) for c in x] for x in b * (1 + k % 2)]) for k, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame([*ready, (-1, [], [["a"]]), (-2, [["a"]], [])], "k int, a array<array<string>>, b array<array<string>>")
    rows = {k: (a, b) for k, a, b in ready}
    match = lambda x, y: 5 + semi_global(len(x), len(y), lambda i, j: like(x[i], y[j]), 1)
    got = {(r.k, r.i, r.j): r.match for r in row_pairs(df, ["k"], "a", "b").collect()}
    assert set(got) == {(k, i, j) for k, (a, b) in rows.items() for i in range(len(a)) for j in range(len(b))}
    for (k, i, j), value in got.items():
        assert value == pytest.approx(match(rows[k][0][i], rows[k][1][j]), abs=1e-9)
    best = {r.k: r.best for r in row_alignment_score(df, ["k"], "a", "b").collect()}
    for k, (a, b) in rows.items():
        assert best[k] == pytest.approx(semi_global(len(a), len(b), lambda i, j, a=a, b=b: match(a[i], b[j]), 3), abs=1e-9)
    assert best[-1] == best[-2] == 0


def test_row_pairs_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, [["a"]], [["b"]])], "k int, a array<array<string>>, b array<array<string>>")
    for x in (row_pairs(df, ["k"], "a", "b"), row_alignment_score(df, ["k"], "a", "b")):
        assert "Exchange" not in x._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n, m", [(1, 1), (1, 9), (9, 1), (17, 33), (64, 64)])
def test_alignment_of_any_width(spark, n, m):
    r = random.Random(n * 100 + m)
    values = [[r.randint(-8, 8) / 4 for _ in range(m)] for _ in range(n)]
    df = spark.createDataFrame([(values,)], "m array<array<double>>")
    for gap in (1.0, 3.0):
        assert df.select(best_alignment(F.col("m"), gap)).first()[0] == pytest.approx(semi_global(n, m, lambda i, j: values[i][j], gap), abs=1e-9)


def test_a_wide_alignment_is_quick(spark):
    n = F.sequence(F.lit(1), F.lit(200))
    df = spark.range(1).select(F.transform(n, lambda i: F.transform(n, lambda j: (i * 7 + j * 13) % 17 / 8.0 - 1)).alias("m"))
    began = time.perf_counter()
    assert df.select(best_alignment(F.col("m"), 1.0)).first()[0] > 0
    assert time.perf_counter() - began < 10


def test_html_scores(spark, pairs):
    df = spark.createDataFrame([(k, html(a), html(b)) for k, (a, b) in enumerate(pairs)], "k int, gt_html string, pred_html string")
    for r in by_cost(score_tables(df, metrics=("levenshtein", "teds", "unknown")), 3).collect():
        assert r.scores.levenshtein == pytest.approx(brute(*pairs[r.k]), abs=1e-9)
        assert 0 <= r.scores.teds <= 1


def test_published_and_edge_scores(spark):
    cases = [
        ("ex1", html(EX1), html([[" ".join(r)] for r in EX1]), 20 / 36, 0.261536),
        ("ex2", html(EX2[0]), html(EX2[1]), 0.71875, 0.503348),
        ("empty", "<table></table>", "<table></table>", 0.0, 0.0),
        ("error text", html([["a"]]), "ERROR: x", 0.0, 0.0),
        ("hyphen", html([["-5", "a b"]]), html([["5", "ab"]]), 1.0, 1 - (1 / 2 + 1 / 3) / 3),
        ("ragged", html([["a"]]), "<table><tr></tr></table><p>x</p>", 0.0, 1 - 1 / 2),
        ("infinite", html([["a"]]), '<table><tr><td colspan="inf">a</td></tr></table>', 0.0, 0.5),
        ("no prediction", html([["a"]]), None, None, None),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "k string, gt_html string, pred_html string")
    got = {r.k: r for r in score_tables(df, metrics=("levenshtein", "teds")).collect()}
    for k, _, _, content, tree in cases:
        s = got[k].scores
        assert (s.levenshtein, s.teds) == (pytest.approx(content, abs=1e-6), pytest.approx(tree, abs=1e-6)) if content is not None else (s.levenshtein, s.teds) == (None, None), k
    assert got["ragged"].score_error and got["no prediction"].score_error


def test_only_what_is_asked_for(spark):
    df = spark.createDataFrame([(html([["a"]]), html([["a"]]))], "gt_html string, pred_html string")
    assert tuple(score_tables(df).first().scores) == (1.0, None)
    assert tuple(score_tables(df, metrics=("teds",)).first().scores) == (None, 1.0)


def test_one_python_stage_and_no_shuffle(spark):
    df = spark.createDataFrame([(html([["a"]]), html([["a"]]))], "gt_html string, pred_html string")
    plan = score_tables(df, metrics=("levenshtein", "teds"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_alignment_trace(spark):
    r = random.Random(4)
    rows = [(["".join(r.choices("ab", k=r.randint(1, 3))) for _ in range(r.randint(1, 4))], ["".join(r.choices("ab", k=r.randint(1, 3))) for _ in range(r.randint(1, 4))]) for _ in range(50)]
    for a, b in rows:
        x, y, s = aligned(a, b)
        own, other = [c for c in x if c is not None], [c for c in y if c is not None]
        assert own == a[: len(own)] and other == b[: len(other)] and len(x) == len(y) and (own == a or other == b)
        assert s == pytest.approx(semi_global(len(a), len(b), lambda i, j: like(a[i], b[j]), 1))
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for row in df.select(align_rows("a", "b").alias("t"), row_alignment(F.col("a"), F.col("b")).alias("s")).collect():
        assert row.t.score == pytest.approx(row.s)


def test_alignment_trace_ties():
    assert aligned(["a", "b"], ["a", "q"]) == (["a", "b"], ["a", "q"], 0.0)
    assert aligned(["a", "b"], ["b"]) == (["a", "b"], [None, "b"], 1.0)
    assert aligned(["b"], ["b", "x"]) == (["b"], ["b"], 1.0)
    assert aligned(["a"], ["b"]) == (["a"], [None], 0.0) or aligned(["a"], ["b"])[2] <= 0


def test_no_markup_stops_the_job(spark):
    """Depth and breadth of a hundred thousand elements, and what no parser takes, cost a row its score at most."""
    n = 100_000
    deep = ["<div>" * n, "<table><tr><td>" + "<i>" * n + "x", "<table>" + "<div>" * n + "<tr><td>x", "<table><tr><td>" + "<b>y</b>" * n, "<i>" * n + "</b>" * n, "<table><tr><td>" + '<span class="math-inline">' * 2_000 + "z", "<![bad", "<table><tr><td>" + "<section>" * 2_000 + "x"]
    df = spark.createDataFrame([(html([["a"]]), x) for x in deep], "gt_html string, pred_html string")
    rows = score_tables(df, metrics=("levenshtein", "teds")).collect()
    assert len(rows) == len(deep) and all(0 <= r.scores.teds <= 1 and 0 <= r.scores.levenshtein <= 1 for r in rows)
    assert df.select(canonical_html("pred_html")).where("length(`canonical_html(pred_html)`) > 0").count() >= len(deep) - 1


def test_comparable(spark):
    df = spark.createDataFrame([("&amp;-x y",), (None,)], "c string")
    assert [r[0] for r in df.select(comparable("c")).collect()] == ["&xy", ""]


def test_metrics_by_registration(spark):
    from tablescore.operators import scoring

    df = spark.createDataFrame([(html([["a", "b"], ["c", "d"]]), html([["a", "x"], ["c", "d"], ["e", "f"]])), (html([["a"]]), "no table"), (html([["a"]]), None)], "gt_html string, pred_html string")
    score_tables(df, metrics=("levenshtein", "agreement_of_test"))
    scoring.register_metric("agreement_of_test", scoring.cell_agreement)
    try:
        rows = score_tables(df, metrics=("agreement_of_test",)).select("scores.*").collect()
    finally:
        del scoring.METRICS["agreement_of_test"]
    assert [tuple(r) for r in rows] == [(None, None, 0.5), (None, None, 0.0), (None, None, None)]


def test_rows_of_tables_by_a_lateral_join(spark):
    from tablescore.operators.rows import register, table_rows

    df = spark.createDataFrame([(1, html([["a", "b"], ["c"]])), (2, None), (3, "no table"), (4, '<table><tr><td colspan="inf">x</td></tr></table>')], "k int, h string")
    assert [tuple(r)[::2] for r in table_rows(df, "h").orderBy("row_index").collect()] == [(1, 0), (1, 1)]
    assert [r.cells for r in table_rows(df, "h").orderBy("row_index").collect()] == [["a", "b"], ["c", ""]]
    register(spark)
    assert spark.sql("select k, count(*) from {d} d, lateral table_rows(d.h) group by k", d=df).collect() == [(1, 2)]
