import random
import time

import pytest
from pyspark.sql import functions as F

from tablescore.functions.align import CELL_GAP, ROW_GAP, best_alignment, cell_similarity, content_score, row_alignment, row_matches, rows_alignment

CELLS = ["a", "b", "ab", "abc", "", "12.0", "13.0", None]


def grids(seed, few, count=400):
    rng = random.Random(seed)
    cells = CELLS[:3] if few else CELLS
    out = []
    for k in range(count):
        width = rng.randrange(1, 5)
        row = lambda: None if not few and rng.random() < 0.02 else [rng.choice(cells) for _ in range(width if rng.random() < 0.9 else rng.randrange(5))]  # noqa: E731, B023
        a = [row() for _ in range(rng.randrange(8))]
        b = [r if rng.random() < 0.8 else row() for r in a]
        if rng.random() < 0.6:
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(3)] = [row() for _ in range(rng.randrange(3))]
        if rng.random() < 0.2:
            b = [row() for _ in range(rng.randrange(8))]
        out.append((k, a, b))
    return out


@pytest.mark.parametrize("few", [True, False])
def test_pairs_that_cannot_matter_are_left_out(spark, few):
    df = spark.createDataFrame(grids(few, few), "k int, a array<array<string>>, b array<array<string>>")
    rows = df.select("k", best_alignment(row_matches(df.a, df.b), ROW_GAP).alias("want"), rows_alignment(df.a, df.b).alias("got"), rows_alignment(df.b, df.a).alias("back"), best_alignment(row_matches(df.b, df.a), ROW_GAP).alias("back_want")).collect()
    assert len(rows) == 400 and all(r.got == pytest.approx(r.want) and r.back == pytest.approx(r.back_want) for r in rows)


def test_rows_are_aligned_near_the_diagonal(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(600):
        a = [rng.choice(CELLS) for _ in range(rng.randrange(6))]
        b = [c if rng.random() < 0.7 else rng.choice(CELLS) for c in a]
        if rng.random() < 0.4 and b:
            del b[rng.randrange(len(b))]
            b.insert(rng.randrange(len(b) + 1), rng.choice(CELLS))
        rows.append((a, b if rng.random() < 0.8 else b[1:]))
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    every = best_alignment(F.transform("a", lambda x: F.transform("b", lambda y: cell_similarity(x, y))), CELL_GAP)
    got = df.select("a", "b", every.alias("want"), row_alignment(df.a, df.b).alias("got")).collect()
    assert len(got) == 600 and all(r.got == pytest.approx(r.want) for r in got if r.a != r.b)


def test_null_grids(spark):
    df = spark.createDataFrame([(None, [["a"]]), ([["a"]], None)], "a array<array<string>>, b array<array<string>>")
    assert [tuple(r) for r in df.select(rows_alignment(df.a, df.b), content_score(df.a, df.b)).collect()] == [(None, None)] * 2


def test_alike_grids_take_time_in_proportion_to_their_rows(spark):
    """Before: every pair of rows was aligned, 90,000 for each of these grids."""
    grid = [[str(i * 7 + j) for j in range(5)] for i in range(300)]
    changes = [grid, grid[1:], grid[:-1], [*grid, ["x"] * 5], [["x", *grid[0][1:]], *grid[1:]], [[*r[:4], ""] for r in grid[:9]] + grid[9:]]
    df = spark.createDataFrame([(grid, b) for b in changes], "a array<array<string>>, b array<array<string>>").coalesce(1)
    scored = df.select(rows_alignment(df.a, df.b).alias("s"))
    began = time.time()
    got = [r.s for r in scored.collect()]
    assert got[:4] == [3000.0, 2990.0, 2990.0, 3000.0] and got[4] == pytest.approx(2998.0) and time.time() - began < 6
