"""Content score of two grids as one native column expression.

Two sequences are aligned with free gaps at their ends: the first row and column of the score table
are 0, and the result is the best value of its last row and column. Cells align within a pair of
rows with gap 1, rows align with gap 3 and a bonus of 5 for each pair. Only the previous row of the
table is held, in an array that a fold carries along; no Python and no shuffle are involved. Of two
grids only those pairs of rows are compared that can be in a better alignment than one diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

CELL_GAP, ROW_GAP, ROW_BONUS = 1.0, 3.0, 5.0
#: The value of a match that no best alignment takes.
NEVER = -1e9


def cell_similarity(a: Column, b: Column) -> Column:
    """1 for equal cells, else from -1 to 1 by their edit distance in code points; -1 for a null."""
    share = F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    return F.when(a.isNull() | b.isNull(), -1.0).when(a == b, 1.0).otherwise(-1.0 + 2.0 * (1.0 - share))


def running_max(values: Column, shifts: Column) -> Column:
    """The greatest value up to each place: each step looks twice as far back as the one before."""
    return F.aggregate(shifts, values, lambda done, d: F.transform(done, lambda x, j: F.greatest(x, F.get(done, j - d))))


def best_alignment(matches: Column, gap: float) -> Column:
    """Best semi-global alignment over a matrix of match values: one array for each element of the first sequence.

    A gap in the first sequence costs the same wherever it is, so with gap times column added, what a cell gets from
    its left is the running maximum of what the cells get from above; no cell is appended to a line.
    """

    def next_row(state: Column, row: Column) -> Column:
        above, shifts = state["above"], state["shifts"]
        reached = F.transform(row, lambda m, j: F.greatest(F.get(above, j) + m, F.get(above, j + 1) - gap) + gap * (j + 1))
        lifted = let(F.concat(F.array(F.lit(0.0)), reached), lambda v: F.transform(running_max(v, shifts), lambda x, j: x - gap * j))
        return let(lifted, lambda new: F.struct(new.alias("above"), F.greatest(state["best"], F.element_at(new, -1)).alias("best"), shifts.alias("shifts")))

    def folded(m: Column) -> Column:
        width = F.coalesce(F.size(F.get(m, F.lit(0))), F.lit(0))
        steps = F.greatest(F.ceil(F.log2(width + 1.0)).cast("int") - 1, F.lit(0))
        shifts = F.transform(F.sequence(F.lit(0), steps), lambda k: F.pow(F.lit(2.0), k).cast("int"))
        start = F.struct(F.array_repeat(F.lit(0.0), width + 1).alias("above"), F.lit(0.0).alias("best"), shifts.alias("shifts"))
        return F.aggregate(m, start, next_row, lambda s: F.greatest(s["best"], F.array_max(s["above"])))

    return let(matches, folded)


def row_alignment(a: Column, b: Column) -> Column:
    """Best alignment of two rows of cells; equal rows match in every cell, which nothing can exceed.

    Of two rows of k cells any alignment but that of each cell with its counterpart has k - 1 pairs at most, and but those
    moved by one cell k - 2, as pairs or as pairs less a gap. So one of these three is the best if it has that much.
    """
    n = F.size(a)
    total = lambda x, y: F.aggregate(F.zip_with(x, y, cell_similarity), F.lit(0.0), lambda s, v: s + v)
    moved = lambda x, y: total(F.slice(x, F.lit(2), n - 1), F.slice(y, F.lit(1), n - 1))
    near = let(total(a, b), lambda d: F.when(d >= n - 1, d).otherwise(let(F.greatest(d, moved(a, b), moved(b, a)), lambda v: F.when(v >= n - 2, v))))
    every = best_alignment(F.transform(a, lambda x: F.transform(b, lambda y: cell_similarity(x, y))), CELL_GAP)
    return F.when(a == b, n.cast("double")).otherwise(F.coalesce(F.when((n > 0) & (n == F.size(b)), near), every))


def row_matches(a: Column, b: Column, band: tuple[Column, Column] | None = None) -> Column:
    """Match values of all pairs of rows of two grids, with the row bonus. Where rows repeat, each distinct pair is
    aligned once and the others look its value up by the places of their rows among the distinct ones. With a band, pairs
    whose places differ by less or more than it says may count as NEVER."""

    def every(x: Column, y: Column, band: tuple[Column, Column] | None = None) -> Column:
        value = lambda r, s: ROW_BONUS + row_alignment(r, s)
        if band is None:
            return F.transform(x, lambda r: F.transform(y, lambda s: value(r, s)))
        return F.transform(x, lambda r, i: F.transform(y, lambda s, j: F.when((j - i).between(*band), value(r, s)).otherwise(NEVER)))

    def looked_up(p: Column) -> Column:
        place = lambda rows, distinct: F.transform(rows, lambda r: (F.array_position(distinct, r) - 1).cast("int"))
        known = F.struct(every(p["x"], p["y"]).alias("m"), place(p["b"], p["y"]).alias("at"), place(p["a"], p["x"]).alias("of"))
        return let(known, lambda k: F.transform(k["of"], lambda i: let(F.get(k["m"], i), lambda line: F.transform(k["at"], lambda j: F.get(line, j)))))

    def picked(p: Column) -> Column:
        repeats = (F.size(p["x"]) < F.size(p["a"])) | (F.size(p["y"]) < F.size(p["b"]))
        return F.when(repeats, looked_up(p)).otherwise(every(p["a"], p["b"], band))

    return let(F.struct(a.alias("a"), b.alias("b"), F.array_distinct(a).alias("x"), F.array_distinct(b).alias("y")), picked)


def rows_alignment(a: Column, b: Column) -> Column:
    """best_alignment() of the rows of two grids; most of their pairs are not compared.

    A row gets at most its bonus and its number of cells. One of the two diagonals, from the first or to the last rows, is
    summed up, the one with more equal rows. What it lacks to the most that the grid with fewer rows could get bounds
    all others: an alignment that leaves the strip between both diagonals by e places leaves out e of these rows. Where
    nothing can have more, the sum is the result, else what lies in the strip or near enough is compared. Equal grids get the most.
    """
    most_of = lambda row: ROW_BONUS + F.greatest(F.coalesce(F.size(row), F.lit(0)), F.lit(0))

    def bounds(p: Column) -> Column:
        n, m = F.size(p["a"]), F.size(p["b"])
        k = F.least(n, m)
        fewer = F.transform(F.when(n <= m, p["a"]).otherwise(p["b"]), most_of)
        firsts, lasts = ([F.slice(g, at, k) for g, at in zip((p["a"], p["b"]), ats, strict=True)] for ats in ((F.lit(1), F.lit(1)), (n - k + 1, m - k + 1)))
        equal = lambda d: F.aggregate(F.zip_with(*d, lambda r, s: F.coalesce((r == s).cast("int"), F.lit(0))), F.lit(0), lambda x, y: x + y)
        best = F.when((n == m) | (equal(firsts) >= equal(lasts)), F.struct(firsts[0].alias("x"), firsts[1].alias("y"))).otherwise(F.struct(lasts[0].alias("x"), lasts[1].alias("y")))
        diagonal = let(best, lambda d: F.aggregate(F.zip_with(d["x"], d["y"], lambda r, s: F.when(r.isNotNull() & s.isNotNull(), ROW_BONUS + row_alignment(r, s))), F.lit(0.0), lambda x, y: x + y))
        most = F.aggregate(fewer, F.lit(0.0), lambda x, y: x + y)
        return F.struct(p["a"].alias("a"), p["b"].alias("b"), (m - n).alias("off"), F.coalesce(diagonal, F.lit(NEVER)).alias("diagonal"), most.alias("most"), F.array_min(fewer).alias("row"))

    def scored(p: Column) -> Column:
        lacks = p["most"] - p["diagonal"]
        beyond = F.floor(lacks / p["row"]).cast("int")
        band = F.least(p["off"], F.lit(0)) - beyond, F.greatest(p["off"], F.lit(0)) + beyond
        return F.when(lacks <= F.when(p["off"] == 0, p["row"]).otherwise(0.0), p["diagonal"]).otherwise(F.greatest(p["diagonal"], best_alignment(row_matches(p["a"], p["b"], band), ROW_GAP)))

    def unequal(p: Column) -> Column:
        most = F.aggregate(p["a"], F.lit(0.0), lambda s, r: s + F.when(r.isNotNull(), most_of(r)))
        alike = F.when(p["a"] == p["b"], most)  # null with a null row, which matches nothing
        return F.when(p["a"].isNotNull() & p["b"].isNotNull(), F.when((F.size(p["a"]) == 0) | (F.size(p["b"]) == 0), 0.0).otherwise(F.coalesce(alike, let(bounds(p), scored))))

    return let(F.struct(a.alias("a"), b.alias("b")), unequal)


def padded(grid: Column, width: Column) -> Column:
    """Rows filled up with blanks to the width."""
    filled = F.transform(grid, lambda r: F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))))
    return F.when(F.forall(grid, lambda r: F.size(r) == width), grid).otherwise(filled)


def width_of(grid: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(grid, lambda r: F.size(r))), F.lit(0))


def content_score(a: Column, b: Column) -> Column:
    """Score from 0 to 1 of two grids of cells that are ready to be compared; 0 if one has no row."""

    def scored(p: Column) -> Column:
        x, y, width = p["x"], p["y"], p["width"]
        top = F.greatest(F.size(x), F.size(y)) * (ROW_BONUS + width)
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), rows_alignment(x, y) / top))
        return F.when((F.size(x) == 0) | (F.size(y) == 0) | (width == 0), 0.0).when(x == y, 1.0).otherwise(score)

    def filled(p: Column) -> Column:
        width = F.greatest(width_of(p["a"]), width_of(p["b"]))
        return let(width, lambda w: F.struct(padded(p["a"], w).alias("x"), padded(p["b"], w).alias("y"), w.alias("width")))

    # a and b stand outside all lambdas, as they may come from Python, which Spark cannot run inside one.
    return F.when(a.isNotNull() & b.isNotNull(), let(let(F.struct(a.alias("a"), b.alias("b")), filled), scored))


def floor_score(rows_a: Column, rows_b: Column, width: Column) -> Column:
    """What two grids of these sizes get at least."""
    return F.least(rows_a, rows_b) * ROW_BONUS / (F.greatest(rows_a, rows_b) * (ROW_BONUS + width))
