"""Scoring of prediction against truth, both as HTML, over any number of pairs at once."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.align import content_score, row_matches, rows_alignment
from ..functions.edits import edit_distance
from ..functions.tables import CELL_MARK, ROW_MARK, canonical, canonical_alike, compared, compared_texts, grid, tree_score
from ..functions.text import let

GRID = T.ArrayType(T.ArrayType(T.StringType()))
#: Grids as compared_texts() gives them: columns of strings are passed on at a fraction of the cost of nested lists.
PREPARED = T.StructType([T.StructField("truth", T.StringType()), T.StructField("guess", T.StringType()), T.StructField("teds", T.DoubleType()), T.StructField("error", T.StringType()), T.StructField("seconds", T.DoubleType())])
#: What a row's markup can raise: it costs that row its score, never the job.
FAILURES = (ValueError, ArithmeticError, RecursionError, AssertionError, AttributeError, IndexError, KeyError, TypeError, MemoryError)


@F.pandas_udf(T.StringType())
def canonical_html(html: pd.Series) -> pd.Series:
    """Canonical form of each table; null stays null, and what cannot be parsed is null."""

    def one(x: str) -> str | None:
        try:
            return canonical(x)
        except FAILURES:
            return None

    return html.map(one, na_action="ignore").astype(object)


@F.pandas_udf(GRID)
def html_grid(html: pd.Series) -> pd.Series:
    """Span-expanded rows of each HTML text; null if it has none that can be built."""

    def one(x: str | None) -> list | None:
        if x is None:
            return None
        try:
            return grid(x)
        except FAILURES:
            return None

    return html.map(one)


@F.pandas_udf(T.StringType())
def comparable(cell: pd.Series) -> pd.Series:
    """A cell as it is compared, character references resolved; null as empty."""
    return cell.map(lambda x: compared(x) if isinstance(x, str) else "")


@F.pandas_udf(T.DoubleType())
def tree_similarity(truth: pd.Series, guess: pd.Series) -> pd.Series:
    """Tree score of two canonical HTML texts; 0 where it cannot be computed."""

    def one(a: str | None, b: str | None) -> float | None:
        if a is None or b is None:
            return None
        try:
            return tree_score(a, b)
        except FAILURES:
            return 0.0

    return pd.Series([one(a, b) for a, b in zip(truth, guess, strict=True)], dtype="float64")


#: Tables of printable ASCII with a row, without spans and references: what canonical() leaves as it is, but for spaces in a row. Nothing is
#: tried twice, so that tables of any length take no stack. A class of all other characters but white space is some seven times as slow.
SIMPLE = r"\A<table>(?:<tr>(?:<td>[ -%'-;=?-~]*+</td>)*+</tr>)++</table>\z"
#: Cells up to so many characters are compared by Spark, longer ones in Python, where many characters are compared at once.
SHORT_CELL = 64


def simple_tree_score(truth: Column, guess: Column) -> Column:
    """tree_score() of two simple tables that are equal, of which one is the beginning or the end of the other, or which differ in
    one short cell; null of all others."""
    simple = lambda t: t.rlike(SIMPLE) & ~t.contains("  ")
    # Two tags for each node and for the table.
    nodes = lambda t: F.shiftright(F.octet_length(t) - F.octet_length(F.replace(t, F.lit(">"))), 1) - 1
    head = lambda t: F.substr(t, F.lit(1), F.length(t) - len("</table>"))
    tail = lambda t: F.substr(t, F.lit(len("<table>") + 1))
    text = lambda x: F.substring_index(x, ">", -1)
    tags = lambda x: F.substr(x, F.lit(1), F.length(x) - F.length(text(x)))

    def cell(p: Column, q: Column) -> Column:
        """The share that differs of two texts, each after the tags before it, if these are the same."""
        x, y = text(p), text(q)
        short = (F.length(x) <= SHORT_CELL) & (F.length(y) <= SHORT_CELL)
        return F.when((tags(p) == tags(q)) & short, F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))

    apart = F.zip_with(F.split(truth, "</td>"), F.split(guess, "</td>"), lambda p, q: F.when(~p.eqNullSafe(q), F.struct(p.alias("p"), q.alias("q"))))
    one_cell = let(F.filter(apart, lambda d: d.isNotNull()), lambda d: F.when(F.size(d) == 1, cell(d[0]["p"], d[0]["q"])))
    part = truth.startswith(head(guess)) | guess.startswith(head(truth)) | truth.endswith(tail(guess)) | guess.endswith(tail(truth))
    score = F.when(part, 1.0 - F.abs(nodes(truth) - nodes(guess)) / F.greatest(nodes(truth), nodes(guess))).when(nodes(truth) == nodes(guess), 1.0 - one_cell / nodes(truth))
    return F.when(truth == guess, F.when(simple(truth), 1.0)).when(simple(guess) & simple(truth), score)


@F.pandas_udf(T.DoubleType())
def given_tree_similarity(truth: pd.Series, guess: pd.Series) -> pd.Series:
    """Tree score of a canonical HTML text and of the canonical form of another; null where there is none, 0 where it cannot be computed."""

    def one(a: str | None, b: str | None) -> float | None:
        if a is None or b is None:
            return None
        try:
            b = canonical_alike(b)
        except FAILURES:
            return None
        try:
            return tree_score(a, b)
        except FAILURES:
            return 0.0

    return pd.Series([one(a, b) for a, b in zip(truth, guess, strict=True)], dtype="float64")


def with_tree_score(pairs: DataFrame, truth: str = "gt_html", guess: str = "pred_html", to: str = "teds") -> DataFrame:
    """pairs with tree_similarity() of truth, in canonical form, and of guess, of which the canonical form is taken.

    Spark scores what needs neither parser nor alignment; only the other pairs' texts go to Python.
    """
    p = pairs.withColumn("simple_score", simple_tree_score(F.col(truth), F.col(guess)))
    left = [F.when(F.col("simple_score").isNull(), F.col(c)) for c in (truth, guess)]
    return p.withColumn(to, F.coalesce("simple_score", given_tree_similarity(*left))).drop("simple_score")


def prepared(trees: bool):
    """One pass over a pair: both canonical forms once, the grids to compare, and the tree score if asked for."""

    @F.pandas_udf(PREPARED)
    def run(truth: pd.Series, guess: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(truth, guess, strict=True):
            if a is None or b is None:
                rows.append((None, None, None, "no prediction" if a is not None else "no truth", 0.0))
                continue
            began, error = time.perf_counter(), None
            try:
                ca = canonical(a)
                cb = ca if a == b else canonical(b)
            except FAILURES as e:
                rows.append(("", "", 0.0 if trees else None, f"{type(e).__name__}: {e}", time.perf_counter() - began))
                continue
            try:
                ga, gb = compared_texts(ca, cb)
            except FAILURES as e:
                ga, gb, error = "", "", str(e)
            score = None
            if trees:
                try:
                    score = tree_score(ca, cb)
                except FAILURES as e:
                    score, error = 0.0, str(e)
            rows.append((ga, gb, score, error, time.perf_counter() - began))
        return pd.DataFrame(rows, columns=PREPARED.names)

    return run


def after_marks(text: Column, mark: str) -> Column:
    """What stands after each mark of a text that begins with one; nothing of an empty text."""
    return F.slice(F.split(text, mark), 2, 1 << 30)


def grid_of(text: Column) -> Column:
    """The grid that is written as one text."""
    return F.transform(after_marks(text, ROW_MARK), lambda r: after_marks(r, CELL_MARK))


def text_score(a: Column, b: Column) -> Column:
    """content_score() of two grids that are written as texts. Where one is the beginning or the end of the other, its rows
    get the most that they can, and no cell is looked at."""

    def scored(p: Column) -> Column:
        n, m = F.size(p["x"]), F.size(p["y"])
        k = F.least(n, m)
        part = (F.slice(p["x"], F.lit(1), k) == F.slice(p["y"], F.lit(1), k)) | (F.slice(p["x"], n - k + 1, k) == F.slice(p["y"], m - k + 1, k))
        cells = lambda rows: F.transform(rows, lambda r: after_marks(r, CELL_MARK))
        every = let(F.struct(cells(p["x"]).alias("a"), cells(p["y"]).alias("b")), lambda g: content_score(g["a"], g["b"]))
        return F.when(k == 0, 0.0).when(part, k / F.greatest(n, m)).otherwise(every)

    rows = F.struct(after_marks(a, ROW_MARK).alias("x"), after_marks(b, ROW_MARK).alias("y"))
    return F.when(a.isNotNull() & b.isNotNull(), let(rows, scored))


@dataclass(frozen=True)
class Metric:
    """A score as a column of a prepared pair: a struct of truth and guess (grids as they are compared, of one width),
    truth_text and guess_text (the same as texts), teds (the tree score, if trees), error and seconds."""

    column: Callable[[Column], Column]
    trees: bool = False


#: Metrics by name. The first two are always among the scores, null if not asked for.
METRICS = {"levenshtein": Metric(lambda p: text_score(p["truth_text"], p["guess_text"])), "teds": Metric(lambda p: p["teds"], trees=True)}
STANDARD = ("levenshtein", "teds")


def register_metric(name: str, column: Callable[[Column], Column], trees: bool = False) -> None:
    """A further metric, or another one of the same name; it can be asked for by name from then on."""
    METRICS[name] = Metric(column, trees)


def cell_agreement(p: Column) -> Column:
    """Share of the positions of the larger grid that have the same cell in both."""
    equal = F.zip_with(p["truth"], p["guess"], lambda r, s: F.aggregate(F.zip_with(r, s, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0))))
    places = F.greatest(F.size(p["truth"]), F.size(p["guess"])) * F.size(F.get(p["truth"], F.lit(0)))
    one_blank = F.least(F.size(p["truth"]), F.size(p["guess"])) == 0
    return F.when(p["truth"].isNotNull() & p["guess"].isNotNull(), F.when(one_blank, 0.0).otherwise(F.aggregate(equal, F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0))) / places))


def score_tables(pairs: DataFrame, truth: str = "gt_html", guess: str = "pred_html", metrics: Sequence[str] = ("levenshtein",), timed: bool = False) -> DataFrame:
    """pairs with scores, a struct of the two standard metrics and of the others that are asked for, and score_error; with
    timed also grading_seconds, the wall time of parsing both sides, building their grids and comparing their trees.

    A standard metric that is not asked for is null, unknown names are passed over. A metric that cannot be
    computed is 0 and leaves the reason in score_error. Where truth or prediction is null, so are the
    scores. Scoring needs no shuffle: a pair is a row.
    """
    asked = [m for m in dict.fromkeys(metrics) if m in METRICS]
    # The array of one keeps Spark from merging the expressions that make the inputs into the Python call, which it
    # cannot take out of the plan if they hold nested lambdas, as those of converters do.
    p = pairs.select("*", F.explode(F.array(F.struct(F.col(truth).alias("truth"), F.col(guess).alias("guess")))).alias("scored_pair"))
    p = p.withColumn("prepared", prepared(any(METRICS[m].trees for m in asked))(F.col("scored_pair.truth"), F.col("scored_pair.guess")))
    p = p.withColumns({f"prepared_{side}": grid_of(F.col(f"prepared.{side}")) for side in ("truth", "guess")})
    grids = [F.col(f"prepared_{side}").alias(side) for side in ("truth", "guess")]
    pair = F.struct(*grids, F.col("prepared.truth").alias("truth_text"), F.col("prepared.guess").alias("guess_text"), "prepared.teds", "prepared.error", "prepared.seconds")
    value = lambda m: METRICS[m].column(pair) if m in asked else F.lit(None)
    scores = F.struct(*(value(m).cast("double").alias(m) for m in dict.fromkeys((*STANDARD, *asked))))
    p = p.withColumn("scores", scores).withColumn("score_error", F.col("prepared.error"))
    return (p.withColumn("grading_seconds", F.col("prepared.seconds")) if timed else p).drop("prepared", "prepared_truth", "prepared_guess", "scored_pair")


def by_cost(pairs: DataFrame, partitions: int, truth: str = "gt_html", guess: str = "pred_html") -> DataFrame:
    """pairs dealt out so that large tables spread over all partitions: by size class, then at random but repeatably."""
    cost = F.floor(F.log2(F.coalesce(F.length(truth), F.lit(0)) * F.coalesce(F.length(guess), F.lit(0)) + 2)).cast("int")
    return pairs.repartition(partitions, cost, F.xxhash64(truth, guess))


def row_pairs(pairs: DataFrame, keys: Sequence[str], truth: str, guess: str) -> DataFrame:
    """Every pair of rows of two grids as a row: keys, i, j and their match value with the row bonus. Nothing is shuffled."""
    lines = pairs.select(*keys, F.posexplode(row_matches(F.col(truth), F.col(guess))).alias("i", "line"))
    return lines.select(*keys, "i", F.posexplode("line").alias("j", "match"))


def row_alignment_score(pairs: DataFrame, keys: Sequence[str], truth: str, guess: str) -> DataFrame:
    """Best alignment of the rows of two grids, each distinct pair of rows that can matter scored once. Nothing is shuffled."""
    return pairs.select(*keys, rows_alignment(F.col(truth), F.col(guess)).alias("best"))


ALIGNED = T.StructType([T.StructField("a", T.ArrayType(T.StringType())), T.StructField("b", T.ArrayType(T.StringType())), T.StructField("score", T.DoubleType())])


def aligned(a: list[str], b: list[str], gap: float = 1.0) -> tuple[list[str | None], list[str | None], float]:
    """The best alignment from the start of both to its end, gaps as None.

    Where values tie, a pair goes before a gap in b, that before a gap in a. The alignment ends at the corner unless
    the last column has more, there at its first best place, unless the last row has more still; what is beyond
    the end is not listed. Values are in single precision, in which ties are judged.
    """
    n, m = len(a), len(b)
    value = np.zeros((n + 1, m + 1), dtype=np.float32)
    step = [["h"] * (m + 1)] + [["v"] + [""] * m for _ in range(n)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            like = 1.0 if x == y else -1.0 + 2.0 * (1.0 - edit_distance(x, y) / max(len(x), len(y)))
            options = (value[i - 1, j - 1] + np.float32(like), value[i - 1, j] - np.float32(gap), value[i, j - 1] - np.float32(gap))
            value[i, j] = max(options)
            step[i][j] = "dvh"[options.index(value[i, j])]
    i, j = n, m
    if value[:, m].max() > value[i, j]:
        i = int(value[:, m].argmax())
    if value[n].max() > value[i, j]:
        i, j = n, int(value[n].argmax())
    score = float(value[i, j])
    pairs: list[tuple[str | None, str | None]] = []
    while i or j:
        s = step[i][j]
        pairs.append((None if s == "h" else a[i - 1], None if s == "v" else b[j - 1]))
        i, j = i - (s != "h"), j - (s != "v")
    return [x for x, _ in reversed(pairs)], [y for _, y in reversed(pairs)], score


@F.pandas_udf(ALIGNED)
def align_rows(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Diagnostic: how two rows align, with nulls for gaps; null where a row is null. A null cell is an empty one."""

    def one(x, y) -> tuple:
        if x is None or y is None:
            return None, None, None
        return aligned(*([c if isinstance(c, str) else "" for c in r] for r in (x, y)))

    return pd.DataFrame([one(x, y) for x, y in zip(a, b, strict=True)], columns=ALIGNED.names)


def quality_class(levenshtein: Column, teds: Column, threshold: float = 0.5) -> Column:
    """What two scores say together."""
    high = lambda c: c >= threshold
    return (
        F.when(levenshtein.isNull() | teds.isNull(), None)
        .when(high(levenshtein) & high(teds), "good")
        .when(high(levenshtein), "content without structure")
        .when(high(teds), "structure without content")
        .otherwise("poor")
    )
