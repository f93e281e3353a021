"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document gets a virtual finish time: the tokens of its source up to and including it, in
shuffled order, divided by the source's target. All finish times are range-sorted over the cluster,
the sizes before each range are summed, and the order is truncated in the one range where the total
budget runs out. A source whose target is above its size goes round again, up to max_repeats times.

Running sums come in two levels (sums of short runs of the shuffled order, then rows within a run), so
that a source with a third of all rows is no single task's work. Rows alike in id, source and size are
one row with a count in these sums, however many they are, and are told apart only if they are cut.

Null texts and texts without words have size 0 and are never taken; a null source is a source of
its own, last in the order. Rows that repeat a doc_id, and those without one, are documents of their
own; which of those alike in id, source and size are taken once more is settled by their texts. Texts of
any length are counted whole. Ties of finish times go to the source that comes first. An empty table
gives an empty result. Columns of the input other than the four that are named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions

#: Rows of a source in a run of the shuffled order that one task sums up, and alike rows that are written out in one go.
RUN_ROWS = 1_000
#: Kinds of rows at the cut up to which they are broadcast (some 60 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Java regex of a word.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id's decimal digits."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """(source, rank, documents, source_size, target) for each source of sized (source, size).

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes.
    No target is above max_repeats times its source's size; the excess is shared by weight among the
    others. As sources reach their caps in the order of cap / weight, the first that stays below it
    shows the level of all that do. One row per source meets in the windows here, never the documents.
    """
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", w)
    s = s.withColumn("cap", F.col("source_size") * max_repeats).withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    order = Window.orderBy("ratio", "rank")
    before, rest, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    s = s.withColumn("level", left.cast("double") / F.sum("w").over(rest))
    level = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(every)
    s = s.withColumn("share", level * F.col("w"))
    cap = F.col("cap").cast("double")
    return s.select("source", "rank", "documents", "source_size", F.least(cap, F.coalesce("share", cap)).alias("target"))


def queue(sized: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """(doc_id, source, size, n) of the n rows alike in sized (doc_id, source, size), with rank, source_size, target and
    ahead, the sum of the source's sizes before them in shuffled order."""
    t = source_targets(sized, weights, max_repeats)
    r = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    r = r.join(t.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    r = r.withColumn("key", shuffle_key(F.col("doc_id"))).withColumn("run", F.floor(F.col("key").cast("double") / 2.0**60 * F.ceil(F.col("documents") / RUN_ROWS)))
    whole = F.col("size") * F.col("n")
    sums = r.groupBy("rank", "run").agg(F.sum(whole).alias("run_size"))
    before = Window.partitionBy("rank").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rank", "run", F.coalesce(F.sum("run_size").over(before), F.lit(0)).alias("run_ahead"))
    within = Window.partitionBy("rank", "run").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    r = r.join(sums, ["rank", "run"])
    ahead = F.col("run_ahead") + F.coalesce(F.sum(whole).over(within), F.lit(0))
    return r.select("doc_id", "source", "size", "n", "source_size", "target", "rank", ahead.alias("ahead"))


def finish(epoch: Column, number: Column) -> Column:
    """Virtual finish time of the row of that number among its like, in the given round through the source."""
    return (epoch * F.col("source_size") + F.col("ahead") + number * F.col("size")).cast("double") / F.col("target")


def last_taken(rows: DataFrame, budget: int, max_repeats: int) -> tuple[float, int] | None:
    """(finish time, rank) of the last copy within the budget; None: not even the first is.

    One sum for each range reaches the driver, and only the range of the cut is summed up row by row.
    """
    live = rows.where("size > 0 and target > 0")
    # Many rows alike are written out by several tasks.
    many = live.where(F.col("n") > RUN_ROWS).withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(RUN_ROWS).cast("long"))))
    many = many.withColumn("to", F.least(F.col("n"), F.col("from") + RUN_ROWS - 1)).repartition(partitions(rows.sparkSession), "doc_id", "source", "size", "from")
    few = live.where(F.col("n") <= RUN_ROWS).withColumns({"from": F.lit(1).cast("long"), "to": F.col("n")})
    each = few.unionByName(many).withColumn("number", F.explode(F.sequence("from", "to")))
    each = each.select("rank", "size", F.explode(F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda e: finish(e, F.col("number")))).alias("f"))
    order = cut(each.repartitionByRange(partitions(rows.sparkSession), "f", "rank").withColumn("range", F.spark_partition_id()))
    base, last = 0, None
    for r in order.groupBy("range").agg(F.sum("size").alias("s"), F.max(F.struct("f", "rank")).alias("last")).orderBy("range").collect():
        if base + r.s > budget:
            running = F.sum("size").over(Window.orderBy("f", "rank").rowsBetween(Window.unboundedPreceding, 0))
            x = order.where(F.col("range") == r.range).withColumn("sum", running).where(F.col("sum") + base <= budget).agg(F.max(F.struct("f", "rank"))).first()[0]
            return (x.f, x["rank"]) if x is not None else last
        base, last = base + r.s, (r.last.f, r.last["rank"])
    return last


def taken_counts(docs: DataFrame, weights: Sequence[int], max_repeats: int, budget: int | None) -> DataFrame:
    """queue() of docs (doc_id, text, source) with taken, an array: how many of the n rows alike the mix takes in each round."""
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    rows = cut(queue(sized, weights, max_repeats))
    total = budget if budget is not None else (sized.agg(F.sum("size")).first()[0] or 0)
    last = last_taken(rows, total, max_repeats)
    if last is None:
        return rows.withColumn("taken", F.array(*[F.lit(0).cast("long")] * max_repeats))

    def count(epoch: int) -> Column:
        """The numbers that are taken are the first ones, as finish times grow with them."""
        within = lambda k: (finish(F.lit(epoch), k) < last[0]) | ((finish(F.lit(epoch), k) == last[0]) & (F.col("rank") <= last[1]))
        one = F.when(within(F.lit(1)), 1).otherwise(0)
        # A guess from the quotient, which rounding can put off by one or two, made exact.
        guess = F.floor((F.lit(last[0]) * F.col("target") - epoch * F.col("source_size") - F.col("ahead")) / F.col("size"))
        near = F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda d: F.least(F.greatest(guess + d, F.lit(0)), F.col("n")))
        several = F.array_max(F.transform(near, lambda k: F.when((k > 0) & within(k), k).otherwise(F.lit(0).cast("long"))))
        return F.when((F.col("size") > 0) & (F.col("target") > 0), F.when(F.col("n") == 1, one).otherwise(several)).otherwise(0).cast("long")

    return rows.withColumn("taken", F.array(*map(count, range(max_repeats))))


def copies_of(number: Column, taken: Column) -> Column:
    """How often the row of that number among its like is taken."""
    return F.size(F.filter(taken, lambda k: k >= number)).cast("long")


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3, budget: int | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row of docs (doc_id, text, source).

    copies is how often the mix takes the document, taken the words that come of it. budget: total
    number of words, by default the sum of all sizes.
    """
    rows = taken_counts(docs, weights, max_repeats, budget)
    runs = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(RUN_ROWS).cast("long")))
    many = rows.where(F.col("n") > RUN_ROWS).withColumn("from", runs).withColumn("to", F.least(F.col("n"), F.col("from") + RUN_ROWS - 1)).repartition(partitions(docs.sparkSession), "doc_id", "source", "size", "from")
    few = rows.where(F.col("n") <= RUN_ROWS).withColumns({"from": F.lit(1).cast("long"), "to": F.col("n")})
    each = few.unionByName(many).withColumn("number", F.explode(F.sequence("from", "to")))
    return each.select("doc_id", "source", "size", "source_size", "target", copies_of(F.col("number"), F.col("taken")).alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the mix takes, each once per copy, with all columns and the number of the copy.

    Texts are joined with the counts of their id, source and size. Only rows alike of which some are taken more often
    than others, which are those at the cut, at most one kind for each source and round, are put in order.
    """
    kept = taken_counts(docs, options.get("weights", (1, 2, 3)), options.get("max_repeats", 3), options.get("budget")).where(F.col("taken")[0] > 0)
    kept = kept.select(F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("size").alias("_mix_size"), F.col("n").alias("_mix_n"), F.col("taken").alias("_mix_taken"))
    d = docs.drop("copy").withColumn("_mix_words", word_count(F.col("text")))
    alike = F.col("doc_id").eqNullSafe(F.col("_mix_id")) & F.col("source").eqNullSafe(F.col("_mix_source")) & (F.col("_mix_words") == F.col("_mix_size"))
    uniform = F.forall("_mix_taken", lambda k: (k == 0) | (k == F.col("_mix_n")))
    rows = d.join(kept.where(uniform), alike).withColumn("_mix_number", F.lit(1))
    at_cut = cut(kept.where(~uniform))
    if n := at_cut.count():
        number = F.row_number().over(Window.partitionBy("_mix_id", "_mix_source", "_mix_size").orderBy(F.xxhash64("text")))
        rows = rows.unionByName(d.join(F.broadcast(at_cut) if n <= BROADCAST_ROWS else at_cut, alike).withColumn("_mix_number", number))
    copies = copies_of(F.col("_mix_number"), F.col("_mix_taken"))
    out = rows.withColumn("_mix_copies", copies).where(F.col("_mix_copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies"))))
    return out.select(*[c for c in docs.columns if c != "copy"], "copy")
