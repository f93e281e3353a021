"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only on a single machine whose session names no spark.checkpoint.dir.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Bits of a Maybe, which is broadcast: 16 MB.
MAYBE_BITS = 27
#: Rows of one key that a single task joins without ado.
HOT_ROWS = 10_000


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir. Where none is named, a single
    machine gets one; a cluster raises, as its executors share no local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        spark.sparkContext.setCheckpointDir(LOCAL_CHECKPOINTS)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor costs no recomputation of what is above."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Delete the files of what cut() returned; nothing may read it afterwards."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        delete(df.sparkSession, file.get())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int, max_rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about max_bytes; a longer text stands alone."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (total + n > max_bytes or i - start >= max_rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def with_columns(df: DataFrame, column: str, added: T.StructType, fn: Callable[[pa.RecordBatch], dict], max_bytes: int = 4 << 20, max_rows: int = 1 << 30) -> DataFrame:
    """df with the columns that fn computes from slices of its rows; columns of the same names in df are replaced."""
    names = {f.name for f in added}
    if column in names:
        raise ValueError(f"{column} is read and written")
    keep = [c for c in df.columns if c not in names]
    out = T.StructType([f for f in df.schema if f.name in keep] + list(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, column, max_bytes, max_rows):
                new = fn(part)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(new[f.name] for f in added)], names=[*keep, *(f.name for f in added)])

    return df.select(*keep).mapInArrow(run, out)


def filter_rows(df: DataFrame, column: str, keep: Callable[[pa.RecordBatch], np.ndarray], max_bytes: int = 4 << 20) -> DataFrame:
    """The rows of df for which keep is true, all columns as they are, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, column, max_bytes):
                yield part.filter(pa.array(keep(part), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def replace_columns(df: DataFrame, column: str, fn: Callable[[pa.RecordBatch], dict], max_bytes: int = 4 << 20) -> DataFrame:
    """df with new values in those of its columns that fn returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, column, max_bytes):
                new = fn(part)
                yield pa.RecordBatch.from_arrays([new.get(c, part.column(c)) for c in part.schema.names], names=part.schema.names)

    return df.mapInArrow(run, df.schema)


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, of rows sorted by them, as tables of a few thousand rows or a whole run."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*cols, strict=True))
        start = 0
        for i, r in enumerate(rows):
            if r != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, r
        if start < len(rows):
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def id_hash(ids: np.ndarray) -> np.ndarray:
    """XXH64 with seed 42 of 8-byte integers, as Spark's xxhash64 has it."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    h = turn((p5 + np.uint64(50)) ^ (turn(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1), 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


class Maybe:
    """Which ids may be in a set: true for all of its ids, and for few others, which an exact join takes out again.

    MAYBE_BITS bits whatever the size of the set: with 3 million ids it passes 2 % of the others, with 100 million half of them.
    """

    def __init__(self, ids: DataFrame, column: str):
        h = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(1 << MAYBE_BITS))
        part = ids.select(F.shiftright(h, 15).alias("part"), F.pmod(h, F.lit(1 << 15)).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
        self.bits = np.zeros(1 << (MAYBE_BITS - 3), dtype=np.uint8)
        for r in part.collect():
            self.bits[r.part << 12 : (r.part + 1) << 12] = np.frombuffer(bytes(r.bits), dtype=np.uint8)

    def has(self, ids: pa.Array) -> np.ndarray:
        """False for null."""
        h = id_hash(np.asarray(pc.fill_null(ids.cast(pa.int64()), 0))) & ((1 << MAYBE_BITS) - 1)
        return (self.bits[h >> 3] >> (h & 7).astype(np.uint8) & 1 > 0) & np.asarray(pc.is_valid(ids))


def local_stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label of each of n nodes: the smallest node that it reaches by the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def hamming(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which rows i and j of two words differ."""
    return np.bitwise_count(x[i] ^ x[j]).astype(np.int16) + np.bitwise_count(y[i] ^ y[j])


def run_forest(slot: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of links that connect, within runs of equal slots, all rows that hang together by near(i, j)."""
    n = len(slot)
    edge = np.flatnonzero(np.concatenate([slot[1:] != slot[:-1], [True]])) + 1
    size = np.diff(edge, prepend=0)
    end = np.repeat(edge, size)
    # The group of a row is a row of it; groups of one slot are joined until its rows are all one, or all are compared.
    group, at, d = np.arange(n), np.arange(n), 1
    while len(at := at[at + d < end[at]]):
        apart = at[group[at] != group[at + d]]
        apart = apart[near(apart, apart + d)]
        if len(apart):
            group = local_stars(n, group[apart], group[apart + d])[group]
        if d & (d - 1) == 0:
            one = np.minimum.reduceat(group, edge - size) == np.maximum.reduceat(group, edge - size)
            at = at[~np.repeat(one, size)[at]]
        d += 1
    far = np.flatnonzero(group != np.arange(n))
    return far, group[far]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int = 1 << 17) -> Iterator[pa.Table]:
    """Rows sorted by keys (integers), as tables of about so many rows that hold whole groups of equal keys."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        differs = np.zeros(batch.num_rows, bool)
        for c in cols:
            differs |= c != c[-1]
        last = int(differs.nonzero()[0][-1]) + 1 if differs.any() else 0
        if last or (len(held) > 1 and any(held[-2].column(k)[-1].as_py() != batch.column(k)[-1].as_py() for k in keys)):
            held[-1] = batch.slice(0, last)
            yield pa.Table.from_batches(held)
            held, size = [batch.slice(last)], batch.num_rows - last
    if held:
        yield pa.Table.from_batches(held)


def join_keyed(left: DataFrame, right: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right (key, size, ...) of unique keys; size tells how many of the total rows of left have a key.

    A key with more than a quarter of a task's share of the rows is no single task's work: fewer than four keys
    for each partition are so large, whatever the input, and their rows of right are broadcast. The others are
    shuffled. how: inner or left.
    """
    names = [c for c in right.columns if c not in (key, size)]
    bound = max(HOT_ROWS, total // (4 * partitions(left.sparkSession)))
    if total <= bound:
        return left.join(right.select(key, *names), key, how)
    large = right.where(F.col(size) > bound)
    hot = left.join(F.broadcast(large.select(key, *names)), key)
    rest = left.join(F.broadcast(large.select(key)), key, "left_anti").join(right.where(F.col(size) <= bound).select(key, *names), key, how)
    return hot.unionByName(rest)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b): component is the smallest id reachable.

    Alternating large-star and small-star rounds; each is a join and an aggregation with map-side
    combining, and ends in a reliable checkpoint. Edges stay linear in the number of nodes, and only
    counts and a checksum reach the driver. The centres of large stars are joined by join_keyed() in both
    steps, whatever their ids, so that no task gets a whole star.
    """
    e = cut(edges.where("a <> b and a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen, total = None, e.count()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = cut(join_keyed(both, low, "u", "n", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        rest = join_keyed(large, least, "u", "n", large.count()).where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        before, e = e, cut(rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())
        forget(before)
        forget(large)
        if now == seen:
            break
        seen, total = now, now[0]
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
