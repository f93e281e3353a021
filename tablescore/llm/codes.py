"""Vector code compression: product codebooks learned and applied in whole numbers.

A component x becomes floor(256 x); a vector is cut into 16 equal consecutive parts. The codebook of a
part position starts as that part of the 64 smallest vec_ids; each round gives every part its nearest
entry and moves each entry to the floors of its parts' means.

The nearest entry is found in two steps. One float32 matrix product screens all entries of a block of
parts: |c|² - 2 x·c is known up to a rigorous bound of the product's rounding errors (the components are
whole and below 2^24, so float32 holds them exactly, and a sum of p products is off by p u / (1 - p u) of
|x||c| at most, in whatever order it is taken). Every entry whose interval overlaps the best one's is then
evaluated again in int64, and ties go to the lower index. So codes, distances and codebooks are exact.

A round is one pass over the vectors: a task returns a sum for each entry, which Spark adds up. What
reaches the driver and is broadcast are the codebooks, 64 times the numbers of one vector.

Vectors that are null or hold null or non-finite components are dropped. Of rows that repeat a vec_id each
counts; where their order matters, the smaller vector comes first, a null vec_id last. Fewer than 64
vectors give as many entries. A vector shorter than the longest is continued with zeros, and so are all up
to a multiple of 16. Scaled components beyond 2^24 stay there. A label_error beyond 64 bits is null. An
empty table gives an empty one. Columns other than vec_id, embedding and label are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, join_keyed

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Largest size of a scaled component: what float32 holds exactly.
LIMIT = 1 << 24
#: Vectors compared at a time.
PIECE = 4_096
#: Labels up to which their sums are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Unit roundoff of float32 and float64.
U32, U64 = 2.0**-24, 2.0**-53


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the entry of book nearest to each row of x, both of whole numbers up to LIMIT."""
    p = x.shape[1]
    dot = (x.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    square = (book * book).sum(axis=1).astype(np.float64)
    size = np.sqrt((x * x).sum(axis=1).astype(np.float64))[:, None] * np.sqrt(square)[None]
    # Twice the product's error, and more than what the float64 operations add.
    slack = 2 * p * U32 / (1 - p * U32) * size * (1 + 16 * U64) + 16 * U64 * (square[None] + 2 * np.abs(dot) + size)
    score = square[None] - 2 * dot
    row, entry = np.nonzero(score - slack <= (score + slack).min(axis=1)[:, None])
    apart = ((x[row] - book[entry]) ** 2).sum(axis=1)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(apart, first) if len(row) else apart
    at = np.flatnonzero(apart == least[row])
    return entry[at[np.diff(row[at], prepend=-1) > 0]], least


def scaled(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a column of lists without nulls as rows of dim whole numbers."""
    sizes = np.asarray(column.value_lengths(), dtype=np.int64)
    flat = np.asarray(column.flatten(), dtype=np.float64)
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(flat * SCALE), -LIMIT, LIMIT).astype(np.int64)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), dtype=np.int64)
    out[np.arange(dim)[None] < sizes[:, None]] = flat
    return out


def assigned(column: pa.Array, books: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, parts, indexes, distances) of blocks of a column of vectors; the last three by row and part."""
    parts, _, width = books.shape
    for at in range(0, len(column), PIECE):
        rows = slice(at, min(at + PIECE, len(column)))
        x = scaled(column.slice(at, PIECE), parts * width).reshape(rows.stop - rows.start, parts, width)
        found = [nearest(np.ascontiguousarray(x[:, k]), books[k]) for k in range(parts)]
        yield rows, x, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def first_books(kept: DataFrame, dim: int) -> np.ndarray:
    """By part, entry and position: the parts of the vectors of the smallest ids."""
    rows = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(ENTRIES).collect()
    x = scaled(pa.array([r.embedding for r in rows], pa.list_(pa.float64())), dim)
    return np.ascontiguousarray(x.reshape(len(rows), PARTS, dim // PARTS).transpose(1, 0, 2))


def moved(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all vectors."""
    held = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = held.value.shape
        total = np.zeros((parts, entries, width + 1), dtype=np.int64)
        for batch in batches:
            for _, x, index, _ in assigned(batch.column("embedding"), held.value):
                for k in range(parts):
                    np.add.at(total[k, :, 0], index[:, k], 1)
                    np.add.at(total[k, :, 1:], index[:, k], x[:, k])
        part, entry = np.nonzero(total[:, :, 0])
        sums = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * (width + 1), total[part, entry].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), sums], names=["part", "entry", "sums"])

    sums = kept.select("embedding").mapInArrow(run, "part int, entry int, sums array<bigint>").select("part", "entry", F.posexplode("sums").alias("at", "value"))
    books, total = books.copy(), np.zeros((*books.shape[:2], books.shape[2] + 1), dtype=np.int64)
    for r in sums.groupBy("part", "entry", "at").agg(F.sum("value").alias("value")).collect():
        total[r.part, r.entry, r["at"]] = r.value
    used = total[:, :, 0] > 0
    books[used] = total[used][:, 1:] // total[used][:, :1]
    held.unpersist()
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def learn(kept: DataFrame, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks by part, entry and position; None without a vector."""
    longest = kept.agg(F.max(F.size("embedding"))).first()[0]
    if longest is None:
        return None
    books = first_books(kept, -(-longest // PARTS) * PARTS)
    for _ in range(rounds):
        books = moved(kept, books)
    return books


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of each vector."""
    held = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, index, apart in assigned(batch.column("embedding"), held.value):
                text = index.astype(np.uint8).tobytes().hex()
                step = 2 * index.shape[1]
                code = pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string())
                part = batch.slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), code, pa.array(apart.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return kept.mapInArrow(run, T.StructType([kept.schema["vec_id"], kept.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def vectors_of(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and label of the vectors that are not dropped."""
    fine = F.col("embedding").isNotNull() & F.expr("forall(embedding, x -> coalesce(abs(x) < double('Infinity'), false))")
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label").where(fine)


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    kept = vectors_of(vectors)
    books = learn(kept, rounds)
    if books is None:
        return spark.createDataFrame([], T.StructType([kept.schema["vec_id"], *(T.StructField(*c) for c in (("code", T.StringType()), ("error", T.LongType()), ("label_error", T.LongType()), ("codebooks_sha256", T.StringType())))]))
    coded = cut(encode(kept, books)).withColumn("key", F.struct("label"))
    sums = cut(coded.groupBy("key").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows")))
    labels, rows = sums.agg(F.count(F.lit(1)), F.sum("rows")).first()
    both = coded.join(F.broadcast(sums.drop("rows")), "key", "left") if labels <= BROADCAST_ROWS else join_keyed(coded, sums, "key", "rows", rows, "left")
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
