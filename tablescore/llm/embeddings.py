"""Embedding near-duplicates by p-stable hashing of normalised vectors and exact cosine checks.

A table hashes a vector to the floors of k random projections, shifted and divided by a width; with
Gaussian projections two unit vectors at distance c share a floor with a probability that falls with
c only. Vectors meet in a bucket of any table (same label, same length, same floors).

How many floors a table takes follows the number of vectors of the largest label, so that about NODE unrelated
vectors share a bucket whatever that number, and the number of tables follows from the floors and RECALL
(see tables_for()): comparisons grow with the power 1.2 of the number of vectors.

What is shuffled stays small. A bucket gets a node number (64 bits of a digest of label and vector)
and a sketch (the signs of 128 more projections), never the vector; each task sends a vector it has
had before only once. Sketches that differ in more than SKETCH_BITS places are no pair: at cosine
0.93 that befalls three pairs in 10^6, and of unrelated pairs it leaves one in 10^7, so that false partners, 0.003 for each
of 10^8 vectors, form no clusters. What meets so hangs together in clusters, of which each bucket returns a spanning forest. Then every vector of a cluster is
sent once, to its cluster, and all pairs there are compared by cosine in double precision, so a pair
counts once, whatever tables it met in. Buckets with more than a few tasks' worth of rows and large
clusters are dealt out as pairs of blocks; nothing is listed pair by pair. Equal vectors are one class
with a size.

A pair at cosine 0.93 meets with probability RECALL or more, one at 0.97 with over 0.999 (see recall()); no pair below
the limit is ever linked.

Vectors that are null, empty, zero or hold null or non-finite components, and those with a null label
or a null vec_id, link with nothing. Repeated rows are vectors of their own that link with each other.
An empty table gives an empty one; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, cut, groups, hamming, join_keyed, local_stars, partitions, run_forest, whole_groups

WIDTH = 2.0
SEED = 20_240_501
#: Unrelated vectors that share a bucket on average, at most; probability that a pair at the limit meets; the least number of floors.
NODE, RECALL, PROJECTIONS = 512, 0.985, 9
#: Bits of a sketch (two words), and those in which a pair may differ.
SKETCH, SKETCH_BITS = 128, 34
#: Vectors of a cluster that are compared in one piece: four times the root of its size, within these bounds.
LEAST_BLOCK, BLOCK = 64, 4_096
#: Sketches of a bucket that are compared in one piece, and vectors hashed at a time.
BUCKET, PIECE = 4_096, 2_000
#: Nodes that a task remembers having sent; one in so many is sampled to find large buckets.
SENT, SAMPLED = 1 << 20, 16
#: Classes up to which those in clusters are broadcast (some 60 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Rows of a block of the cosine matrix.
STRIP = 512


def share(cosine: float, width: float = WIDTH) -> float:
    """Probability that a pair at this cosine has the same floor of a projection."""
    u = width / sqrt(2 - 2 * cosine)
    return erf(u / sqrt(2)) - 2 / (sqrt(2 * pi) * u) * (1 - exp(-u * u / 2))


def recall(cosine: float, tables: int, projections: int, width: float = WIDTH) -> float:
    """Probability that a pair at this cosine meets in at least one table."""
    return 1 - (1 - share(cosine, width) ** projections) ** tables


def tables_for(n: int, cosine: float, width: float = WIDTH) -> tuple[int, int]:
    """(tables, projections) for n vectors that may be links of each other: floors that leave NODE unrelated vectors in a
    bucket, in as many tables as give RECALL at the limit."""
    floors = max(PROJECTIONS, ceil(log(max(n, 1) / NODE) / -log(share(0.0, width))))
    return ceil(log(1 - RECALL) / log(1 - share(cosine, width) ** floors)), floors


def projections_of(dim: int, tables: int, projections: int, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    r = np.random.default_rng([SEED, dim])
    lines, shifts = r.standard_normal((dim, tables * projections)), r.uniform(0, width, tables * projections)
    return lines, shifts, r.integers(1, 1 << 62, (tables, projections), dtype=np.int64).view(np.uint64) | np.uint64(1), r.standard_normal((dim, SKETCH))


def spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def hashed(unit: np.ndarray, home: np.ndarray, tables: int, projections: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Bucket number of each unit vector in each table, by its home (a number for its label), and its sketch."""
    a, b, mix, signs = projections_of(unit.shape[1], tables, projections, width)
    cell = np.floor((unit @ a + b) / width).astype(np.int64).view(np.uint64).reshape(len(unit), tables, projections)
    h = spread((cell * mix[None]).sum(axis=2, dtype=np.uint64) + np.arange(tables, dtype=np.uint64))
    return spread(h + home[:, None].view(np.uint64)), np.packbits(unit @ signs > 0, axis=1).view("<u8").astype(np.uint64)


def unit_of(rows: np.ndarray) -> np.ndarray:
    m = rows.astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def kind_of(batch: pa.RecordBatch) -> str:
    """How its components are kept: as they come."""
    return "<f4" if pa.types.is_float32(batch.column("embedding").type.value_type) else "<f8"


def read(batch: pa.RecordBatch) -> list[bytes | None]:
    """The components of each vector as bytes, null if it links with nothing."""
    lists = batch.column("embedding")
    kind = kind_of(batch)
    flat = np.asarray(lists.flatten().cast(pa.float32() if kind == "<f4" else pa.float64()).fill_null(float("nan")), dtype=kind)
    ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64))
    starts = ends - np.diff(ends, prepend=0)
    fine = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    full = np.concatenate([[0], np.cumsum(flat != 0)])
    ok = (fine[ends] == fine[starts]) & (full[ends] > full[starts])
    ok &= ~np.asarray(pc.is_null(batch.column("label"))) & ~np.asarray(pc.is_null(batch.column("vec_id")))
    raw, size = flat.tobytes(), flat.itemsize
    return [raw[s * size : e * size] if k else None for s, e, k in zip(starts.tolist(), ends.tolist(), ok.tolist(), strict=True)]


def digests(vectors: list[bytes | None], home: list[int]) -> np.ndarray:
    """Two words for each vector and home; zero for null."""
    none = bytes(16)
    raw = b"".join(none if v is None else hashlib.blake2b(v, digest_size=16, salt=h.to_bytes(8, "little", signed=True)).digest() for v, h in zip(vectors, home, strict=True))
    return np.frombuffer(raw, dtype="<i8").reshape(-1, 2)


LIGHT = ("d1", "d2")


def labelled(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label", F.xxhash64("label").alias("home"))


def with_digests(vectors: DataFrame, vec: bool = False) -> DataFrame:
    """(vec_id, label, d1, d2) of every row, and the vector itself if asked for; all null but the first if it links with nothing."""
    kinds = T.StructType([T.StructField("vec_id", T.LongType()), vectors.schema["label"], *(T.StructField(c, T.LongType()) for c in LIGHT), *([T.StructField("vec", T.BinaryType())] if vec else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = read(batch)
            d = digests(v, batch.column("home").to_pylist())
            none = np.array([x is None for x in v], dtype=bool)
            label = pc.if_else(pa.array(none), pa.scalar(None, batch.column("label").type), batch.column("label"))
            cols = [batch.column("vec_id"), label, *(pa.array(d[:, k], mask=none) for k in (0, 1)), *([pa.array(v, pa.binary())] if vec else [])]
            yield pa.RecordBatch.from_arrays(cols, names=kinds.names)

    return labelled(vectors).mapInArrow(run, kinds)


ROUTED = "slot long, node long, x long, y long"


def memberships(vectors: DataFrame, tables: int, projections: int, width: float, every: int = 1) -> DataFrame:
    """(slot, node, x, y): the bucket of each vector in each table, its node and its sketch, of one node in so many.

    A task sends a node once, unless it has sent SENT others since."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for whole in batches:
            for start in range(0, whole.num_rows, PIECE):
                batch = whole.slice(start, PIECE)
                vecs = read(batch)
                node = digests(vecs, batch.column("home").to_pylist())[:, 0]
                by_size: dict[int, list[int]] = {}
                for i, (v, n) in enumerate(zip(vecs, node.tolist(), strict=True)):
                    if v is not None and n % every == 0 and n not in sent:
                        sent.add(n)
                        by_size.setdefault(len(v), []).append(i)
                for at in by_size.values():
                    unit = unit_of(np.array([np.frombuffer(vecs[i], dtype=kind_of(batch)) for i in at]))
                    slot, sketch = hashed(unit, np.asarray(batch.column("home"))[at], tables, projections, width)
                    each = [np.repeat(c, tables) for c in (node[at], *sketch.view(np.int64).T)]
                    yield pa.RecordBatch.from_arrays([pa.array(slot.view(np.int64).ravel()), *map(pa.array, each)], names=["slot", "node", "x", "y"])
                if len(sent) > SENT:
                    sent.clear()

    return labelled(vectors).mapInArrow(run, ROUTED)


def meetings(vectors: DataFrame, tables: int, projections: int, width: float, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between nodes that meet in a bucket.

    Buckets with more than a task's share of rows are found in a sample of the nodes and dealt out as pairs of blocks:
    which ones these are changes the work and not the result, as any two rows of a bucket still meet.
    """
    spark = vectors.sparkSession
    rows = memberships(vectors, tables, projections, width)
    counts = cut(memberships(vectors, tables, projections, width, SAMPLED).groupBy("slot").count())
    bound = max(bucket, (counts.agg(F.sum("count")).first()[0] or 0) * SAMPLED // (4 * partitions(spark)))
    # Fewer than 8 buckets for each partition have so many rows in the sample.
    blocks = F.ceil(F.col("count") * 2 * SAMPLED / bound).cast("int")
    large = F.broadcast(counts.where(F.col("count") * 2 * SAMPLED > bound).select("slot", F.greatest(blocks, F.lit(2)).alias("blocks")))
    both = rows.join(large, "slot", "left").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("block"))
    both = both.withColumn("other", F.explode(F.coalesce(other, F.array(F.lit(0)))))
    pair = F.xxhash64("slot", F.least("block", "other"), F.greatest("block", "other"))
    dealt = both.select(F.when(F.col("blocks").isNull(), F.col("slot")).otherwise(pair).alias("slot"), "node", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ("slot",)):
            slot, node, x, y = (t.column(c).to_numpy() for c in ("slot", "node", "x", "y"))
            x, y = x.view(np.uint64), y.view(np.uint64)
            a, b = run_forest(slot, lambda i, j, x=x, y=y: hamming(x, y, i, j) <= SKETCH_BITS)
            a, b = node[a], node[b]
            yield pa.RecordBatch.from_arrays([pa.array(c[a != b]) for c in (a, b)], names=["a", "b"])

    return dealt.repartition(partitions(spark), "slot").sortWithinPartitions("slot", "node").mapInArrow(run, "a long, b long")


def cluster_links(t: pa.Table, cosine: float, kind: str) -> Iterator[pa.RecordBatch]:
    """(id, d1, weight, head) of the classes of a cluster, or of one pair of blocks of it: size of the other
    classes linked here, and the smallest id that a class hangs together with here."""
    ids, d1, size, block = (t.column(c).to_numpy() for c in ("id", "d1", "size", "block"))
    order = np.lexsort((d1, ids, block))
    ids, d1, size, block = ids[order], d1[order], size[order], block[order]
    unit = unit_of(np.frombuffer(b"".join(t.column("vec").to_pylist()), dtype=kind).reshape(len(ids), -1)[order])
    n = len(ids)
    two = block[0] != block[-1]
    weight, a, b = np.zeros(n, dtype=np.int64), [], []
    for i in range(0, n, STRIP):
        rows = slice(i, min(i + STRIP, n))
        near = unit[rows] @ unit.T >= cosine
        near[np.arange(near.shape[0]), np.arange(rows.start, rows.stop)] = False
        if two:
            near &= block[rows, None] != block[None]
        weight[rows] += near @ size
        x, y = np.nonzero(near)
        if len(x):
            low = local_stars(n, x + i, y)
            far = np.flatnonzero(low != np.arange(n))
            a.append(far)
            b.append(low[far])
    if a:
        low = local_stars(n, np.concatenate(a), np.concatenate(b))
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, low, ids)
        linked = np.flatnonzero(weight)
        yield pa.RecordBatch.from_arrays([pa.array(c[linked]) for c in (ids, d1, weight, least[low])], names=["id", "d1", "weight", "head"])


def links(members: DataFrame, cosine: float, kind: str, block: int = BLOCK) -> DataFrame:
    """(id, d1, weight, head) of members (cluster, label, id, d1, size, vec, n): partial results of all clusters of n members."""
    spark = members.sparkSession
    bound = F.least(F.greatest(4 * F.sqrt("n"), F.lit(min(LEAST_BLOCK, block))), F.lit(block))
    m = members.withColumn("bytes", F.octet_length("vec")).withColumn("blocks", F.ceil(F.col("n") / bound).cast("int")).withColumn("block", F.pmod(F.xxhash64("id", "d1"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"b1": F.least("block", "other"), "b2": F.greatest("block", "other")})
    key = ["cluster", "label", "bytes", "b1", "b2"]
    m = m.select("id", "d1", "size", "vec", "block", *key).repartition(partitions(spark), *key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, tuple(key)):
            if g.num_rows > 1 and (g.column("b1")[0] == g.column("b2")[0] or len(set(g.column("block").to_pylist())) == 2):
                yield from cluster_links(g, cosine, kind)

    return m.mapInArrow(run, "id long, d1 long, weight long, head long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, width: float = WIDTH, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, label)."""
    vectors = vectors.select("vec_id", "embedding", "label")
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    light = with_digests(vectors)
    classes = cut(light.where("d1 is not null").groupBy("label", *LIGHT).agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("size")))
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    clusters = connected_components(meetings(vectors, *tables_for(most, cosine, width), width)).select(F.col("id").alias("d1"), F.col("component").alias("cluster"))
    found = cut(classes.join(clusters, "d1"))
    count = found.count()
    sizes = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("rows"))
    found = join_keyed(found, sizes, "cluster", "rows", count)
    # The vector of a class comes from a row of its smallest vec_id.
    vec = with_digests(vectors, vec=True).where("d1 is not null").select(F.col("vec_id").alias("id"), "label", *LIGHT, "vec")
    members = vec.join(F.broadcast(found) if count <= BROADCAST_ROWS else found, ["id", "label", *LIGHT]).dropDuplicates(["id", "label", *LIGHT])
    partial = cut(links(members, cosine, kind, block))
    comp = connected_components(partial.select(F.col("id").alias("a"), F.col("head").alias("b")))
    weight = partial.groupBy("id", "d1").agg(F.sum("weight").alias("weight"))
    c = classes.join(weight, ["id", "d1"], "left").join(comp, "id", "left")
    c = c.select(F.struct("label", *LIGHT).alias("key"), "size", (F.col("size") - 1 + F.coalesce("weight", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("c"))
    rows = light.select("vec_id", F.when(F.col("d1").isNotNull(), F.struct("label", *LIGHT)).alias("key"))
    total = classes.agg(F.sum("size")).first()[0] or 0
    out = join_keyed(rows, c, "key", "size", total, "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
