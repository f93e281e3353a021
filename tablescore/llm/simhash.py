"""SimHash near-duplicates: fingerprints of word shingles, joined by a binary trie with itself.

The trie join walks pairs of nodes from the root, adds up the bits in which their paths differ and
leaves a pair as soon as the sum exceeds the budget. It is dealt out by leading bits: cut into
budget + k blocks, two fingerprints within the budget agree in k of them, so one trie for each
choice of k blocks, with these bits first, can spend no budget above that depth, and its subtrees
there are joined one by one. Subtrees with too many fingerprints are cut once more in the same way.
Each subtree returns a spanning forest of its links, not all pairs, so that a large group of near
copies stays linear; components over all subtrees follow.

Null and empty texts have fingerprint zero and are linked like any other. Rows that repeat a doc_id
are one document. Null doc_ids are linked to nothing.

one_of_each() asks for more: every two documents whose sets of five-word shingles have a Jaccard
similarity of SIMILAR or more. Such fingerprints differ in 15 % of their bits, too many for exact
blocks. They have WIDE_BITS bits there, each trie has other bits first (see tries()), and what meets below one
of its nodes, where so wide a budget lets no pair of nodes be left, and differs in WIDE_BUDGET bits or fewer
hangs together in families. All sets of a family are then compared exactly, block by block if it is large, so
no pair is listed; links are those that are similar.

Texts of any length are read whole. An empty table gives an empty one. near_duplicates() reads no other
columns, one_of_each() keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Maybe, connected_components, cut, filter_rows, groups, hamming, join_keyed, local_stars, partitions, run_forest, slices, whole_groups

SEED = 42
BITS = 64
#: Fingerprints below one node that are joined in one piece.
NODE_ROWS = 50_000
#: Pairs of nodes that are walked at a time, and links held before they are reduced to a forest.
FRONTIER = 1 << 18
#: Node pairs with at most so many leaf pairs are compared outright.
LEAF_PAIRS = 64
#: Words of a shingle and least Jaccard similarity of the documents that one_of_each() takes for the same.
WORDS, SIMILAR = 5, 0.8
#: Fingerprints for that: their bits, and those in which candidates may differ.
WIDE_BITS, WIDE_BUDGET = 128, 34
#: Fingerprints below one node of its tries, by which their depth follows; and the share of pairs at SIMILAR that may meet in none.
NODE, MISSED = 256, 3.5e-4
#: Sets of a family that are compared in one piece: eight times the root of their number, within these bounds, and with so many
#: hashes; columns of the matrix in which they are counted.
LEAST_BLOCK, BLOCK, BLOCK_HASHES, COLUMNS = 256, 1_024, 1 << 21, 4_096
#: Members of families up to which they are broadcast (some 60 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 250_000
#: Sets that a task remembers having sent.
SENT = 1 << 20


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each shingle of size lower-cased words, repeats included."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(w)
    if len(w) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if w else [], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(w) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], dtype=np.uint64)


def fingerprint(text: str | None, size: int = 3) -> int:
    """A bit is 1 if it is set in over half the hashes; 0 without words."""
    h = shingle_hashes(text, size)
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(h)).tolist())


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row of docs (doc_id, text) as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", 4 << 20):
                fp = np.array([fingerprint(x, size) for x in part.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())]))


def pieces(first: int, last: int, n: int) -> list[tuple[int, int]]:
    """Bits first to last, counted from the most significant one, in n blocks (start, width)."""
    edges = [first + (last - first) * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def rearranged(keys: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """keys with their blocks of bits in the given order."""
    out = np.zeros_like(keys)
    for start, width in order:
        block = (keys >> np.uint64(BITS - start - width)) & np.uint64((1 << width) - 1)
        out = (out << np.uint64(width)) | block
    return out


def layouts(n: int, budget: int, first: int = 0) -> list[tuple[list[tuple[int, int]], int]]:
    """(order of blocks, depth) of each trie: the leading blocks hold about log2(n) bits, so that subtrees stay small."""
    for k in (1, 2, 3):
        blocks = pieces(first, BITS, budget + k)
        depth = min(sum(w for _, w in x) for x in combinations(blocks, k))
        if 2**depth >= n / 64 or k == 3:
            break
    head = [(0, first)] if first else []
    return [(head + list(lead) + [b for b in blocks if b not in lead], first + sum(w for _, w in lead)) for lead in combinations(blocks, k)]


def forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as connect what (a, b) connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    low = local_stars(len(nodes), at[: len(a)], at[len(a) :])
    far = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[far], nodes[low[far]]


def trie_links(keys: np.ndarray, depth: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked keys, as a forest. keys: sorted and distinct; depth: of the subtree to which each key belongs."""
    n = len(keys)
    shift = (np.uint64(BITS) - depth.astype(np.uint64)).clip(max=63)
    new = np.ones(n, dtype=bool)
    new[1:] = (depth[1:] != depth[:-1]) | ((keys[1:] >> shift[1:]) != (keys[:-1] >> shift[1:])) & (depth[1:] > 0)
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], n)
    full = hi - lo > 1
    lo, hi = lo[full], hi[full]
    stack = [(lo, hi, lo, hi, depth[lo].astype(np.int64), np.zeros(len(lo), dtype=np.int64))]
    a, b = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def split(lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
        s = (BITS - 1 - at).astype(np.uint64)
        return np.clip(np.searchsorted(keys, ((keys[lo] >> s) | np.uint64(1)) << s), lo, hi)

    while stack:
        f = stack.pop()
        if len(f[0]) > FRONTIER:
            stack.append(tuple(x[FRONTIER:] for x in f))
            f = tuple(x[:FRONTIER] for x in f)
        alo, ahi, blo, bhi, at, err = f
        leaf = ((ahi - alo) * (bhi - blo) <= LEAF_PAIRS) | (at >= BITS)
        if leaf.any():
            na, nb = (ahi - alo)[leaf], (bhi - blo)[leaf]
            m = na * nb
            k = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            i, j = np.repeat(alo[leaf], m) + k // np.repeat(nb, m), np.repeat(blo[leaf], m) + k % np.repeat(nb, m)
            near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            a, b = np.concatenate([a, i[near]]), np.concatenate([b, j[near]])
            if len(a) > 4 * FRONTIER:
                a, b = forest(keys, a, b)
        go = ~leaf
        if not go.any():
            continue
        alo, ahi, blo, bhi, at, err = (x[go] for x in (alo, ahi, blo, bhi, at, err))
        same = alo == blo
        am, bm = split(alo, ahi, at), split(blo, bhi, at)
        found = [(alo, am, blo, bm, err, err >= 0), (am, ahi, bm, bhi, err, err >= 0), (alo, am, bm, bhi, err + 1, err < budget), (am, ahi, blo, bm, err + 1, (err < budget) & ~same)]
        kept = []
        for x in found:
            ok = x[5] & (x[1] > x[0]) & (x[3] > x[2])
            kept.append((x[0][ok], x[1][ok], x[2][ok], x[3][ok], at[ok] + 1, x[4][ok]))
        stack.append(tuple(np.concatenate(c) for c in zip(*kept, strict=True)))
    return forest(keys, a, b) if len(a) else (a, b)


TRIE = T.StructType([T.StructField("trie", T.IntegerType()), T.StructField("depth", T.IntegerType()), T.StructField("lead", T.LongType()), T.StructField("bits", T.LongType()), T.StructField("id", T.LongType())])


def planted(rows: DataFrame, plans: list[tuple[int, list[tuple[int, int]], int]]) -> DataFrame:
    """Each row (trie, bits, id) once for each (number, order, depth) of plans, with its bits so arranged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.asarray(batch.column("bits")).view(np.uint64)
            old = np.asarray(batch.column("trie"))
            for number, order, depth in plans:
                own = rearranged(bits, order)
                lead = (own >> np.uint64(BITS - depth)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(old * 64 + number, pa.int32()), pa.array(np.full(len(own), depth), pa.int32()), pa.array(lead), pa.array(own.view(np.int64)), batch.column("id")], names=[f.name for f in TRIE])

    return rows.select("trie", "bits", "id").mapInArrow(run, TRIE)


def hamming_forest(ids: DataFrame, budget: int = 3, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links (a, b) that connect the rows of ids (id, bits) wherever distinct bits differ in budget places or fewer."""
    spark = ids.sparkSession
    first = layouts(ids.count(), budget)
    rows = planted(ids.withColumn("trie", F.lit(0)), [(k, *x) for k, x in enumerate(first)])
    large = rows.groupBy("trie", "lead").count().where(F.col("count") > node_rows).withColumn("large", F.lit(True)).drop("count")
    rows = rows.join(large, ["trie", "lead"], "left")
    parts = [rows.where("large is null").select(*TRIE.names)]
    for depth in sorted({d for _, d in first}):
        again = [(k, *x) for k, x in enumerate(layouts(node_rows * 64, budget, depth))]
        # Numbers from 64 on, so that no trie of the second kind shares one with the first.
        parts.append(planted(rows.where("large").where(F.col("depth") == depth).withColumn("trie", F.col("trie") + 1), again))
    dealt = parts[0]
    for p in parts[1:]:
        dealt = dealt.unionByName(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ("trie", "lead")):
            trie, depth, bits, own = (t.column(c).to_numpy() for c in ("trie", "depth", "bits", "id"))
            for k in np.unique(trie):
                at = np.flatnonzero(trie == k)
                at = at[np.argsort(bits[at].view(np.uint64))]
                a, b = trie_links(bits[at].view(np.uint64), depth[at], budget)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(own[at[a]]), pa.array(own[at[b]])], names=["a", "b"])

    return dealt.repartition(partitions(spark), "trie", "lead").sortWithinPartitions("trie", "lead").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 3, budget: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs (doc_id, text): component_id is the smallest doc_id reachable."""
    fps = cut(fingerprints(docs, size))
    known = fps.where("doc_id is not null")
    # The smallest doc_id stands for a fingerprint; the fingerprints of one doc_id hang together.
    nodes = cut(fps.groupBy(F.col("fp").alias("bits")).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("rows")))
    twice = known.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("doc_id")
    again = known.join(twice, "doc_id", "left_semi").join(nodes, F.col("fp") == F.col("bits")).select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    links = hamming_forest(nodes.where("id is not null").select("id", "bits"), budget)
    comp = connected_components(links.unionByName(again))
    whole = nodes.join(comp, "id", "left").select(F.col("bits").alias("fp"), "rows", F.least("id", F.coalesce("component", "id")).alias("component_id"))
    return join_keyed(fps, whole, "fp", "rows", fps.count()).select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of the shingles of WORDS words."""
    return np.unique(shingle_hashes(text, WORDS))


def set_key(hashes: np.ndarray) -> int:
    """Stands for a set of shingles."""
    return xxhash.xxh3_64_intdigest(hashes.astype("<u8").tobytes(), SEED)


def wide_fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """Two words: a bit is 1 if it is set in over half of the hashes, then in over half of the hashes mixed once more."""
    out = []
    for salt in (None, 0x9E3779B97F4A7C15):
        h = hashes
        if salt:
            h = (h ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(32))
        ones = np.zeros(BITS, dtype=np.int64)
        for k in range(0, len(h), 1 << 16):
            ones += np.unpackbits(h[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]))
    return out[0], out[1]


WIDE = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "x", "y", "n")])


def wide_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, key, x, y, n): the set key, the wide fingerprint and the size of the set of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", 4 << 20):
                rows = [(set_key(s), *wide_fingerprint(s), len(s)) for s in map(shingle_set, part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c.view(np.int64)) for c in np.array(rows, dtype=np.uint64).T.copy())], names=["doc_id", *WIDE.names])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *WIDE]))


def tries(n: int) -> np.ndarray:
    """The leading bits of each trie over n fingerprints: so many that a node has about NODE, in so many tries that at
    most MISSED of the pairs of two sets of one size at SIMILAR are together below none of them."""
    depth = min(max(ceil(log2(max(n, 1) / NODE)), 6), 32)
    same = 1 - acos(2 * SIMILAR / (1 + SIMILAR)) / pi
    return np.stack([np.random.default_rng([SEED, k]).permutation(WIDE_BITS)[:depth] for k in range(ceil(log(MISSED) / log(1 - same**depth)))])


def candidates(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between keys of nodes (key, x, y, n) that connect all whose fingerprints meet below a node of a trie, differ
    in WIDE_BUDGET bits or fewer, and whose sizes allow the similarity; a forest below each node, not all pairs."""
    names = ["slot", *WIDE.names]
    leads = tries(nodes.count())
    depth = leads.shape[1]

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.stack([np.asarray(batch.column(c)) for c in ("x", "y")], axis=1)
            bits = np.unpackbits(np.ascontiguousarray(words).astype("<i8").view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")
            for k, chosen in enumerate(leads):
                slot = bits[:, chosen].astype(np.int64) @ (1 << np.arange(depth)) + (k << depth)
                yield pa.RecordBatch.from_arrays([pa.array(slot), *(batch.column(c) for c in names[1:])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ("slot",)):
            slot, key, x, y, n = (t.column(c).to_numpy() for c in names)
            x, y = x.view(np.uint64), y.view(np.uint64)
            a, b = run_forest(slot, lambda i, j: (hamming(x, y, i, j) <= WIDE_BUDGET) & (np.minimum(n[i], n[j]) >= SIMILAR * np.maximum(n[i], n[j])))  # noqa: B023
            yield pa.RecordBatch.from_arrays([pa.array(key[a]), pa.array(key[b])], names=["a", "b"])

    rows = nodes.select(*names[1:]).mapInArrow(plant, ", ".join(f"{c} long" for c in names))
    return rows.repartition(partitions(nodes.sparkSession), "slot").sortWithinPartitions("slot", "key").mapInArrow(run, "a long, b long")


def set_links(sets: list[np.ndarray], block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of links that connect all sets with a Jaccard similarity of SIMILAR or more; of two blocks, only links between them."""
    m, size = len(sets), np.array([len(s) for s in sets])
    _, word, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), size)
    # Only shingles of two sets or more count, numbered anew.
    shared = count[word] > 1
    owner, word = owner[shared], (np.cumsum(count > 1) - 1)[word[shared]]
    both = np.zeros((m, m), dtype=np.float32)
    for start in range(0, int((count > 1).sum()), COLUMNS):
        own = (word >= start) & (word < start + COLUMNS)
        part = np.zeros((m, min(COLUMNS, int((count > 1).sum()) - start)), dtype=np.float32)
        part[owner[own], word[own] - start] = 1
        both += part @ part.T
    near = both >= SIMILAR * (size[:, None] + size[None] - both.astype(np.float64))
    if block[0] != block[-1]:
        near &= block[:, None] != block[None]
    a, b = np.nonzero(np.triu(near, 1))
    low = local_stars(m, a, b)
    far = np.flatnonzero(low != np.arange(m))
    return far, low[far]


def similar(docs: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Links (a, b) that connect all keys of nodes (key, n, id) whose sets are similar and that hang together by links.

    What hangs together is a family. Every set goes once to its family, or once for each pair of blocks of a large one, and
    all sets there are compared. Sets are made anew from the texts of the documents id that are asked for, which move nowhere.
    """
    spark = docs.sparkSession
    families = connected_components(links).select(F.col("id").alias("key"), F.col("component").alias("family"))
    members = cut(nodes.select("key", "n", "id").join(families, "key"))
    count = members.count()
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("hashes"))
    bound = F.least(F.greatest(8 * F.sqrt("rows"), F.lit(LEAST_BLOCK)), F.lit(BLOCK))
    sizes = sizes.select("family", "rows", F.ceil(F.greatest(F.col("rows") / bound, F.col("hashes") / BLOCK_HASHES)).cast("int").alias("blocks"))
    asked = spark.sparkContext.broadcast(Maybe(members, "id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()  # a task sends a set of a document once, unless it has sent SENT others since
        for batch in batches:
            for part in slices(batch.filter(pa.array(asked.value.has(batch.column("doc_id")))), "text", 4 << 20):
                found = [shingle_set(x) for x in part.column("text").to_pylist()]
                names = [(i, set_key(s)) for i, s in zip(part.column("doc_id").to_pylist(), found, strict=True)]
                new = [k for k, x in enumerate(names) if x not in sent and not sent.add(x)]
                if len(sent) > SENT:
                    sent.clear()
                part, found = part.take(pa.array(new, pa.int64())), [found[k] for k in new]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(np.array([set_key(s) for s in found], dtype=np.uint64).view(np.int64)), pa.array([s.tobytes() for s in found], pa.binary())], names=["id", "key", "hashes"])

    named = join_keyed(members.select("key", "id", "family"), sizes, "family", "rows", count)
    known = docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(sets, "id long, key long, hashes binary")
    sent = known.join(F.broadcast(named) if count <= BROADCAST_ROWS else named, ["key", "id"])
    sent = sent.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"b1": F.least("block", "other"), "b2": F.greatest("block", "other")})
    by = ("family", "b1", "b2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, by):
            # A row that repeats brings its set again.
            key, first = np.unique(t.column("key").to_numpy(), return_index=True)
            if len(key) > 1:
                order = first[np.argsort(t.column("block").to_numpy()[first], kind="stable")]
                hashes = t.column("hashes")
                a, b = set_links([np.frombuffer(hashes[i].as_buffer(), dtype=np.uint64) for i in order.tolist()], t.column("block").to_numpy()[order])
                key = t.column("key").to_numpy()[order]
                yield pa.RecordBatch.from_arrays([pa.array(key[a]), pa.array(key[b])], names=["a", "b"])

    return cut(sent.select("key", "hashes", "block", *by).repartition(partitions(spark), *by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of similar documents, that of the smallest doc_id, and all rows without doc_id.

    Of rows that share a doc_id, the one whose columns have the smallest hash stays. Texts move only where an id may go
    or repeats: a set of such ids is broadcast (see Maybe), and its rows alone are joined.
    """
    known = cut(wide_fingerprints(docs.where("doc_id is not null")))
    nodes = cut(known.groupBy(*WIDE.names).agg(F.min("doc_id").alias("id")))
    # The sets of one doc_id hang together.
    twice = known.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a <> z").select("doc_id", "a")
    links = similar(docs, nodes, candidates(nodes)).unionByName(known.join(twice, "doc_id").select("a", F.col("key").alias("b")))
    comp = connected_components(links).select(F.col("id").alias("key"), "component")
    heads = nodes.join(comp, "key", "left").groupBy(F.coalesce("component", "key").alias("component")).agg(F.min("id").alias("doc_id"))
    heads = cut(heads.select("doc_id"))
    rows = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(heads.withColumn("head", F.lit(True)), "doc_id", "left")
    unsure = docs.sparkSession.sparkContext.broadcast(Maybe(rows.where("head is null or n > 1"), "doc_id"))
    sure = filter_rows(docs, "text", lambda batch: ~unsure.value.has(batch.column("doc_id")))
    rest = filter_rows(docs, "text", lambda batch: unsure.value.has(batch.column("doc_id")))
    plain = [f.name for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant", "void"))]
    # Each task keeps one row of an id before any text moves.
    one = rest.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias("_near_row"))
    return sure.unionByName(one.join(heads, "doc_id", "left_semi").select("_near_row.*"))
