"""Benchmark decontamination with suffix arrays of the training documents.

Each shard (a few MB of documents) gets a suffix array over its words: the places of its suffixes, sorted
by their words as far as the longest test item goes. Every suffix of every test item is sought in it by
binary search, for all suffixes at once: by its first window, which gives the range of the places where a
match of at least a window's length starts. The longest match of such a place is found by going on with the
binary search, word by word, among the sorted test suffixes, until none agrees (reach()); the words that longest
matches cover are what counts. A place inside a match found before is skipped (in TURNS turns): what starts there either ends
with that match or is found at the first place after it. Only words of the benchmark's own vocabulary can match; others
end a suffix, which loses nothing. Test suffixes with the same window are sought as one, and windows of the
same items name them as one set, so a passage that stands in m documents and n items costs m + n, not m times
n. longest_matches() lists every place with every item.

Lower-cases A-Z; words are runs of ASCII letters and digits and of all characters from U+0080. Null
and empty texts have no words. Rows that repeat an item_id are one item, rows that repeat a doc_id
are documents of their own; a null item_id marks words but is not listed. Texts of any length are read
whole; one longer than a shard is a shard. Empty documents give an empty result, an empty benchmark
marks nothing. Columns that are added replace those of the same names; clean_documents() adds none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filter_rows, slices, with_columns

#: Words of a window.
WINDOW = 10
#: How often the first place of each run of matching places is taken before all of them are.
TURNS = 8
#: Bytes of benchmark texts in one index; a larger benchmark is sought block by block.
BLOCK_BYTES = 16 << 20
#: Bytes of documents in a shard, and in those that are held while several blocks are sought one after the other.
SHARD_BYTES, HELD_BYTES = 4 << 20, 64 << 20

TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def suffix_array(ids: np.ndarray, least: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, words up to the next 0) of the suffixes of ids that have least words, in the order of their first depth words.

    Ranks by four words (two of a large vocabulary) come from one sort; those still tied are sorted on by the rank of what follows,
    which doubles the words that count.
    """
    gaps = np.flatnonzero(ids == 0)
    known = np.flatnonzero(ids)
    end = np.searchsorted(gaps, known)
    # Only runs that are long enough, but with their tails, as these rank what is before them.
    long = gaps[end] - np.where(end, gaps[end - 1] + 1, 0) >= least
    place, run = known[long], (gaps[end] - known)[long]
    n = len(place)
    if not n:
        return place, run
    step = 4 if ids.max() < 1 << 16 else 2
    key = np.zeros(n, dtype=np.uint64)
    for k in range(step):
        key = (key << np.uint64(64 // step)) | np.where(run > k, ids[np.minimum(place + k, len(ids) - 1)], 0).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    # The rank of a suffix is the place of its group in the order, from 1 on; 0 is the end of a suffix.
    rank = np.zeros(len(ids), dtype=np.int64)
    rank[place[order]] = np.repeat(first, np.diff(np.append(first, n))) + 1
    tied = np.flatnonzero(np.repeat(np.diff(np.append(first, n)) > 1, np.diff(np.append(first, n))))
    while len(tied) and step < depth:
        own = order[tied]
        p = place[own]
        after = np.where(run[own] > step, rank[np.minimum(p + step, len(ids) - 1)], 0)
        again = np.lexsort((after, rank[p]))
        order[tied] = own[again]
        p, after = p[again], after[again]
        group = rank[p]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(p)))
        rank[p] = np.repeat(tied[first], size) + 1
        tied = tied[np.repeat(size > 1, size)]
        step *= 2
    kept = run[order] >= least
    return place[order][kept], run[order][kept]


class Index:
    """The suffixes of some items: distinct windows by their length, each with its (item, place) pairs and the number of its set of items."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.window, self.vocabulary, self.ids = window, {}, sorted({str(i) for i, _ in items if i is not None})
        number = {x: k for k, x in enumerate(self.ids)}
        found: dict[int, dict[tuple, list]] = {}
        self.texts: list[np.ndarray] = []
        owner: list[int] = []
        for item, text in items:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words(text)]
            size = min(window, len(w))
            self.texts.append(np.array(w, dtype=">u4"))
            owner.append(number[str(item)] if item is not None else -1)
            for j in range(len(w) - size + 1 if size else 0):
                found.setdefault(size, {}).setdefault(tuple(w[j : j + size]), []).append((len(self.texts) - 1, j))
        self.owner = np.array(owner, dtype=np.int64)
        self.depth = max(map(len, self.texts), default=0)
        self.kind = np.dtype(">u2" if len(self.vocabulary) < 1 << 16 else ">u4")
        self.sets: list[tuple[int, ...]] = []
        named: dict[tuple[int, ...], int] = {}
        self.by_size = []
        for size, at in sorted(found.items()):
            order = sorted(at)
            groups = []
            for k in order:
                own = tuple(sorted({owner[t] for t, _ in at[k]} - {-1}))
                groups.append(named.setdefault(own, len(named)))
            self.by_size.append((size, self.packed(np.array(order, dtype=self.kind)), np.array(groups), [at[k] for k in order]))
        self.sets = list(named)
        # All test suffixes in their order, and for each window the range of those that begin with it.
        self.words = np.concatenate([np.append(t.astype(np.uint32), np.uint32(0)) for t in self.texts] or [np.zeros(1, np.uint32)])
        self.suffixes, _ = suffix_array(self.words, 1, max(self.depth, 1))
        self.begin = {size: (np.searchsorted(heads, windows, "left"), np.searchsorted(heads, windows, "right")) for size, windows, _, _ in self.by_size for heads in [self.packed(self.leading(size))]}

    def leading(self, size: int) -> np.ndarray:
        """The first words of each test suffix, 0 behind its end."""
        out = np.zeros((len(self.suffixes), size), dtype=self.kind)
        alive = np.ones(len(self.suffixes), dtype=bool)
        for k in range(size):
            w = self.words[np.minimum(self.suffixes + k, len(self.words) - 1)]
            alive &= w > 0
            out[:, k] = np.where(alive, w, 0)
        return out

    def reach(self, ids: np.ndarray, place: np.ndarray, size: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Words of the longest match of each place of ids with a test suffix, given the range of those that agree in size words."""
        n, on, k = np.full(len(place), size), np.arange(len(place)), size
        low, high = low.copy(), high.copy()
        last = len(self.words) - 1

        def bound(word: np.ndarray, a: np.ndarray, z: np.ndarray, right: bool) -> np.ndarray:
            """The first suffix of each range whose word k is not less than word, or more."""
            a, z = a.copy(), z.copy()
            while (open_ := a < z).any():
                mid = (a + z) >> 1
                w = self.words[np.minimum(self.suffixes[np.minimum(mid, len(self.suffixes) - 1)] + k, last)]
                less = open_ & ((w <= word) if right else (w < word))
                a, z = np.where(less, mid + 1, a), np.where(open_ & ~less, mid, z)
            return a

        while len(on):
            word = ids[np.minimum(place[on] + k, len(ids) - 1)]
            a = bound(word, low[on], high[on], False)
            z = bound(word, a, high[on], True)
            go = (z > a) & (word > 0)
            on = on[go]
            low[on], high[on] = a[go], z[go]
            k += 1
            n[on] = k
        return n

    def packed(self, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows).view(f"S{rows.shape[1] * self.kind.itemsize}").ravel()

    def search(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
        """Starts of the documents, their words as numbers, the suffix array, and for each length of windows
        (length, those that occur, first and end of their ranges)."""
        get = self.vocabulary.get
        ids = np.zeros(sum(map(len, docs)) + len(docs) + self.window, dtype=np.uint32)
        starts, at = np.zeros(len(docs) + 1, dtype=np.int64), 0
        for k, d in enumerate(docs):
            ids[at : at + len(d)] = [get(x, 0) for x in d]
            at += len(d) + 1
            starts[k + 1] = at
        place, run = suffix_array(ids, min((s for s, *_ in self.by_size), default=self.window), self.depth)
        keys = np.zeros((len(place), self.window), dtype=self.kind)
        for k in range(self.window):
            keys[:, k] = np.where(run > k, ids[place + k], 0)
        out = []
        if len(place):
            keys = self.packed(keys)
            for size, windows, _, _ in self.by_size:
                width = size * self.kind.itemsize
                head = keys if size == self.window else np.ascontiguousarray(keys.view(np.uint8).reshape(len(keys), -1)[:, :width]).view(f"S{width}").ravel()
                left, right = np.searchsorted(head, windows, "left"), np.searchsorted(head, windows, "right")
                there = np.flatnonzero(right > left)
                out.append((size, there, left[there], right[there]))
        return starts, ids, place, out

    def find(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """starts; (place, words) of longest matches that cover all that match; distinct (document, number of a set of items)."""
        starts, ids, place, ranges = self.search(docs)
        hits, sets = [np.zeros((0, 2), dtype=np.int64)], [np.zeros((0, 2), dtype=np.int64)]
        for (_, _, groups, _), (size, there, left, right) in zip(self.by_size, ranges, strict=False):
            n = right - left
            pos = place[np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())]
            low, high = (np.repeat(x[there], n) for x in self.begin[size])
            order = np.argsort(pos)
            rest, low, high = pos[order], low[order], high[order]
            for turn in range(TURNS + 1):
                # The first place of each run of neighbours, as what its match holds is done with; in the end all that is left.
                first = np.flatnonzero(np.diff(rest, prepend=-2) > 1) if turn < TURNS else np.arange(len(rest))
                # An item of fewer words than a window counts as a whole only.
                long = self.reach(ids, rest[first], size, low[first], high[first]) if size == self.window else np.full(len(first), size)
                hits.append(np.stack([rest[first], long], axis=1))
                run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rest))))
                left_over = rest > (rest[first] + long - size)[run]
                rest, low, high = rest[left_over], low[left_over], high[left_over]
            sets.append(np.unique(np.stack([np.searchsorted(starts, pos, "right") - 1, np.repeat(groups[there], n)], axis=1), axis=0))
        return starts, np.concatenate(hits), np.concatenate(sets)

    def longest(self, docs: list[list[bytes]]) -> Iterator[tuple[int, int, int, int, int]]:
        """(doc, text number, first word in doc, first word in item, words) of every match that cannot be made longer at either end."""
        starts, ids, place, ranges = self.search(docs)
        for (_, _, _, owners), (size, there, left, right) in zip(self.by_size, ranges, strict=False):
            for w, lo, hi in zip(there.tolist(), left.tolist(), right.tolist(), strict=True):
                for t, j in owners[w]:
                    item, p = self.texts[t], place[lo:hi]
                    if j:
                        p = p[(p == 0) | (ids[p - 1] != item[j - 1])]
                    n = np.full(len(p), size)
                    on = np.arange(len(p))
                    for k in range(size, len(item) - j):
                        on = on[ids[p[on] + k] == item[j + k]]
                        if not len(on):
                            break
                        n[on] += 1
                    d = np.searchsorted(starts, p, "right") - 1
                    yield from ((x, t, y, j, z) for x, y, z in zip(d.tolist(), (p - starts[d]).tolist(), n.tolist(), strict=True))


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[Broadcast]:
    """Broadcast indexes over the benchmark; each holds about block_bytes of texts, whatever the size of the whole.

    The driver builds one after the other and keeps none; a worker holds one at a time, see held().
    """
    b = benchmark.select("item_id", "text")
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    part = F.pmod(F.xxhash64("item_id"), F.lit(n))
    return [b.sparkSession.sparkContext.broadcast(Index([(r.item_id, r.text) for r in (b if n == 1 else b.where(part == k)).collect()])) for k in range(n)]


def held(found: list[Broadcast]) -> Iterator[Index]:
    """The indexes, each let go before the next is read from the executor's disk, unless there is but one."""
    for b in found:
        yield b.value
        if len(found) > 1:
            b.__dict__.pop("_value", None)


def at_a_time(found: list[Broadcast]) -> int:
    """Bytes of documents for which the blocks are read once."""
    return min(HELD_BYTES, SHARD_BYTES * len(found))


HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())])


def overlap(found: list[Broadcast], w: list[list[bytes]]) -> tuple[np.ndarray, list[set[str]]]:
    """Number of words of each document that a match with the broadcast indexes covers, and the items that match."""
    items: list[set[str]] = [set() for _ in w]
    edge = starts = None
    for index in held(found):
        starts, hits, sets = index.find(w)
        if edge is None:
            edge = np.zeros(starts[-1] + WINDOW + 1, dtype=np.int64)
        np.add.at(edge, hits[:, 0], 1)
        np.add.at(edge, hits.sum(axis=1), -1)
        for d, s in sets.tolist():
            items[d].update(index.ids[i] for i in index.sets[s])
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge) > 0)])
    return covered[starts[1:]] - covered[starts[:-1]], items


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated; columns of these names are replaced."""
    found = blocks(benchmark)

    def run(batch: pa.RecordBatch) -> dict:
        w = [words(x) for x in batch.column("text").to_pylist()]
        n_hit, items = overlap(found, w)
        return {
            "n_words": pa.array([len(x) for x in w], pa.int64()),
            "n_hit": pa.array(n_hit, pa.int64()),
            "n_items": pa.array([len(x) for x in items], pa.int64()),
            "items_sha256": pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]),
            "contaminated": pa.array(n_hit > 0),
        }

    return with_columns(docs, "text", HITS, run, at_a_time(found))


def longest_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words) of every verbatim match of at least a window that cannot be made
    longer. This lists each place with each item; decontaminate() and clean_documents() need no such list."""
    found = blocks(benchmark)
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", SHARD_BYTES):
                w = [words(x) for x in part.column("text").to_pylist()]
                for index in held(found):
                    rows = [m for m in index.longest(w) if index.owner[m[1]] >= 0]
                    ids = part.column("doc_id").take(pa.array([m[0] for m in rows], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([index.ids[index.owner[m[1]]] for m in rows], pa.string()), *(pa.array([m[k] for m in rows], pa.int64()) for k in (2, 3, 4))], names=["doc_id", "item_id", "doc_word", "item_word", "n_words"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField("doc_id", kind), T.StructField("item_id", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("doc_word", "item_word", "n_words"))]))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a match of at least a window of the benchmark."""
    found = blocks(benchmark)
    return filter_rows(docs, "text", lambda batch: overlap(found, [words(x) for x in batch.column("text").to_pylist()])[0] == 0, at_a_time(found))
