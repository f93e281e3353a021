"""Suffix-array deduplication of byte strings that stand in an earlier document too.

Every byte covered by a string of `length` bytes that also starts in a document with a smaller
doc_id goes. Of all suffixes, only those that can matter are sorted:

1. Anchors. In each string of `length` bytes the leftmost least-hashed 16-gram is its anchor, so
   equal strings have equal anchors at equal places, and about one position in 18 is one. Their
   hashes meet in buckets; an anchor that one document only has is dropped.
2. Suffixes. The strings around each anchor that is left go to a bucket by the leading bytes of the
   anchor's suffix: splitters are quantiles of a bounded sample. An anchor with more than HOT
   occurrences cannot be split by these; its suffixes are dealt out one by one, by longer splitters
   that compare all bytes of a string, and equal strings are reduced to their first document, in each slice
   before and again as they come in, so a line that stands in every slice is never held whole. Splitters lie between strings, never within a run of equal ones, so what a comparison across
   a bucket's boundary would have to find, equal strings on both sides, is always on one side.
3. Each bucket sorts its suffixes with multikey quicksort, eight bytes at a time; runs of equal
   strings give the first document of each. Runs of up to SMALL rows are left to a plain sort.
4. The documents are cut where their strings have an earlier document.

Rows are packed into compressed blocks between these steps, so what is shuffled is the texts twice,
a few bytes for each anchor, and the strings that are in several documents.

Null texts are empty. Rows that repeat a doc_id are one document: none of them is earlier than the
other. A null doc_id is earlier than none, and nothing is removed from it. Texts are processed whole;
matches never cross documents. An empty table gives an empty one; other columns of the input are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_hash, partitions, slices
from .mixing import shuffle_key

LENGTH = 50
#: Bytes of an anchor.
GRAM = 16
#: Bytes of documents that are hashed at a time, and in a slice.
PIECE, SLICE = 1 << 16, 4 << 20
#: Occurrences above which an anchor's strings are dealt out one by one: in all, and in a slice of documents.
HOT, OFTEN = 4_096, 64
#: Documents in the sample from which splitters are taken, and anchors of each.
SAMPLE, EACH = 1_000, 128
#: Bytes of a bucket that a task holds before it settles what it can.
HELD_BYTES = 256 << 20
#: Rows that the quicksort leaves to a plain sort, and segments that are sorted at a time.
SMALL, SEGMENTS = 1 << 10, 8_000

Arrays = dict[str, np.ndarray]


@functools.cache
def codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=5), zstandard.ZstdDecompressor()


def pack(arrays: Arrays) -> bytes:
    """Arrays as one compressed block, bytes of equal significance side by side."""
    head = json.dumps({k: [v.dtype.str, len(v)] for k, v in arrays.items()}).encode()
    body = b"".join(np.ascontiguousarray(v).view(np.uint8).reshape(len(v), -1).T.tobytes() if len(v) else b"" for v in arrays.values())
    return codec()[0].compress(len(head).to_bytes(4, "little") + head + body)


def unpack(block: bytes) -> Arrays:
    raw = codec()[1].decompress(block)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = {}
    for k, (kind, n) in json.loads(raw[4:at]).items():
        width = np.dtype(kind).itemsize
        out[k] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel() if n else np.zeros(0, kind)
        at += n * width
    return out


def joined(parts: list[Arrays]) -> Arrays:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def gathered(blocks: list[bytes]) -> Arrays:
    return joined([unpack(b) for b in blocks])


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] numbers, then those from start[1], and so on."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def spread(h: np.ndarray) -> np.ndarray:
    """Anchors have the least hashes of their strings; mixed once more, they fill all buckets alike."""
    return (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


def anchors(data: list[bytes], length: int) -> Arrays:
    """doc, order (in its document), at, first, last, hash of each anchor of the byte strings data: it is
    the anchor of the strings that start from first to last. All places count from the document's start."""
    pieces = [(d, o, x[o : o + PIECE + length - 1]) for d, x in enumerate(data) for o in range(0, max(1, len(x) - length + 1), PIECE) if len(x) - o >= length]
    out: list[Arrays] = []
    k = 0
    while k < len(pieces):
        size, j = 0, k
        while j < len(pieces) and (j == k or size + len(pieces[j][2]) <= 2 * PIECE):
            size += len(pieces[j][2])
            j += 1
        group, k = pieces[k:j], j
        raw = b"".join(p[2] for p in group) + bytes(GRAM)
        word = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,)).copy()
        h = word[: len(raw) - GRAM] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += word[8 : len(raw) - GRAM + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        # The place in the low bits makes the leftmost of equal hashes the least.
        least = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        span, width = 1, length - GRAM + 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if width > span:
            least = np.minimum(least[: -(width - span)], least[width - span :])
        edges = np.cumsum([0, *(len(p[2]) for p in group)])
        start = ranges(edges[:-1], edges[1:] - edges[:-1] - length + 1)
        at = (least[start] & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1])]))
        last = np.append(first[1:], len(at)) - 1
        piece = np.searchsorted(edges, at[first], "right") - 1
        shift = np.array([p[1] for p in group])[piece] - edges[piece]
        out.append({"doc": np.array([p[0] for p in group])[piece], "at": at[first] + shift, "first": start[first] + shift, "last": start[last] + shift, "hash": spread(h[at[first]])})
    if not out:
        return {n: np.zeros(0, np.int64) for n in ("doc", "order", "at", "first", "last")} | {"hash": np.zeros(0, np.uint64)}
    a = joined(out)
    a["order"] = np.arange(len(a["doc"])) - np.searchsorted(a["doc"], a["doc"])
    return a


def by_key(key: np.ndarray, arrays: Arrays) -> Iterator[tuple[int, Arrays]]:
    """The rows of arrays with each value of key."""
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    edges = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
    for lo, hi in zip(edges, [*edges[1:], len(key)], strict=True):
        yield int(sorted_key[lo]), {k: v[order[lo:hi]] for k, v in arrays.items()}


def small_order(words: np.ndarray) -> np.ndarray:
    """Order of few rows: by the first character, then all ties at once by the next, until none is left."""
    n, m = words.shape
    order, new = np.arange(n), np.zeros(n + 1, bool)
    new[[0, n]] = True
    for k in range(m):
        tied = np.flatnonzero(~(new[:-1] & new[1:]))
        if not len(tied):
            break
        own = order[tied]
        group = np.cumsum(new[:-1])[tied].astype(np.uint16)
        by_word = np.argsort(words[own, k])
        own = own[by_word[np.argsort(group[by_word], kind="stable")]]
        order[tied] = own
        w = words[own, k]
        new[tied[1:]] |= w[1:] != w[:-1]
    return order


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of the rows of words (rows x 64-bit characters): three-way quicksort on one character after the other."""
    n, m = words.shape
    order = np.arange(n)
    stack = [(0, n, 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2 or depth == m:
            continue
        own = order[lo:hi]
        if hi - lo <= SMALL:
            order[lo:hi] = own[small_order(words[own, depth:])]
            continue
        key = words[own, depth]
        pivot = np.sort(key[:: max(1, len(key) // 15)])[8]
        less, more = key < pivot, key > pivot
        order[lo:hi] = np.concatenate([own[less], own[~(less | more)], own[more]])
        a, b = lo + int(less.sum()), hi - int(more.sum())
        stack += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def classes(rows: np.ndarray) -> np.ndarray:
    """Number of the class of equal rows of each row of bytes (rows x width), in sorted order."""
    n, width = rows.shape
    full = np.zeros((n, -(-width // 8) * 8), np.uint8)
    full[:, :width] = rows
    words = full.view(">u8").astype(np.uint64)
    del full
    order = multikey_order(words)
    s = words[order]
    out = np.zeros(n, np.int64)
    out[order] = np.cumsum(np.concatenate([[False], (s[1:] != s[:-1]).any(axis=1)])) if n else 0
    return out


def padded(data: np.ndarray) -> np.ndarray:
    """data with room for a row of matrix() at its last place."""
    return np.concatenate([data, np.zeros(2 * 255, np.uint8)])


def matrix(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Rows of width bytes from padded data at start, of which size count; the others are 0."""
    rows = np.lib.stride_tricks.sliding_window_view(data, width)[start]
    rows[np.arange(width) >= size[:, None]] = 0
    return rows


def first_documents(string: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each row the smallest doc of those with its string (a class number)."""
    least = np.full(int(string.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, string, doc)
    return least[string]


def spans_of(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, length: int) -> Arrays:
    """Covered bytes (from, to) of strings at start: runs of neighbours in a document as one."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start = doc[order], tag[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > start[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1 if len(doc) else first
    return {"doc": doc[first], "tag": tag[first], "from": start[first], "to": start[last] + length}


def resolve(a: Arrays, length: int) -> Iterator[Arrays]:
    """Spans to remove, out of a bucket's segments: doc, tag, start, n (strings), head (place of the bytes by
    which it was dealt out), data (the bytes of all of them). Equal strings have equal heads, so the segments
    are sorted in runs of whole heads."""
    size = a["n"].astype(np.int64) + length - 1
    at = np.cumsum(size) - size
    data = padded(a.pop("data"))
    head = matrix(data, at + a["head"], np.full(len(at), 8), 8).view(">u8").ravel()
    order = np.argsort(head, kind="stable")
    ends = np.append(np.flatnonzero(head[order][1:] != head[order][:-1]) + 1, len(order))
    lo = 0
    while lo < len(order):
        hi = int(ends[min(np.searchsorted(ends, lo + SEGMENTS), len(ends) - 1)])
        own = order[lo:hi]
        yield resolved({k: a[k][own] for k in ("doc", "tag", "start", "n")}, data, at[own], size[own], length)
        lo = hi


def resolved(a: Arrays, data: np.ndarray, at: np.ndarray, size: np.ndarray, length: int) -> Arrays:
    rows = matrix(data, at, size, 2 * length - GRAM)
    whole = classes(np.concatenate([rows, a["n"][:, None].astype(np.uint8)], axis=1))
    del rows
    low = first_documents(whole, a["doc"])
    _, one = np.unique(whole, return_index=True)
    n = a["n"][one].astype(np.int64)
    begin = ranges(at[one], n)
    string = classes(matrix(data, begin, np.full(len(begin), length), length))
    earlier = first_documents(string, np.repeat(low[one], n)) < np.repeat(low[one], n)
    base = (np.cumsum(n) - n)[whole]
    full = ranges(base, a["n"].astype(np.int64))
    row = np.repeat(np.arange(len(whole)), a["n"])
    gone = earlier[full] | (a["doc"] > low)[row]
    row, step = row[gone], (full - base[row])[gone]
    return spans_of(a["doc"][row], a["tag"][row], a["start"][row] + step, length)


def utf8(x: str | None) -> bytes:
    return (x or "").encode("utf-8", "surrogatepass")


def tag_of(data: bytes) -> int:
    """Tells apart texts under one doc_id."""
    return xxhash.xxh64_intdigest(data) >> 32


PACKED = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("block", T.BinaryType())])
#: Kinds of packed rows: for a bucket of documents, documents, and for a bucket of anchors or strings.
TO_DOCS, DOCUMENTS, TO_STRINGS = 0, 1, 2


def packed_rows(found: Iterator[tuple[int, int, Arrays]]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, int, bytes]] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=PACKED.names)

    for b, k, x in found:
        rows.append((b, k, pack(x)))
        if len(rows) == 1_000:
            yield batch()
            rows.clear()
    if rows:
        yield batch()


def to_docs(arrays: Arrays, n: int) -> Iterator[tuple[int, int, Arrays]]:
    """arrays, by the bucket of doc."""
    for b, x in by_key(id_hash(arrays["doc"]) % n, arrays):
        yield b, TO_DOCS, x


def dealt(packed: DataFrame) -> DataFrame:
    """Packed rows in one partition for each bucket."""
    n = partitions(packed.sparkSession)
    return packed.repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int"))


def ragged(data: np.ndarray, size: np.ndarray, key: np.ndarray, arrays: Arrays) -> Iterator[tuple[int, Arrays]]:
    """by_key for rows that have runs of size bytes, one after the other, in data."""
    at = np.cumsum(size) - size
    for b, x in by_key(key, arrays | {"size": size, "at": at}):
        place = x.pop("at")
        yield b, x | {"data": data[ranges(place, x["size"])]}


def packed_documents(docs: DataFrame, n: int) -> DataFrame:
    """docs (id, text) as packed rows for their buckets."""

    def found(part: pa.RecordBatch) -> Iterator[tuple[int, int, Arrays]]:
        data = [utf8(x) for x in part.column("text").to_pylist()]
        ids = part.column("id").to_numpy()
        for b, x in ragged(np.frombuffer(b"".join(data), np.uint8), np.array([len(x) for x in data], np.int64), id_hash(ids) % n, {"id": ids}):
            yield b, DOCUMENTS, x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", SLICE):
                yield from packed_rows(found(part))

    return docs.mapInArrow(run, PACKED)


def with_blocks(docs: DataFrame, blocks: DataFrame, n: int, work: Callable[[list[tuple[int, bytes]], Arrays | None], Iterator[pa.RecordBatch]], out: T.StructType) -> DataFrame:
    """Deal docs (id, text) and blocks out by bucket; work gets a few MB of documents at a time and their bucket's arrays."""
    rows = dealt(packed_documents(docs, n).unionByName(blocks)).sortWithinPartitions("bucket", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blocks, arrays = None, [], None
        held: list[tuple[int, bytes]] = []
        size = 0
        for batch in batches:
            for b, kind, block in zip(*(batch.column(c).to_pylist() for c in PACKED.names), strict=True):
                if held and (b != bucket or size > SLICE):
                    yield from work(held, arrays)
                    held, size = [], 0
                if b != bucket:
                    bucket, blocks, arrays = b, [], None
                if kind == TO_DOCS:
                    blocks.append(block)
                    continue
                if blocks:
                    arrays, blocks = gathered(blocks), []
                x = unpack(block)
                raw, edge = x["data"].tobytes(), np.cumsum([0, *x["size"]]).tolist()
                held += [(i, raw[s:e]) for i, s, e in zip(x["id"].tolist(), edge[:-1], edge[1:], strict=True)]
                size += len(raw)
        if held:
            yield from work(held, arrays)

    return rows.mapInArrow(run, out)


def by_string(packed: DataFrame, work: Callable[[Arrays], Iterator[tuple[int, int, Arrays]]], settle: Callable[[Arrays], tuple[Arrays, Iterator[tuple[int, int, Arrays]]]]) -> DataFrame:
    """work on the arrays of each bucket of anchors or strings; rows for documents pass through.

    Each time a bucket holds HELD_BYTES, settle returns what has still to be held of it, and the rows for documents that
    need not wait: so what stands in every slice of the documents is reduced as it comes, and never held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Blocks stay packed until they are worked on; left is what settle has left of those before.
        bucket, blocks, left, size, bound = None, [], [], 0, HELD_BYTES

        def whole() -> Arrays:
            parts = left + [unpack(b) for b in blocks]
            blocks.clear()
            left.clear()
            return joined(parts)

        for batch in batches:
            kind = batch.column("kind").to_numpy()
            if (kind == TO_DOCS).any():
                yield batch.filter(pa.array(kind == TO_DOCS))
            mine = batch.filter(pa.array(kind == TO_STRINGS))
            for b, block in zip(mine.column("bucket").to_pylist(), mine.column("block").to_pylist(), strict=True):
                if b != bucket:
                    if blocks or left:
                        yield from packed_rows(work(whole()))
                    bucket, size, bound = b, 0, HELD_BYTES
                blocks.append(block)
                size += zstandard.frame_content_size(block)
                if size > bound:
                    rest, rows = settle(whole())
                    yield from packed_rows(rows)
                    left.append(rest)
                    size = bytes_of(rest)
                    bound = max(HELD_BYTES, 2 * size)
        if blocks or left:
            yield from packed_rows(work(whole()))

    return dealt(packed).sortWithinPartitions("bucket").mapInArrow(run, PACKED)


def bytes_of(a: Arrays) -> int:
    return sum(v.nbytes for v in a.values())


def settled_strings(a: Arrays, length: int, n: int) -> tuple[Arrays, Iterator[tuple[int, int, Arrays]]]:
    """Of strings that were dealt out one by one, only those of the first document with each are held on."""
    size = a["n"].astype(np.int64) + length - 1
    at = np.cumsum(size) - size
    data = padded(a["data"])
    one = np.flatnonzero((a["n"] == 1) & (a["head"] == 0))
    # In runs of whole leading bytes, so that little is sorted at a time.
    head = matrix(data, at[one], np.full(len(one), 8), 8).view(">u8").ravel()
    order = np.argsort(head, kind="stable")
    ends = np.append(np.flatnonzero(head[order][1:] != head[order][:-1]) + 1, len(order))
    del head
    keep, lo = np.ones(len(size), bool), 0
    while lo < len(order):
        hi = int(ends[min(np.searchsorted(ends, lo + SEGMENTS), len(ends) - 1)])
        own = one[order[lo:hi]]
        keep[own] = a["doc"][own] <= first_documents(classes(matrix(data, at[own], size[own], length)), a["doc"][own])
        lo = hi
    gone = np.flatnonzero(~keep)
    left = {k: a[k][keep] for k in a if k != "data"} | {"data": a["data"][np.repeat(keep, size)]}
    return left, to_docs(spans_of(a["doc"][gone], a["tag"][gone], a["start"][gone], length), n) if len(gone) else iter(())


def shared_anchors(docs: DataFrame, length: int, n: int, often: int, hot: int) -> DataFrame:
    """Packed (doc, order, hot) of the anchors that may be in several documents, for buckets of documents.

    An anchor that a slice of documents has more than often times is settled there: it is hot, and one
    row tells the others. So no bucket gets more than often rows of an anchor from a slice.
    """

    def found(part: pa.RecordBatch) -> Iterator[tuple[int, int, Arrays]]:
        ids = part.column("id").to_numpy()
        a = anchors([utf8(x) for x in part.column("text").to_pylist()], length)
        order = np.argsort(a["hash"], kind="stable")
        h, doc, number = a["hash"][order], ids[a["doc"][order]], a["order"][order]
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        count = np.diff(np.append(edge, len(h)))
        many = np.repeat(count > often, count)
        if many.any():
            yield from to_docs({"doc": doc[many], "order": number[many].astype(np.uint32), "hot": np.ones(many.sum(), np.uint8)}, n)
        first = np.zeros(len(h), bool)
        first[edge] = True
        send = ~many | first
        h, doc, number, many = h[send], doc[send], number[send], many[send]
        bucket = ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
        for b, x in by_key(bucket, {"low": (h >> np.uint64(16)).astype(np.uint32), "mid": h.astype(np.uint16), "doc": doc, "order": number.astype(np.uint32), "hot": many.astype(np.uint8)}):
            yield b, TO_STRINGS, x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", SLICE):
                yield from packed_rows(found(part))

    def judged(x: Arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The order of the rows by anchor; for each in that order whether it is the first of its anchor, and whether that is shared and hot."""
        h = (x["low"].astype(np.uint64) << np.uint64(16)) | x["mid"]
        order = np.argsort(h, kind="stable")
        h, doc = h[order], x["doc"][order]
        first = np.concatenate([[True], h[1:] != h[:-1]])
        edge = np.flatnonzero(first)
        count = np.diff(np.append(edge, len(h)))
        told = np.maximum.reduceat(x["hot"][order], edge) > 0
        shared = np.repeat(told | (np.minimum.reduceat(doc, edge) != np.maximum.reduceat(doc, edge)), count)
        return order, first, shared, np.repeat(told | (count > hot), count)

    def answers(x: Arrays, order: np.ndarray, is_hot: np.ndarray) -> Iterator[tuple[int, int, Arrays]]:
        if len(order):
            yield from to_docs({"doc": x["doc"][order], "order": x["order"][order], "hot": is_hot.astype(np.uint8)}, n)

    def work(x: Arrays) -> Iterator[tuple[int, int, Arrays]]:
        order, _, shared, is_hot = judged(x)
        yield from answers(x, order[shared], is_hot[shared])

    def settle(x: Arrays) -> tuple[Arrays, Iterator[tuple[int, int, Arrays]]]:
        """Of an anchor that is shared and hot for certain, one row is held on, which tells so."""
        order, first, shared, is_hot = judged(x)
        sure = shared & is_hot
        x["hot"][order[sure]] = 1
        left = order[~sure | first]
        return {k: v[left] for k, v in x.items()}, answers(x, order[sure & ~first], is_hot[sure & ~first])

    return by_string(docs.mapInArrow(run, PACKED), work, settle)


def splitters(docs: DataFrame, length: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of the leading bytes of anchors and of whole strings, about EACH of a document, in a sample of about
    max(SAMPLE, n / 4) documents by a hash of the id."""
    share = max(SAMPLE, n // 4) / max(1, docs.count())
    chosen = docs.where(shuffle_key(F.col("id")) <= share * 2.0**60).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", SLICE):
                data = [utf8(x) for x in part.column("text").to_pylist()]
                a = anchors(data, length)
                step = np.maximum(1, np.bincount(a["doc"], minlength=len(data)) // EACH)[a["doc"]]
                own = a["order"] % step == 0
                # Of an anchor's strings, one at a place that changes from document to document.
                start = a["first"] + a["at"] % (a["last"] - a["first"] + 1)
                places = list(zip(a["doc"][own].tolist(), a["at"][own].tolist(), start[own].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([data[d][k : k + GRAM] for d, k, _ in places], pa.binary()), pa.array([data[d][k : k + length] for d, _, k in places], pa.binary())], names=["head", "whole"])

    rows = chosen.mapInArrow(run, "head binary, whole binary").collect()

    def quantiles(found: list[bytes], size: int) -> np.ndarray:
        s = np.sort(np.array(found, dtype=f"S{size}"))
        return s[np.arange(1, n) * len(s) // n] if len(s) else s

    return quantiles([bytes(r.head) for r in rows], GRAM), quantiles([bytes(r.whole) for r in rows], length)


def wanted(a: Arrays, ids: np.ndarray, c: Arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors in a that c asks for, and whether they are hot, and cool. Where rows of one id have different texts, c cannot
    tell their anchors apart, and one may be asked for as both."""
    known, rank = np.unique(c["doc"], return_inverse=True)
    key = (rank.astype(np.int64) << 32) | c["order"]
    order = np.argsort(key, kind="stable")
    key, hot = key[order], c["hot"][order] > 0
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key, any_hot, all_hot = key[edge], np.logical_or.reduceat(hot, edge), np.logical_and.reduceat(hot, edge)
    own = ids[a["doc"]]
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    mine = np.where(known[at] == own, (at << 32) | a["order"], -1)
    place = np.minimum(np.searchsorted(key, mine), len(key) - 1)
    pick = np.flatnonzero(key[place] == mine)
    return pick, any_hot[place[pick]], ~all_hot[place[pick]]


def strings(docs: DataFrame, shared: DataFrame, length: int, n: int) -> DataFrame:
    """Packed segments around the shared anchors, for buckets of strings, and spans that are settled here, for buckets of documents."""
    limits = docs.sparkSession.sparkContext.broadcast(splitters(docs, length, n))

    def segments(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, many: np.ndarray, head: np.ndarray, buf: np.ndarray, at: np.ndarray, route: np.ndarray | None = None) -> Iterator[tuple[int, int, Arrays]]:
        """at: place of each segment in buf; head: place in it of the bytes that equal strings share; route: bucket, if these do not tell."""
        lead = matrix(buf, at + head, np.full(len(head), GRAM), GRAM).view(f"S{GRAM}").ravel()
        route = np.searchsorted(limits.value[0], lead, "right") if route is None else route
        order = np.lexsort((lead, route))
        for b, x in by_key(route[order], {"doc": doc[order], "tag": tag[order], "start": start[order], "n": many[order], "head": head[order], "at": at[order]}):
            place = x.pop("at")
            yield b, TO_STRINGS, x | {"n": x["n"].astype(np.uint8), "head": x["head"].astype(np.uint8), "data": buf[ranges(place, x["n"] + length - 1)]}

    def found(held: list[tuple[int, bytes]], c: Arrays) -> Iterator[tuple[int, int, Arrays]]:
        data = [x for _, x in held]
        ids, tags = np.array([i for i, _ in held], np.int64), np.array([tag_of(x) for x in data], np.uint32)
        a = anchors(data, length)
        pick, hot, cool = wanted(a, ids, c)
        if not len(pick):
            return
        buf = padded(np.frombuffer(b"".join(data), np.uint8))
        edge = np.cumsum([0, *map(len, data)])
        doc, first, last, at = (a[k][pick] for k in ("doc", "first", "last", "at"))
        if cool.any():
            d = doc[cool]
            yield from segments(ids[d], tags[d], first[cool], last[cool] - first[cool] + 1, at[cool] - first[cool], buf, edge[d] + first[cool])
        if hot.any():
            d, many = np.repeat(doc[hot], last[hot] - first[hot] + 1), last[hot] - first[hot] + 1
            start = ranges(first[hot], many)
            rows = matrix(buf, edge[d] + start, np.full(len(d), length), length)
            string, route = classes(rows), np.searchsorted(limits.value[1], np.ascontiguousarray(rows).view(f"S{length}").ravel(), "right")
            later = ids[d] > first_documents(string, ids[d])
            if later.any():
                yield from to_docs(spans_of(ids[d[later]], tags[d[later]], start[later], length), n)
            d, start, route = d[~later], start[~later], route[~later]
            yield from segments(ids[d], tags[d], start, np.ones(len(d), np.int64), np.zeros(len(d), np.int64), buf, edge[d] + start, route)

    def work(held: list[tuple[int, bytes]], c: Arrays | None) -> Iterator[pa.RecordBatch]:
        if c is not None:
            yield from packed_rows(found(held, c))

    return with_blocks(docs, shared, n, work, PACKED)


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """The union of spans as maximal runs."""
    out: list[tuple[int, int]] = []
    order = np.argsort(start, kind="stable")
    for a, b in zip(start[order].tolist(), end[order].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


CUT = T.StructType([*(T.StructField(n, T.LongType()) for n in ("doc_id", "n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())])


def cut_batch(rows: list[tuple[int | None, bytes, list[tuple[int, int]]]], kept: bool) -> pa.RecordBatch:
    left = []
    for _, x, spans in rows:
        ends = [0, *(e for _, e in spans)]
        left.append(b"".join(x[e:s] for e, s in zip(ends, [*(s for s, _ in spans), len(x)], strict=True)))
    return pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([len(r[1]) - len(k) for r, k in zip(rows, left, strict=True)], pa.int64()),
        pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in left], pa.string()), pa.array(left if kept else [None] * len(rows), pa.binary()),
    ], names=CUT.names)


def remove_repeats(docs: DataFrame, length: int = LENGTH, often: int = OFTEN, hot: int = HOT, kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row of docs (doc_id, text).

    kept holds the remaining bytes if asked for, else null.
    """
    if not GRAM < length < 256:
        raise ValueError(f"length is from {GRAM + 1} to 255")
    n = partitions(docs.sparkSession)
    every = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    known = every.where("id is not null")
    found = strings(known, shared_anchors(known, length, n, often, hot), length, n)
    spans = by_string(found, lambda x: to_docs(joined(list(resolve(x, length))), n), lambda x: settled_strings(x, length, n))

    def work(held: list[tuple[int, bytes]], c: Arrays | None) -> Iterator[pa.RecordBatch]:
        rows = []
        if c is not None:
            order = np.argsort(c["doc"], kind="stable")
            c = {k: v[order] for k, v in c.items()}
        for i, x in held:
            found = []
            if c is not None:
                own = slice(*np.searchsorted(c["doc"], [i, i + 1]))
                mine = c["tag"][own] == tag_of(x) if own.stop > own.start else np.zeros(0, bool)
                found = merged(c["from"][own][mine], c["to"][own][mine])
            rows.append((i, x, found))
        yield cut_batch(rows, kept)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", SLICE):
                yield cut_batch([(None, utf8(x), []) for x in part.column("text").to_pylist()], kept)

    return with_blocks(known, spans, n, work, CUT).unionByName(every.where("id is null").mapInArrow(plain, CUT))
