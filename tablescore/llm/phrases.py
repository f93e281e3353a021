"""Phrase collocations: n-grams that survive merged count-min sketches, counted exactly, scored and subsumed.

The first pass counts all n-grams of one to three words of a language in a count-min sketch of two rows.
Each task adds its n-grams up, and sends what it adds to the cells (never the n-grams) by chunk of cells;
tasks that own a chunk merge these sketches. Counters stop at the threshold, so a merged sketch comes down
to one bit a cell: whether the cell has reached it. An n-gram's estimate, the lesser of its two cells, is
never below its count, so all that occur often enough pass. The second pass sends only n-grams that pass,
added up by task, packed by bucket and language, and adds them up exactly. Whatever a phrase is scored with (its parts) or subsumed by
occurs as often as the phrase or is a candidate itself, so it has passed too.

Cells follow the bytes of text (one for CELL_BYTES) up to MOST_CELLS for each row; the bits that are
broadcast are 64 MB then. On more text than that more rare n-grams pass, which costs shuffled rows in
proportion to the text and changes no result. Phrases of three words are joined with the counts of the
pairs in them by a shuffle whose large partitions Spark splits, all phrases with those of their words by a broadcast
up to BROADCAST_ROWS words; the ranks of a language come from its best rows of each of SALTS parts. Counts wait in a
table in the shared folder, which is deleted when the result is in its checkpoint.

A text is lower-cased (A-Z), cut at any of .,;:!? and line ends into pieces, and these at blanks and tabs
into words. A null text is empty, a null language is und. Rows that repeat a doc_id are documents of their
own. Texts are read whole, CHUNK bytes at a time; n-grams run across these. Equal scores go by count, then
phrase in byte order. An empty table gives an empty one. Columns other than text and lang are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, delete, partitions, shared_folder, slices

LEAST, LONGEST, TOP = 10, 3, 2_000
#: Percentage of a phrase's occurrences that a longer one needs to subsume it.
SUBSUMED = 50
#: Bytes of text for each cell of a row of the sketch, and bounds of the number of cells (powers of two).
CELL_BYTES, LEAST_CELLS, MOST_CELLS = 32, 1 << 16, 1 << 28
ROWS = 2
#: Cells of a chunk.
CHUNK_CELLS = 1 << 16
#: Bytes of text cut into words at a time, and n-grams that a task adds up before it sends them.
CHUNK, HELD = 2 << 20, 2_500_000
#: Bytes of phrases that a task puts together at a time, and phrases that wait until they are added to those before.
SENT_BYTES, FOLDED = 32 << 20, 1 << 19
#: Bits of a word's number in an n-gram's key; a task begins its numbers anew at so many words or bytes of them.
WORD_BITS = 21
MOST_WORDS, MOST_BYTES = 600_000, 32 << 20
SALTS = 8
#: Words whose counts are broadcast (some 100 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
TABLE = bytes.maketrans(UPPER + SEPARATORS + b"\t", UPPER.lower() + b"\n" * len(SEPARATORS) + b" ")
#: Stands between pieces; no byte of UTF-8.
BETWEEN = b"\xff"


class Numbers(dict):
    """Numbers of the words of one language, from the words of all languages of a task."""

    def __init__(self, lang: str, words: Words):
        super().__init__({BETWEEN: 0})
        self.lang, self.salt, self.words = lang, lang.encode("utf-8", "surrogatepass") + BETWEEN, words

    def __missing__(self, word: bytes) -> int:
        w = self.words
        n = self[word] = len(w.texts)
        w.texts.append(word)
        w.langs.append(self.lang)
        w.new.append(xxhash.xxh64_intdigest(self.salt + word))
        w.size += len(word)
        return n


class Words:
    """The words that a task knows by number; 0 is no word."""

    def __init__(self):
        self.by_lang: dict[str, Numbers] = {}
        self.texts, self.langs, self.new, self.size = [b""], [None], [0], 0
        self.hashes = np.empty(0, dtype=np.uint64)

    @property
    def full(self) -> bool:
        return len(self.texts) > MOST_WORDS or self.size > MOST_BYTES

    def numbers(self, lang: str, text: bytes, chunk: int = CHUNK) -> np.ndarray:
        """The words of a text by number, with 0 between pieces."""
        known = self.by_lang.setdefault(lang, Numbers(lang, self))
        out, at = [], 0
        while at < len(text):
            end = min(at + chunk, len(text))
            while end < len(text) and text[end] not in b" \t" + SEPARATORS:
                end += 1
            tokens = text[at:end].translate(TABLE).replace(b"\n", b" \xff ").split()
            out.append(np.fromiter(map(known.__getitem__, tokens), dtype=np.int64, count=len(tokens)))
            at = end
        return np.concatenate(out) if out else np.empty(0, dtype=np.int64)

    def hash(self, keys: np.ndarray) -> np.ndarray:
        """64 bits of each n-gram and its language, the same in every task."""
        if len(self.new):
            self.hashes = np.concatenate([self.hashes, np.array(self.new, dtype=np.uint64)])
            self.new = []
        mask = (1 << WORD_BITS) - 1
        h = np.zeros(len(keys), dtype=np.uint64)
        for k in range(LONGEST):
            h = h * np.uint64(0x9E3779B97F4A7C15) + self.hashes[keys >> (WORD_BITS * (LONGEST - 1 - k)) & mask]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def ngrams(words: np.ndarray, most: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of up to so many words, as keys of their words' numbers, and how often each occurs."""
    found, inside, key = [], words > 0, np.zeros(len(words), dtype=np.int64)
    for n in range(min(most, len(words))):
        size = len(words) - n
        inside = inside[:size] & (words[n:] > 0)
        key = key[:size] | words[n:] << (WORD_BITS * (LONGEST - 1 - n))
        found.append(key[inside])
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.diff(k, prepend=-1))
    return k[first], np.add.reduceat(c, first) if len(k) else c


class Sums:
    """N-grams of a task added up; flush() calls send with what is held."""

    def __init__(self, send):
        self.send, self.words, self.keys, self.counts, self.size = send, Words(), [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > HELD:
            k, c = merged(self.keys, self.counts)
            self.keys, self.counts, self.size = [k], [c], len(k)
        if self.size > HELD // 2 or self.words.full:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            yield from self.send(self.words, *merged(self.keys, self.counts))
        self.keys, self.counts, self.size = [], [], 0
        if self.words.full:
            self.words = Words()


def by_language(batches: Iterator[pa.RecordBatch], words) -> Iterator[tuple[str, np.ndarray]]:
    """(language, words by number) of slices of rows (text as bytes, lang)."""
    for whole in batches:
        for part in slices(whole, "text", 2 << 20):
            texts: dict[str, list[bytes]] = {}
            for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, some in texts.items():
                yield lang, words().numbers(lang, b"\n".join(some))


def cells(h: np.ndarray, n: int) -> list[np.ndarray]:
    """The cell of each n-gram in each row of n cells, numbered through all rows."""
    return [((h >> np.uint64(32 * r)) & np.uint64(n - 1)).astype(np.int64) + r * n for r in range(ROWS)]


def sketches(texts: DataFrame, n: int, least: int) -> DataFrame:
    """(chunk, cells): what each task adds to the cells of a chunk, as compressed steps between cells and amounts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)

        def send(words: Words, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            h, c = words.hash(keys), np.minimum(counts, least)
            for row in cells(h, n):
                at, amount = merged([row], [c])
                amount = np.minimum(amount, least).astype(np.uint8)
                chunk = at // CHUNK_CELLS
                first = np.flatnonzero(np.diff(chunk, prepend=-1))
                step = np.diff(at % CHUNK_CELLS, prepend=0).astype("<u2")
                step[first] = (at[first] % CHUNK_CELLS).astype("<u2")
                ends = [*first[1:].tolist(), len(at)]
                # The low and the high bytes of the steps apart: the latter are mostly zero.
                data = [pack.compress(step[a:z].view(np.uint8).reshape(-1, 2).T.tobytes() + amount[a:z].tobytes()) for a, z in zip(first.tolist(), ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(chunk[first].astype(np.int32)), pa.array(data, pa.binary())], names=["chunk", "cells"])

        sums = Sums(send)
        for _, words in by_language(batches, lambda: sums.words):
            yield from sums.add(*ngrams(words))
        yield from sums.flush()

    return texts.mapInArrow(run, "chunk int, cells binary")


def frequent_cells(texts: DataFrame, n: int, least: int) -> np.ndarray:
    """One bit for each cell of the merged sketch: whether it has reached least. ROWS * n / 8 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, counters = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                raw = np.frombuffer(unpack.decompress(data), dtype=np.uint8).reshape(3, -1)
                at = np.cumsum(raw[0].astype(np.int64) + (raw[1].astype(np.int64) << 8))
                have = counters.setdefault(chunk, np.zeros(CHUNK_CELLS, dtype=np.uint8))
                have[at] = np.minimum(have[at].astype(np.int64) + raw[2], least)
        out = [(chunk, np.packbits(have >= least, bitorder="little").tobytes()) for chunk, have in counters.items()]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["chunk", "bits"])

    if not 0 < least < 128:
        raise ValueError("counters are bytes")
    spark, bits = texts.sparkSession, np.zeros(ROWS * n // 8, dtype=np.uint8)
    step = CHUNK_CELLS // 8
    for r in sketches(texts, n, least).repartition(partitions(spark), "chunk").mapInArrow(run, "chunk int, bits binary").toLocalIterator():
        bits[r.chunk * step : (r.chunk + 1) * step] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return bits


def pack(codec: zstandard.ZstdCompressor, counts: np.ndarray, phrases: bytes | memoryview) -> bytes:
    """Counts and as many phrases, each of which a line end follows."""
    return codec.compress(b"".join((len(counts).to_bytes(8, "little"), counts.astype("<i8").tobytes(), phrases)))


def unpack(codec: zstandard.ZstdDecompressor, data: bytes) -> tuple[pa.Array, np.ndarray]:
    raw = codec.decompress(data)
    n = int.from_bytes(raw[:8], "little")
    text = np.frombuffer(raw, dtype=np.uint8, offset=8 + 8 * n)
    offsets = np.concatenate([[0], np.flatnonzero(text == ord("\n")) + 1]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(text.tobytes())]), np.frombuffer(raw, dtype="<i8", count=n, offset=8)


def survivors(texts: DataFrame, bits: np.ndarray, n: int, buckets: int) -> DataFrame:
    """(bucket, lang, packed): n-grams that pass the sketch, added up by task and dealt out by hash, and the number of all words as that of the empty phrase."""
    held = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, total = zstandard.ZstdCompressor(level=1), {}

        def batch(rows: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "lang", "packed"])

        def some(words: Words, keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
            mask = (1 << WORD_BITS) - 1
            used, spot = np.unique(np.concatenate([keys >> (WORD_BITS * (LONGEST - 1 - k)) & mask for k in range(LONGEST)]), return_inverse=True)
            spot = spot.reshape(LONGEST, -1)
            inner, last = (pa.array([words.texts[i] + end for i in used.tolist()], pa.large_binary()) for end in (b"", b"\n"))
            langs = list(words.by_lang)
            number = {lang: k for k, lang in enumerate(langs)}
            lang = np.array([number.get(words.langs[i], 0) for i in used.tolist()])[spot[0]]
            size = sum((used[s] > 0).astype(np.int32) for s in spot)
            at = [np.flatnonzero(size == k) for k in range(1, LONGEST + 1)]
            phrases = pa.concat_arrays([pc.binary_join_element_wise(*(inner.take(pa.array(spot[j][i])) for j in range(k - 1)), last.take(pa.array(spot[k - 1][i])), pa.scalar(b" ", pa.large_binary())) for k, i in enumerate(at, 1)])
            at = np.concatenate(at)
            order = np.lexsort((keys[at], lang[at], bucket[at]))
            phrases, at = phrases.take(pa.array(order)), at[order]
            edge = np.flatnonzero(np.diff(bucket[at], prepend=-1) | np.diff(lang[at], prepend=-1))
            offsets, text = np.frombuffer(phrases.buffers()[1], dtype=np.int64), memoryview(phrases.buffers()[2])
            yield batch([(int(bucket[at[i]]), langs[lang[at[i]]], pack(codec, counts[at[i:j]], text[offsets[i] : offsets[j]])) for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(at)], strict=True)])

        def send(words: Words, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            bucket = (words.hash(keys) >> np.uint64(40)).astype(np.int64) % buckets
            size = np.array([len(x) for x in words.texts])
            ends = np.cumsum(sum(size[keys >> (WORD_BITS * k) & ((1 << WORD_BITS) - 1)] for k in range(LONGEST)) + LONGEST) // SENT_BYTES
            for part in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(ends)) + 1):
                yield from some(words, keys[part], counts[part], bucket[part])

        sums = Sums(send)
        for lang, words in by_language(batches, lambda: sums.words):
            total[lang] = total.get(lang, 0) + int((words > 0).sum())
            keys, counts = ngrams(words)
            passes = np.ones(len(keys), dtype=bool)
            for at in cells(sums.words.hash(keys), n):
                passes &= held.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
            yield from sums.add(keys[passes], counts[passes])
        yield from sums.flush()
        if total:
            yield batch([(0, lang, pack(codec, np.array([k]), b"\n")) for lang, k in total.items()])

    return texts.mapInArrow(run, "bucket int, lang string, packed binary")


def added_up(packed: DataFrame, least: int, buckets: int) -> DataFrame:
    """(lang, words, phrase, f) of packed(): phrases with f >= least, and the number of all words as the empty phrase of 0 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, known, pending = zstandard.ZstdDecompressor(), {}, {}

        def fold(lang: str) -> None:
            t = pa.concat_tables([known[lang], *pending.pop(lang)]) if lang in known else pa.concat_tables(pending.pop(lang))
            known[lang] = t.group_by("phrase").aggregate([("f", "sum")]).rename_columns(["phrase", "f"])

        waiting: dict[str, int] = {}
        for b in batches:
            for lang, data in zip(b.column("lang").to_pylist(), b.column("packed"), strict=True):
                phrases, counts = unpack(codec, data.as_py())
                pending.setdefault(lang, []).append(pa.table({"phrase": phrases, "f": pa.array(counts)}))
                waiting[lang] = waiting.get(lang, 0) + len(counts)
                if waiting[lang] > max(FOLDED, known[lang].num_rows if lang in known else 0):
                    fold(lang)
                    waiting[lang] = 0
        for lang in list(pending):
            fold(lang)
        for lang, t in known.items():
            t = t.filter(pc.or_(pc.greater_equal(t["f"], least), pc.equal(t["phrase"], pa.scalar(b"\n", pa.large_binary()))))
            for x in t.to_batches(max_chunksize=100_000):
                phrase = pc.utf8_rtrim(x.column("phrase").cast(pa.large_string()), "\n").cast(pa.string())
                words = pc.if_else(pc.equal(phrase, ""), 0, pc.add(pc.count_substring(phrase, " "), 1))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrase), pa.string()), words.cast(pa.int32()), phrase, x.column("f")], names=["lang", "words", "phrase", "f"])

    return packed.repartitionById(buckets, "bucket").select("lang", "packed").mapInArrow(run, "lang string, words int, phrase string, f long")


def counted(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, words, phrase, f) of all phrases of one to three words with f >= least, and f of all words at 0 words."""
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(MOST_CELLS, max(LEAST_CELLS, 1 << (size // CELL_BYTES).bit_length()))
    buckets = partitions(docs.sparkSession)
    return added_up(survivors(texts, frequent_cells(texts, n, least), n, buckets), least, buckets)


def score_of(a: str, l: str, r: str):
    """floor(1000000 a a / (l r)) of whole numbers, exact up to 38 digits."""
    wide = "decimal(38,0)"
    return F.expr(f"(cast(1000000 as {wide}) * cast({a} as {wide}) * cast({a} as {wide})) div (cast({l} as {wide}) * cast({r} as {wide}))")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, words, phrase, a, l, r, score) of the phrases of two or three words in counts that none subsumes."""
    known = counts.where("words = 1").select("lang", F.col("phrase").alias("word"), F.col("f").alias("of_word"))
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    with_word = lambda d, word, name: d.join(known.select("lang", F.col("word").alias(word), F.col("of_word").alias(name)), ["lang", word])
    ends = (F.substring_index("phrase", " ", 1).alias("first"), F.substring_index("phrase", " ", -1).alias("last"))
    of_words = lambda d: with_word(with_word(d.select("*", *ends), "first", "of_first"), "last", "of_last")
    two, three = (counts.where(F.col("words") == k).select("lang", "words", "phrase", F.col("f").alias("a")) for k in (2, 3))
    # Of each phrase of three words both pairs in it: they are counted, and it may subsume them.
    pairs = three.select("lang", "phrase", "a", F.posexplode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("tail", "part"))
    found = pairs.join(two.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")), ["lang", "part"])
    whole = found.groupBy("lang", "phrase", "a").agg(*(F.max(F.when(F.col("tail") == k, F.col("f"))).alias(n) for k, n in ((0, "head"), (1, "tail"))))
    whole = of_words(whole).withColumn("s1", score_of("a", "of_first", "tail")).withColumn("s2", score_of("a", "head", "of_last"))
    pick = lambda x, y: F.when(F.col("s2") < F.col("s1"), F.col(y)).otherwise(F.col(x))
    whole = whole.select("lang", F.lit(3).alias("words"), "phrase", "a", pick("of_first", "head").alias("l"), pick("tail", "of_last").alias("r"), pick("s1", "s2").alias("score"))
    longer = pairs.groupBy("lang", F.col("part").alias("phrase")).agg(F.max("a").alias("longer"))
    free = two.join(longer, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {SUBSUMED} * a").drop("longer")
    short = of_words(free).select("lang", "words", "phrase", "a", F.col("of_first").alias("l"), F.col("of_last").alias("r"), score_of("a", "of_first", "of_last").alias("score"))
    return whole.unionByName(short)


def ranked(scores: DataFrame, top: int = TOP) -> DataFrame:
    """scores with the rank of each row in its language, of the first ones."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = scores.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of each language of docs (text, lang)."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/phrases-{uuid.uuid4().hex}"
    counted(docs, least).write.parquet(folder)
    counts = spark.read.parquet(folder)
    n = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    best = cut(ranked(scored(counts), top).join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    delete(spark, folder)
    return best
