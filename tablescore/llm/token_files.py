"""Token ids in files of independent zstandard frames with a seek table, as a data source.

A file holds one frame for each document (its ids as little-endian unsigned 32-bit integers), a directory
frame (a byte for each document that tells whether it has an id, then the ids) and a seek table: a
skippable frame with compressed size, size and the low 32 bits of the XXH64 of each frame's contents, so
any zstandard decoder reads the file, and a reader that wants some documents fetches the table, the
directory and those documents' frames only. Sizes and so the place of each document in the whole sequence
come from the table without decompression. Every frame that is read is checked against its sum.

write() deals whole texts out by ranges of doc_id, encodes them once and writes through a data source
writer: an attempt writes files of names of its own, the driver's commit lists those of the attempts that
counted in index.json and deletes all others, so lost executors leave neither gaps nor repeats, and a
failed job leaves the former files as they were. The list has five numbers for each file of up to
FILE_BYTES. Files are reached through pyarrow, in whatever store it knows (file, hdfs, s3, gs).

A text is encoded word by word, as the vocabulary drops white space: each distinct stretch between spaces
is encoded once by the library and its ids are kept (WORDS of them), which gives the ids of the whole text.

Documents stand in ascending order of doc_id, a null one last; of rows that repeat a doc_id each is a
document, in the order of their texts' hashes. They are dealt out by id, hash and place in the input, so an
id with a third of all rows is no single task's work. Null and empty texts have the end id only. An empty
table gives files without documents. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pfs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, slices

END = 1
LEVEL = 3
#: A file ends at so many compressed bytes or documents; a reader fetches so many bytes at a time.
FILE_BYTES, FILE_DOCS, FETCH = 256 << 20, 1 << 20, 4 << 20
#: Bytes of text that are encoded at a time.
SLICE = 8 << 20
#: Distinct words whose ids a worker keeps from one slice to the next.
WORDS = 700_000
#: Fixed values of the seekable format: magic numbers of the skippable frame and of the footer, the descriptor of a table with sums.
SKIPPABLE, SEEKABLE, WITH_SUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
INDEX = "index.json"


def vocabulary() -> str:
    """The path of the default tokenizers file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of runs of these starts and sizes, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Known(dict):
    """Numbers of strings, and the ids of each by number. A string that is looked up and not there gets the next number; its ids are to be added."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.ids, self.starts, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        n = self[key] = len(self)
        return n

    def numbers(self, some: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, some), dtype=np.int64, count=len(some))

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """The ids of the new strings, in their order."""
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        self.new = []

    def of(self, at: np.ndarray) -> np.ndarray:
        return self.ids[ragged(self.starts[at], self.sizes[at])]

    def only(self, some: list[str]) -> Known:
        """What is known of these distinct strings."""
        out, have = Known(), [w for w in some if w in self]
        at = self.numbers(have)
        out.update(zip(have, range(len(have)), strict=True))
        out.add(self.of(at), self.sizes[at])
        return out


def joined(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    return np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=int(sizes.sum())), sizes


#: The normalizer and the pre-tokenizer of the default vocabulary.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class Encoder:
    """Ids of whole texts by a tokenizers file whose normalizer and pre-tokenizer see no further than white space and drop it.

    Of the distinct words of a slice those that are new are normalized and cut into pieces by the library all
    at once, and the model encodes each new piece; words with other white space or the text of an added token
    are encoded one by one. Beyond the most words that are kept only those of the present slice stay.

    Where the file has the default's rules, case does not tell ASCII words apart, a word of ASCII letters is one piece,
    and a full stop or comma between a letter and a blank is a piece of its own; then there are fewer distinct words.
    Texts that may hold an added token are left as they are.
    """

    def __init__(self, spec: str, words: int = WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_str(spec), words
        self.model, self.added = self.tokenizer.model, [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        rules = json.loads(spec)
        cut = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.plain = (rules.get("normalizer") or {}).get("normalizers") == NORMALIZERS and cut[0].get("pattern") == {"Regex": PIECES} and [c.get("type") for c in cut] == ["Split", "ByteLevel"]
        self.words, self.pieces = Known(), Known()

    def learn(self) -> None:
        """The ids of the new words."""
        new = self.words.new
        kind = np.array([0 if self.plain and w.isascii() and w.isalpha() and w.islower() else 1 if w.split() == [w] and not any(a in w for a in self.added) else 2 for w in new])
        of = [[w for w, k in zip(new, kind.tolist(), strict=True) if k == j] for j in range(3)]
        found = [joined([[t.id for t in self.model.tokenize(w)] for w in of[0]]), self.even(of[1]), joined([self.tokenizer.encode(w, add_special_tokens=False).ids for w in of[2]])]
        sizes = np.empty(len(new), dtype=np.int64)
        for k, (_, n) in enumerate(found):
            sizes[kind == k] = n
        # The ids of all kinds in the order of the words.
        ids, mine = np.empty(sizes.sum(), dtype=np.uint32), np.repeat(kind, sizes)
        for k, (some, _) in enumerate(found):
            ids[mine == k] = some
        self.words.add(ids, sizes)

    def even(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, and how many each has."""
        if not words:
            return joined([])
        text = self.tokenizer.normalizer.normalize_str(" ".join(words))
        begin = np.cumsum([0, *(len(w) + 1 for w in text.split(" ")[:-1])])
        if len(begin) != len(words):
            raise ValueError("the normalizer does not keep words apart")
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        if len(self.pieces) > self.most // 2:
            self.pieces = Known()
        at = self.pieces.numbers([x for x, _ in found])
        if self.pieces.new:
            self.pieces.add(*joined([[t.id for t in self.model.tokenize(x)] for x in self.pieces.new]))
        word = np.searchsorted(begin, np.fromiter((a for _, (a, _) in found), dtype=np.int64, count=len(found)), side="right") - 1
        return self.pieces.of(at), np.bincount(word, weights=self.pieces.sizes[at], minlength=len(words)).astype(np.int64)

    def cut(self, texts: pa.Array) -> pa.ListArray:
        """Words of each text."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        if not self.plain or any(pc.any(pc.match_substring(texts, a[:2])).as_py() for a in self.added):
            return pc.split_pattern(texts, " ")
        lists = pc.split_pattern(pc.replace_substring_regex(texts, r"([A-Za-z])([.,]) ", r"\1 \2 "), " ")
        words = lists.flatten()
        words = pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(words), words)
        return pa.ListArray.from_arrays(pa.array(np.asarray(lists.offsets) - lists.offsets[0].as_py()), words)

    def encode(self, texts: pa.Array, end: int = END) -> pa.Array:
        """The ids of each text and the end id, as bytes."""
        lists = self.cut(texts)
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.words) > self.most:
            self.words = self.words.only(distinct)
        at = self.words.numbers(distinct)
        if self.words.new:
            self.learn()
        at = at[np.asarray(coded.indices)]
        edges = np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()
        ends = np.concatenate([[0], np.cumsum(self.words.sizes[at])])[edges] + np.arange(len(edges))
        out = np.empty(ends[-1], dtype="<u4")
        last = np.zeros(len(out), dtype=bool)
        last[ends[1:] - 1] = True
        out[last], out[~last] = end, self.words.of(at)
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer((4 * ends).astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())])


class FileWriter:
    """One file: add() documents, then close()."""

    def __init__(self, out, level: int = LEVEL):
        self.out, self.pack = out, zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.table, self.known, self.doc_ids = array("I"), bytearray(), array("q")
        self.bytes = self.n_ids = 0

    def frame(self, data: bytes | memoryview) -> None:
        packed = self.pack.compress(data)
        self.out.write(packed)
        self.bytes += len(packed)
        self.table.extend((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: bytes | memoryview) -> None:
        self.frame(ids)
        self.known.append(doc_id is not None)
        self.doc_ids.append(doc_id or 0)
        self.n_ids += len(ids) // 4

    def close(self) -> dict:
        """What the list of files has of this one."""
        ids = np.array(self.doc_ids, dtype="<i8")
        self.frame(bytes(self.known) + ids.tobytes())
        n = len(self.table) // 3
        table = np.array(self.table, dtype="<u4").tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", n, WITH_SUMS, SEEKABLE))
        self.out.close()
        named = ids[np.frombuffer(bytes(self.known), dtype=bool)]
        return {"docs": n - 1, "ids": self.n_ids, "low": int(named.min()) if len(named) else None, "high": int(named.max()) if len(named) else None}


class FileReader:
    """Documents of one file, an open random-access input."""

    def __init__(self, file):
        self.file, self.unpack = file, zstandard.ZstdDecompressor()
        size = file.size()
        n, kind, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
        if magic != SEEKABLE or kind != WITH_SUMS:
            raise ValueError("no seek table with sums at the end of the file")
        start = size - 9 - 12 * n
        if struct.unpack("<II", file.read_at(8, start - 8)) != (SKIPPABLE, 12 * n + 9):
            raise ValueError("the seek table is no skippable frame")
        self.packed, self.sizes, self.sums = np.frombuffer(file.read_at(12 * n, start), dtype="<u4").reshape(n, 3).T
        self.ends = np.cumsum(self.packed.astype(np.int64))
        if self.ends[-1] != start - 8:
            raise ValueError("the frames do not fill the file")
        directory = self.frame(n - 1, file.read_at(int(self.packed[-1]), int(self.ends[-1] - self.packed[-1])))
        self.known, self.doc_ids = np.frombuffer(directory, dtype=bool, count=n - 1), np.frombuffer(directory, dtype="<i8", offset=n - 1)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes[:-1].astype(np.int64) // 4)])[: n - 1]

    def frame(self, k: int, packed: bytes) -> bytes:
        data = self.unpack.decompress(packed, max_output_size=int(self.sizes[k]))
        if len(data) != self.sizes[k] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} differs from its checksum")
        return data

    def read(self, wanted: np.ndarray) -> Iterator[tuple[list[int], list[bytes]]]:
        """(numbers, ids) of the wanted documents (ascending), some at a time; neighbours are fetched together."""
        begin = self.ends - self.packed
        at = 0
        while at < len(wanted):
            to = at + 1
            while to < len(wanted) and wanted[to] == wanted[to - 1] + 1 and self.ends[wanted[to]] - begin[wanted[at]] <= FETCH:
                to += 1
            some = wanted[at:to].tolist()
            base = int(begin[some[0]])
            data = memoryview(self.file.read_at(int(self.ends[some[-1]]) - base, base))
            yield some, [self.frame(k, data[int(begin[k]) - base : int(self.ends[k]) - base]) for k in some]
            at = to


class Written(D.WriterCommitMessage):
    def __init__(self, files: list[dict]):
        self.files = files


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """That of the vocabulary file at path, which a Python worker keeps from one task to the next."""
    fs, place = pfs.FileSystem.from_uri(path)
    with fs.open_input_stream(place) as f:
        return Encoder(f.read().decode())


class TokenWriter(D.DataSourceArrowWriter):
    """One task's rows (doc_id, and ids or a text that is encoded) into files of its own."""

    def __init__(self, path: str, vocabulary: str | None, end: int):
        self.path, self.vocabulary, self.end = path, vocabulary, end

    def documents(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, memoryview]]:
        for whole in batches:
            for part in slices(whole, "text" if self.vocabulary else "ids", SLICE):
                ids = encoder(self.vocabulary).encode(part.column("text"), self.end) if self.vocabulary else part.column("ids").cast(pa.large_binary())
                edges, data = np.frombuffer(ids.buffers()[1], dtype=np.int64)[ids.offset : ids.offset + len(ids) + 1].tolist(), memoryview(ids.buffers()[2] or b"")
                for doc_id, a, z in zip(part.column("doc_id").to_pylist(), edges, edges[1:], strict=False):
                    yield doc_id, data[a:z]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = pfs.FileSystem.from_uri(self.path)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        files, file = [], None

        def close() -> None:
            nonlocal file
            if file is not None:
                files.append({"name": name, "part": part, **file.close()})
                file = None

        for doc_id, ids in self.documents(iterator):
            if file is None:
                name = f"{part:06d}-{len(files):04d}-{attempt}.ids.zst"
                file = FileWriter(fs.open_output_stream(f"{folder}/{name}", compression=None, buffer_size=1 << 20))
            file.add(doc_id, ids)
            if file.bytes >= FILE_BYTES or len(file.known) >= FILE_DOCS:
                close()
        close()
        pa.default_memory_pool().release_unused()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """List the files of the attempts that counted, then delete all others."""
        fs, folder = pfs.FileSystem.from_uri(self.path)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f["name"])
        with fs.open_output_stream(f"{folder}/{INDEX}.new", compression=None) as out:
            out.write(json.dumps(files).encode())
        fs.move(f"{folder}/{INDEX}.new", f"{folder}/{INDEX}")
        names = {f["name"] for f in files} | {INDEX}
        for info in fs.get_file_info(pfs.FileSelector(folder)):
            if info.base_name not in names and info.base_name.endswith(".ids.zst"):
                fs.delete_file(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = pfs.FileSystem.from_uri(self.path)
        for f in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{folder}/{f['name']}")


class Part(D.InputPartition):
    def __init__(self, name: str, start: int):
        self.name, self.start = name, start


class TokenReader(D.DataSourceReader):
    """One partition for each file that may hold a document asked for: one of ids, if given, from low to high."""

    def __init__(self, path: str, ids: set[int] | None, low: int | None, high: int | None):
        self.path, self.ids, self.filtered = path, ids, (ids, low, high) != (None, None, None)
        self.low, self.high = -(1 << 63) if low is None else low, (1 << 63) - 1 if high is None else high

    def partitions(self) -> Sequence[Part]:
        fs, folder = pfs.FileSystem.from_uri(self.path)
        with fs.open_input_stream(f"{folder}/{INDEX}") as f:
            files = json.loads(f.read())
        out, start = [], 0
        for f in files:
            low, high = max(self.low, f["low"] if f["low"] is not None else self.low), min(self.high, f["high"] if f["high"] is not None else self.high)
            if not self.filtered or (f["low"] is not None and low <= high and (self.ids is None or any(low <= i <= high for i in self.ids))):
                out.append(Part(f["name"], start))
            start += f["ids"]
        return out or [Part("", 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, folder = pfs.FileSystem.from_uri(self.path)
        with fs.open_input_file(f"{folder}/{partition.name}") as f:
            file = FileReader(f)
            keep = np.ones(len(file.doc_ids), dtype=bool)
            if self.filtered:
                keep = file.known & (file.doc_ids >= self.low) & (file.doc_ids <= self.high)
                if self.ids is not None:
                    keep &= np.isin(file.doc_ids, np.array(sorted(self.ids), dtype=np.int64))
            for some, ids in file.read(np.flatnonzero(keep)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.doc_ids[some], mask=~file.known[some]), pa.array(file.starts[some] + partition.start), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"]
                )


class TokenFiles(D.DataSource):
    """format("token_files"): writes (doc_id, ids), or (doc_id, text) with the option vocabulary, the path of a tokenizers file
    that all executors reach, and the option end; reads (doc_id, start, ids). The options doc_ids (separated by commas), low and
    high choose the documents, and only their frames are read. They are options, as Spark keeps the filters that such
    a source has taken for later scans of the same DataFrame without them."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return "doc_id bigint, start bigint, ids binary"

    def reader(self, schema: T.StructType) -> TokenReader:
        o = self.options
        number = lambda name: int(o[name]) if name in o else None
        return TokenReader(o["path"], {int(x) for x in o["doc_ids"].split(",") if x} if "doc_ids" in o else None, number("low"), number("high"))

    def writer(self, schema: T.StructType, overwrite: bool) -> TokenWriter:
        if not overwrite:
            raise ValueError("the files of a folder are one sequence and replaced as a whole: mode overwrite")
        fs, folder = pfs.FileSystem.from_uri(self.options["path"])
        fs.create_dir(folder)
        return TokenWriter(self.options["path"], self.options.get("vocabulary") if "text" in schema.names else None, int(self.options.get("end", END)))


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = END) -> None:
    """The ids of all docs (doc_id, text), by the tokenizers file at path, into files in folder, in ascending order of
    doc_id. The folder gets a copy of the vocabulary, which the executors read."""
    spark = docs.sparkSession
    spark.dataSource.register(TokenFiles)
    fs, place = pfs.FileSystem.from_uri(folder)
    fs.create_dir(place)
    with open(path or vocabulary(), "rb") as f:
        spec = f.read()
    name = f"vocabulary-{xxhash.xxh64_hexdigest(spec)}.json"
    with fs.open_output_stream(f"{place}/{name}", compression=None) as out:
        out.write(spec)
    order = [F.asc_nulls_last("doc_id"), F.asc("hash"), F.asc("place")]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.write.format("token_files").option("vocabulary", f"{folder}/{name}").option("end", end).mode("overwrite").save(folder)


def read(spark: SparkSession, folder: str, doc_ids: Iterable[int] | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """(doc_id, start, ids) of the documents in the files of folder: all, or those of these ids, from low to high."""
    spark.dataSource.register(TokenFiles)
    chosen = {"doc_ids": None if doc_ids is None else ",".join(map(str, doc_ids)), "low": low, "high": high}
    return spark.read.format("token_files").options(**{k: v for k, v in chosen.items() if v is not None}).load(folder)
