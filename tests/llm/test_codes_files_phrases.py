import random
import struct
import zlib
from collections import Counter, defaultdict
from math import floor, inf, isfinite, nan

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, same
from pyspark.sql import functions as F

from tablescore.llm import codes, oracles, phrases, queries, token_files


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_phrases"])
def test_query_equals_its_sql(spark, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name], SMALL)


def brute_codes(rows, rounds=2):
    """(vec_id, code, error, label_error, books) in Python's own whole numbers."""
    kept = [(i, e, label) for i, e, label in rows if e is not None and all(x is not None and isfinite(x) for x in e)]
    if not kept:
        return []
    dim = -(-max(len(e) for _, e, _ in kept) // 16) * 16
    low = lambda x: max(-codes.LIMIT, min(codes.LIMIT, floor(256 * x)))
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))
    x = [[*map(low, e), *[0] * (dim - len(e))] for _, e, _ in kept]
    w = dim // 16
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(x[k], p) for k in order[:64]] for p in range(16)]
    apart = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))

    def assign():
        return [[min((apart(part(v, p), c), j) for j, c in enumerate(books[p])) for p in range(16)] for v in x]

    for _ in range(rounds):
        found = assign()
        for p in range(16):
            for j in range(len(books[p])):
                own = [part(v, p) for v, f in zip(x, found, strict=True) if f[p][1] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = assign()
    error = [sum(d for d, _ in f) for f in found]
    total = Counter()
    for (_, _, label), e in zip(kept, error, strict=True):
        total[label] += e
    sha = codes.digest(np.array(books, dtype=np.int64).reshape(16, -1))
    return [(i, "".join(f"{j:02x}" for _, j in f), e, total[label], sha) for (i, _, label), f, e in zip(kept, found, error, strict=True)]


def vectors(r, n, dims=(16,), far=1.0):
    value = lambda: r.choice([0.0, -0.0, 0.1, -0.1, r.gauss(0, far), r.gauss(0, far), 1e-30])
    return [(r.choice([None, *range(n)]) if r.random() < 0.1 else k // 2, [value() for _ in range(r.choice(dims))], r.choice([None, 1, 1, 2])) for k in range(n)]


CASES = {
    "few": lambda r: vectors(r, 40), "many": lambda r: vectors(r, 150, (32,)), "lengths": lambda r: vectors(r, 90, (0, 5, 16, 20)), "far": lambda r: vectors(r, 100, (32,), 1e4),
    "odd": lambda r: [*vectors(r, 70), (1, None, 1), (2, [nan] * 16, 1), (3, [inf] * 16, None), (4, [None] * 16, 1), (5, [1e300] * 16, 1), (6, [-1e9] * 16, 1), (None, [0.5] * 16, None)],
    "equal": lambda r: [(k, [0.25] * 16, 1) for k in range(100)], "empty vectors": lambda r: [(k, [], 1) for k in range(3)], "none": lambda r: [(1, None, 1)], "nothing": lambda r: [],
}


@pytest.mark.parametrize("name", CASES)
def test_codes_equal_brute_force(spark, name):
    rows = CASES[name](random.Random(name))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'?' as code", "1 as key").repartition(3)
    got = codes.compress(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    key = lambda t: tuple(map(str, t))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_codes(rows), key=key)


def test_many_labels_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(codes, "BROADCAST_ROWS", 1)
    rows = vectors(random.Random(3), 80)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    key = lambda t: tuple(map(str, t))
    assert sorted(map(tuple, codes.compress(df).collect()), key=key) == sorted(brute_codes(rows), key=key)


def test_screening_loses_no_tie():
    """Entries that differ by one in a large distance, and equal ones, against whole numbers."""
    r = np.random.default_rng(1)
    for p, far in ((1, 1 << 24), (4, 1 << 24), (8, 300), (64, 1 << 20)):
        book = r.integers(-far, far + 1, (64, p))
        book[32:] = np.clip(book[:32] + r.integers(-1, 2, (32, p)), -far, far)
        x = np.clip(book[r.integers(0, 64, 300)] + r.integers(-2, 3, (300, p)), -far, far)
        index, apart = codes.nearest(x, book)
        want = ((x[:, None].astype(object) - book[None].astype(object)) ** 2).sum(axis=2)
        assert index.tolist() == [min(range(64), key=lambda j: (row[j], j)) for row in want] and apart.tolist() == want.min(axis=1).tolist()


TEXTS = [None, "", "a", "The cat, the dog.\nIt's 1 2 three!", " x y\tz", "Ḵ. H̱ é ́e", "<|endoftext|> <|ENDOFTEXT|> A. b", "中文 \U0001f600 İ ΣΣ", "lorem ipsum " * 30_000, "x" * 100_000, "a.b. c, d., e.. F."]


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files.vocabulary())


def ids_of(data):
    return np.frombuffer(data, dtype="<u4").tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB'sTRhé̱́̈ \t\n1.,<|>eΣ "), max_size=40) | st.none(), max_size=8))
def test_words_give_the_ids_of_whole_texts(texts):
    whole = WHOLE.setdefault("t", tokenizer())
    for e in WHOLE.setdefault("e", [token_files.Encoder(whole.to_str(), 10), token_files.Encoder(whole.to_str())]):
        found = e.encode(pa.array(["first", *texts], pa.string()).slice(1)).to_pylist()
        assert [ids_of(x) for x in found] == [[*whole.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


WHOLE: dict = {}


def test_a_vocabulary_of_other_rules():
    """Without the default's rules no shortcut is taken."""
    import json

    spec = json.loads(tokenizer().to_str())
    spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:2]
    from tokenizers import Tokenizer

    other = Tokenizer.from_str(json.dumps(spec))
    e = token_files.Encoder(json.dumps(spec))
    assert not e.plain
    assert [ids_of(x) for x in e.encode(pa.array(TEXTS[:8])).to_pylist()] == [[*other.encode(t or "", add_special_tokens=False).ids, 1] for t in TEXTS[:8]]


def test_files_give_back_what_was_written(spark, tmp_path, monkeypatch):
    whole = tokenizer()
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(3, "again"), (3, "again"), (None, "no id"), (-5, "before")]
    df = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "1 as ids", "2 as start", "'x' as hash").repartition(5)
    folder = str(tmp_path / "files")
    token_files.write(df, folder)
    found = token_files.read(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in found] == [-5, 0, 1, 2, 3, 3, 3, *range(4, len(TEXTS)), None]
    want = Counter((i, (*whole.encode(t or "", add_special_tokens=False).ids, 1)) for i, t in rows)
    assert Counter((r.doc_id, tuple(ids_of(bytes(r.ids)))) for r in found) == want
    assert [r.start for r in found] == np.cumsum([0, *(len(r.ids) // 4 for r in found[:-1])]).tolist()
    # Any decoder reads a file: frames one after the other, then a skippable one.
    for p in (tmp_path / "files").glob("*.ids.zst"):
        data, out = p.read_bytes(), b""
        for x in frames(data):
            out += zstandard.ZstdDecompressor().decompress(x)
        own = token_files.FileReader(pa.OSFile(str(p)))
        assert out.startswith(b"".join(b"".join(ids) for _, ids in own.read(np.arange(len(own.doc_ids)))))


def frames(data):
    """The frames of a file by its seek table."""
    n, kind, magic = struct.unpack("<IBI", data[-9:])
    assert (kind, magic) == (0x80, 0x8F92EAB1)
    at = 0
    for k in range(n):
        packed, size, _ = struct.unpack_from("<III", data, len(data) - 9 - 12 * n + 12 * k)
        assert zstandard.frame_content_size(data[at : at + packed]) == size
        yield data[at : at + packed]
        at += packed
    assert struct.unpack_from("<II", data, at) == (0x184D2A5E, 12 * n + 9) and at + 8 + 12 * n + 9 == len(data)


def test_only_requested_documents_are_decompressed(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "files")
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of "), F.col("id").cast("string")).alias("text"))
    token_files.write(df, folder)
    every = {r.doc_id: (r.start, bytes(r.ids)) for r in token_files.read(spark, folder).collect()}
    assert len(every) == 500
    some = token_files.read(spark, folder, doc_ids=[7, 8, 300, 9999])
    assert some.rdd.getNumPartitions() <= 2 and {r.doc_id: (r.start, bytes(r.ids)) for r in some.collect()} == {k: every[k] for k in (7, 8, 300)}
    assert {r.doc_id for r in token_files.read(spark, folder, low=490).collect()} == set(range(490, 500))
    assert {r.doc_id for r in token_files.read(spark, folder, low=3, high=5, doc_ids=range(100)).collect()} == {3, 4, 5}
    assert token_files.read(spark, folder, doc_ids=[]).count() == token_files.read(spark, folder, low=600).count() == 0
    reader = token_files.TokenReader(folder, {7, 300}, None, None)
    opened = []
    monkeypatch.setattr(token_files.FileReader, "frame", lambda self, k, packed, real=token_files.FileReader.frame: (opened.append(k), real(self, k, packed))[1])
    rows = [i for p in reader.partitions() for b in reader.read(p) for i in b.column("doc_id").to_pylist()]
    # A directory and a document of each of two files.
    assert rows == [7, 300] and len(opened) == 4


def test_damage_is_found(spark, tmp_path):
    folder = str(tmp_path / "files")
    token_files.write(spark.createDataFrame([(1, "some words of text")], "doc_id long, text string").coalesce(1), folder)
    path = next(p for p in (tmp_path / "files").glob("*.ids.zst") if token_files.FileReader(pa.OSFile(str(p))).doc_ids.size)
    data = bytearray(path.read_bytes())
    n = struct.unpack("<I", data[-9:-5])[0]
    data[-9 - 12 * n + 8] ^= 1
    path.write_bytes(bytes(data))
    with pytest.raises(Exception, match="checksum"):
        token_files.read(spark, folder).collect()


def test_files_are_replaced_only_by_a_whole_job(spark, tmp_path):
    folder = str(tmp_path / "files")
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(20)], "doc_id long, text string")
    token_files.write(docs, folder)
    before = sorted(p.name for p in (tmp_path / "files").iterdir())
    with pytest.raises(Exception, match="lost"):
        token_files.write(docs.withColumn("text", F.when(F.col("doc_id") == 13, F.raise_error(F.lit("lost")).cast("string")).otherwise("new")), folder)
    assert token_files.read(spark, folder).count() == 20
    token_files.write(docs.where("doc_id < 5"), folder)
    assert token_files.read(spark, folder).count() == 5 and len(before) >= len(list((tmp_path / "files").iterdir()))
    token_files.write(docs.limit(0), folder)
    assert token_files.read(spark, folder).count() == 0
    with pytest.raises(Exception, match="overwrite"):
        docs.selectExpr("doc_id", "binary('') as ids").write.format("token_files").mode("append").save(folder)


def test_large_files_are_cut(spark, tmp_path, monkeypatch):
    import io

    class Kept(io.BytesIO):
        def close(self):
            pass

    out = Kept()
    w = token_files.FileWriter(out)
    for k in range(1000):
        w.add(k if k % 3 else None, struct.pack("<I", k) * (k % 7 + 1))
    assert w.close() == {"docs": 1000, "ids": sum(k % 7 + 1 for k in range(1000)), "low": 1, "high": 998}
    r = token_files.FileReader(pa.BufferReader(out.getvalue()))
    monkeypatch.setattr(token_files, "FETCH", 300)
    got = [(k, x) for some, ids in r.read(np.arange(0, 1000, 2)) for k, x in zip(some, ids, strict=True)]
    assert got == [(k, struct.pack("<I", k) * (k % 7 + 1)) for k in range(0, 1000, 2)]
    assert r.starts[10] == sum(k % 7 + 1 for k in range(10)) and r.known.tolist() == [k % 3 > 0 for k in range(1000)]


def test_token_file_query(spark):
    whole = tokenizer()
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    rows = {r.doc_id: tuple(r)[1:] for r in queries.op12_token_files(spark, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").collect()}
    start = 0
    for i, t in docs:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        assert rows[i] == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def brute_phrases(rows, least, top):
    import re

    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(len(q) == 3 and b >= least and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in c.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, x, y, n[lang], -s) for k, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def sentences(r, n):
    word = lambda: r.choice(["a", "A", "b", "c", "é", "new", "york", "\xa0", "x" * r.choice([1, 1, 300])])
    gap = lambda: r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!?"])
    return [("".join(word() + gap() for _ in range(r.randint(0, 30))), r.choice(["en", "de", "und", None])) for _ in range(n)] + [(None, "en"), ("", None), (" . ", "zz")]


@pytest.mark.parametrize("least", [1, 3, 10])
def test_phrases_equal_brute_force(spark, monkeypatch, least):
    rows = sentences(random.Random(least), 150)
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 as f", "2 as phrase", "3 as words").repartition(3)
    for held, chunk, words in ((phrases.HELD, phrases.CHUNK, phrases.MOST_WORDS), (40, 50, 20)):
        monkeypatch.setattr(phrases, "HELD", held)
        monkeypatch.setattr(phrases, "MOST_WORDS", words)
        monkeypatch.setattr(phrases, "SENT_BYTES", 1 << 20 if held > 40 else 200)
        monkeypatch.setattr(phrases.Words.numbers, "__defaults__", (chunk,))
        for top in (5, 2000):
            got = phrases.mine(df, least, top)
            assert sorted(map(tuple, got.collect())) == brute_phrases(rows, least, top)
    assert phrases.mine(df.limit(0), least).count() == 0


def test_a_sketch_of_few_cells_loses_nothing(spark, monkeypatch):
    """All cells shared by many: more n-grams pass, the counts stay."""
    rows = sentences(random.Random(5), 200)
    df = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(phrases, "LEAST_CELLS", 16)
    monkeypatch.setattr(phrases, "MOST_CELLS", 16)
    monkeypatch.setattr(phrases, "CHUNK_CELLS", 8)
    assert sorted(map(tuple, phrases.mine(df, 4, 50).collect())) == brute_phrases(rows, 4, 50)


def test_sketch_bits(spark, monkeypatch):
    """A cell's bit tells whether the n-grams of all tasks have reached the threshold there."""
    rows = sentences(random.Random(6), 60)
    texts = spark.createDataFrame([((t or "").encode(), lang or "und") for t, lang in rows], "text binary, lang string").repartition(4)
    n, least = 1 << 16, 3
    bits = phrases.frequent_cells(texts, n, least)
    words, sums = phrases.Words(), np.zeros(phrases.ROWS * n, dtype=np.int64)
    for t, lang in rows:
        keys, counts = phrases.ngrams(words.numbers(lang or "und", (t or "").encode()))
        for at in phrases.cells(words.hash(keys), n):
            np.add.at(sums, at, counts)
    assert (np.unpackbits(bits, bitorder="little") == (sums >= least)).all() and 0 < (sums >= least).sum() < len(sums)


def test_scores_beyond_64_bits(spark):
    cases = [(10, 10, 10), (10**13, 10**13, 10**13), (10**13 - 1, 10**13, 10**13 - 1), (3 * 10**12 + 1, 10**13 - 7, 4 * 10**12 + 3), (10**9 + 7, 10**12, 10**9 + 7)]
    df = spark.createDataFrame(cases, "a long, l long, r long")
    assert [(x.a, x.l, x.r, x.s) for x in df.select("*", phrases.score_of("a", "l", "r").alias("s")).collect()] == [(a, l, r, 10**6 * a * a // (l * r)) for a, l, r in cases]


def test_a_long_text_without_a_break():
    words = phrases.Words()
    text = b"ab " * 50_000 + b"x" * 70_000
    got = words.numbers("en", text, 1000)
    assert len(got) == 50_001 and len(set(got.tolist())) == 2 and words.texts[got[-1]] == b"x" * 70_000


def test_registered():
    assert {"op11_vector_codes", "op12_token_files", "op13_phrases"} <= set(queries.queries()) and oracles.CODES and connect(SMALL)
