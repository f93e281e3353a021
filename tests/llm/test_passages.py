import hashlib
import random
import re

import numpy as np
import pytest
from conftest import SMALL
from oracle import same

from tablescore.llm import decontaminate as D
from tablescore.llm import oracles, queries, suffixes


def words(x):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x or ""))


def brute_hits(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, x in items:
            v = words(x)
            size = min(window, len(v))
            for j in range(len(v) - size + 1 if size else 0):
                for i in range(len(w) - size + 1):
                    if w[i : i + size] == v[j : j + size]:
                        hit.update(range(i, i + size))
                        ids |= {str(item)} if item is not None else set()
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def corpus(seed, n=60):
    r = random.Random(seed)
    text = lambda k: " ".join(r.choices(["a", "b", "Ç", "d-e", "9"], k=k))
    items = [(k, text(r.choice([0, 1, 3, 11, 14]))) for k in range(8)] + [(3, text(12)), (None, text(11)), (50, None)]
    docs = [(k, text(r.randint(0, 40)) + (" " + (r.choice(items)[1] or "") if k % 3 == 0 else "")) for k in range(n)] + [(0, text(9)), (None, items[8][1]), (900, None), (901, "")]
    return docs, items


@pytest.mark.parametrize("block_bytes", [D.BLOCK_BYTES, 40])
def test_decontamination_equals_brute_force(spark, monkeypatch, block_bytes):
    docs, items = corpus(1)
    items = [x for x in items if x[1] is None or len(words(x[1])) != 1]
    b = D.blocks.__defaults__
    monkeypatch.setattr(D.blocks, "__defaults__", (block_bytes,))
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_hit", "2 as item_id")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = D.decontaminate(df, bench)
    got = sorted((tuple(r) for r in found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)
    assert got == brute_hits(docs, items)
    clean = D.clean_documents(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(not x[-1] for x in got)
    assert D.decontaminate(df.limit(0), bench).count() == 0
    assert D.decontaminate(df, bench.limit(0)).where("contaminated").count() == 0
    monkeypatch.setattr(D.blocks, "__defaults__", b)


def test_decontamination_query_equals_sql(spark):
    same(spark, queries.op5_decontaminate, oracles.DECONTAMINATE, SMALL)


def test_longest_matches(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, f"x y {item} z"), (2, item.rsplit(" ", 1)[0]), (3, "one two")], "doc_id long, text string")
    found = D.longest_matches(docs, spark.createDataFrame([(5, item)], "item_id long, text string"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, "5", 2, 0, 12), (2, "5", 0, 0, 11)]


@pytest.mark.parametrize("n", [5, 70_000])
def test_suffix_array_is_sorted(n):
    r = np.random.default_rng(8)
    ids = np.concatenate([*([*r.integers(1, 4, r.integers(0, 60)), *[0] * r.integers(1, 3)] for _ in range(80)), r.integers(1, n, 50), [0] * 10]).astype(np.uint32)
    for depth in (4, 11, 64):
        place, run = D.suffix_array(ids, 3, depth)
        own = [ids[p : p + k].tolist() for p, k in zip(place, run, strict=True)]
        assert all(0 not in x and ids[p + k] == 0 for x, p, k in zip(own, place, run, strict=True))
        assert [x[:depth] for x in own] == sorted(x[:depth] for x in own)
        assert sorted(place) == [p for p in range(len(ids) - 2) if (ids[p : p + 3] > 0).all()]


def test_longest_matches_equal_brute_force():
    docs, items = corpus(2)
    items = [x for x in items if x[1]]
    index = D.Index(items)
    d, v = [D.words(x) for _, x in docs], [D.words(x) for _, x in items]
    want = set()
    for a, w in enumerate(d):
        for t, x in enumerate(v):
            for i in range(len(w)):
                for j in range(len(x)):
                    n = 0
                    while i + n < len(w) and j + n < len(x) and w[i + n] == x[j + n]:
                        n += 1
                    if n >= min(10, len(x)) and (not i or not j or w[i - 1] != x[j - 1]):
                        want.add((a, t, i, j, n))
    got = list(index.longest(d))
    assert set(got) == want and len(got) == len(want) and max(x[-1] for x in got) > 10


@pytest.mark.parametrize("window", [2, 3, 10])
def test_found_matches_are_longest_and_cover_all(window):
    """Each found match is the longest at its place, and what they cover is what windows cover."""
    r = random.Random(window)
    text = lambda k: " ".join(r.choices("abcd", k=k))
    for _ in range(40):
        items = [(k, text(r.choice([0, 1, 2, 5, 12, 30]))) for k in range(r.randint(0, 6))]
        docs = [(text(r.randint(0, 40)) + " x " + r.choice([i for _, i in items] or [""]) + " " + text(3)).split() for _ in range(5)]
        index = D.Index(items, window)
        coded = [[w.encode() for w in d] for d in docs]
        starts, hits, _ = index.find(coded)
        tests = [i.split() for _, i in items if i]
        same = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        covered = set()
        for p, n in hits.tolist():
            k = int(np.searchsorted(starts, p, "right")) - 1
            d = docs[k][p - starts[k] :]
            fits = [same(d, t[j:]) for t in tests for j in range(len(t)) if same(d, t[j:]) >= min(window, len(t))]
            assert n == max(fits) if n >= window else any(t == d[:n] for t in tests)
            covered |= {p + z for z in range(n)}
        want = {int(starts[k]) + i + z for k, d in enumerate(docs) for i in range(len(d)) for t in tests for j in range(len(t) - min(window, len(t)) + 1) for z in range(min(window, len(t))) if d[i : i + min(window, len(t))] == t[j : j + min(window, len(t))]}
        assert covered == want


def test_a_passage_in_many_documents_and_items_is_listed_once_each():
    passage = " ".join(f"w{k}" for k in range(40))
    index = D.Index([(k, passage) for k in range(500)])
    docs = [D.words(passage)] * 500
    starts, hits, sets = index.find(docs)
    # One longest match in each document, whatever the number of items.
    assert hits[:, 1].tolist() == [40] * 500 and len(sets) == 500 and len(index.sets) == 1


def test_a_very_long_text():
    """A text longer than a shard, all of words of the benchmark, and one that repeats a window."""
    items = [(1, " ".join(f"w{k}" for k in range(30))), (2, "z " * 12)]
    index = D.Index(items)
    docs = [D.words("w3 w9 " * 300_000 + items[0][1]), D.words("z " * 200_000)]
    starts, hits, sets = index.find(docs)
    assert len(hits) <= 200_000 and hits[0].tolist() == [600_000, 30] and hits[:, 1].max() == 30
    edge = np.zeros(800_100, dtype=np.int64)
    np.add.at(edge, hits[:, 0], 1)
    np.add.at(edge, hits.sum(axis=1), -1)
    assert (np.cumsum(edge) > 0).sum() == 30 + 200_000 and [[index.ids[i] for i in index.sets[k]] for _, k in sets] == [["1"], ["2"]]


def brute_cut(docs, length):
    first, out = {}, []
    data = [(i, (x or "").encode()) for i, x in docs]
    for i, x in data:
        for p in range(len(x) - length + 1):
            if i is not None:
                first[x[p : p + length]] = min(i, first.get(x[p : p + length], i))
    for i, x in data:
        gone = np.zeros(len(x) + 2, bool)
        for p in range(len(x) - length + 1):
            if i is not None and first[x[p : p + length]] < i:
                gone[p + 1 : p + 1 + length] = True
        kept = bytes(c for c, g in zip(x, gone[1:], strict=False) if not g)
        out.append((i, len(x), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeated(seed):
    r = random.Random(seed)
    text = lambda k: "".join(r.choices("abcdé \n\0", k=k))
    parts = [text(r.randint(20, 120)) for _ in range(8)] + ["z" * 90, "xy" * 40]
    docs = [(k, "".join(r.choice(parts) if r.random() < 0.5 else text(r.randint(0, 60)) for _ in range(r.randint(0, 5)))) for k in r.sample(range(1000), 70)]
    return docs + [(docs[0][0], docs[0][1]), (docs[1][0], docs[2][1] + "!"), (None, docs[3][1]), (5000, None), (5001, ""), (5002, parts[0] * 300)]


@pytest.mark.parametrize(("seed", "length", "often", "hot"), [(1, 20, 64, 4096), (2, 20, 1, 1), (3, 50, 64, 4096), (4, 50, 2, 5), (5, 33, 64, 2)])
def test_suffix_dedup_equals_brute_force(spark, seed, length, often, hot):
    docs = repeated(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "2 as block").repartition(3)
    found = suffixes.remove_repeats(df, length, often, hot, kept=True)
    rows = found.collect()
    assert sorted((tuple(r)[:5] for r in rows), key=str) == brute_cut(docs, length)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows)


def test_suffix_dedup_of_little(spark):
    df = spark.createDataFrame([(1, "short")], "doc_id long, text string")
    assert [tuple(r)[:4] for r in suffixes.remove_repeats(df).collect()] == [(1, 5, 0, 0)]
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def test_suffix_query_equals_sql(spark):
    same(spark, queries.op6_suffix_dedup, oracles.SUFFIXES, SMALL)


def test_multikey_order(monkeypatch):
    monkeypatch.setattr(suffixes, "SMALL", 8)
    r = np.random.default_rng(6)
    w = r.integers(0, 4, (3_000, 4)).astype(np.uint64)
    got = w[suffixes.multikey_order(w)]
    assert got.tolist() == sorted(w.tolist())
    assert suffixes.multikey_order(np.zeros((100, 3), np.uint64)).tolist() and len(suffixes.multikey_order(w[:0])) == 0


def test_packing():
    a = {"x": np.arange(5, dtype=np.int64), "y": np.zeros(0, np.uint8), "z": np.array([7], np.uint16)}
    b = suffixes.unpack(suffixes.pack(a))
    assert all(np.array_equal(a[k], b[k]) and a[k].dtype == b[k].dtype for k in a)


def test_id_hash_is_sparks(spark):
    ids = [0, 1, -5, 1 << 40, -(1 << 63)]
    want = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").selectExpr("xxhash64(i)").collect()]
    assert suffixes.id_hash(np.array(ids)).tolist() == want


def test_anchors_do_not_depend_on_how_texts_are_cut(monkeypatch):
    r = random.Random(7)
    data = ["".join(r.choices("abc", k=5_000)).encode(), b"", b"abc" * 400]
    whole = suffixes.anchors(data, 50)
    monkeypatch.setattr(suffixes, "PIECE", 300)
    cut = suffixes.anchors(data, 50)
    covered = lambda a: {(d, p): k for d, x, y, k in zip(a["doc"], a["first"], a["last"], a["at"], strict=True) for p in range(x, y + 1)}
    assert covered(whole) == covered(cut)


@pytest.mark.parametrize("held", [1, 3_000, 1 << 28])
def test_a_line_in_every_slice(spark, monkeypatch, held):
    """1,000 documents in as many slices share a line; buckets settle what they can as it comes, with the same result."""
    monkeypatch.setattr(suffixes, "SLICE", 100)
    monkeypatch.setattr(suffixes, "HELD_BYTES", held)
    r = random.Random(8)
    line = "Licensed under the terms that stand in the file that came with it. "
    texts = ["".join(r.choices("abcdefgh ", k=r.randint(0, 60))) + line * r.choice([0, 1, 1, 1, 3]) + "".join(r.choices("abcdefgh ", k=r.randint(0, 60))) for _ in range(1000)]
    docs = [(r.choice([k, k, k // 2]), t) for k, t in enumerate(texts)] + [(None, line * 2), (5, "é" * 400), (6, "é" * 900)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = suffixes.remove_repeats(df, 50, 2, 16)
    assert sorted((tuple(r)[:5] for r in found.collect()), key=str) == brute_cut(docs, 50)


def test_settled_strings_change_nothing():
    """What is settled early and what is left give the spans of all at once."""
    r = np.random.default_rng(2)
    kinds = [bytes(r.integers(97, 100, 50, dtype=np.uint8)) for _ in range(6)]
    pick = r.integers(0, 6, 400)
    a = {"doc": r.integers(0, 60, 400), "tag": np.zeros(400, np.uint32), "start": r.integers(0, 5, 400) * 1000, "n": np.ones(400, np.uint8), "head": np.zeros(400, np.uint8), "data": np.frombuffer(b"".join(kinds[k] for k in pick), np.uint8)}
    covered = lambda parts: {(d, p) for x in parts for d, s, e in zip(x["doc"].tolist(), x["from"].tolist(), x["to"].tolist(), strict=True) for p in range(s, e)}
    whole = covered(suffixes.resolve(dict(a), 50))
    left, rows = suffixes.settled_strings(dict(a), 50, 3)
    early = covered(x for _, _, x in rows)
    assert early and len(left["doc"]) < 200 and early | covered(suffixes.resolve(dict(left), 50)) == whole
    again, rows = suffixes.settled_strings(suffixes.joined([dict(left), dict(a)]), 50, 3)
    assert covered(x for _, _, x in rows) | covered(suffixes.resolve(again, 50)) == whole


def test_a_very_long_text_through_spark(spark):
    """Longer than a piece and than a slice, with a passage of another document far inside."""
    r = random.Random(9)
    passage = "".join(r.choices("abcdefghijklmnop ", k=300))
    long = "".join(r.choices("abcdefghijklmnop ", k=5_000_000))
    docs = [(1, passage), (2, long[:3_000_000] + passage + long[3_000_000:]), (3, long[:70_000])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.remove_repeats(df).collect()}
    assert got == {1: (300, 0, 0), 2: (5_000_300, 300, 1), 3: (70_000, 70_000, 1)}
