import re

import numpy as np
import pytest
import xxhash
from conftest import SMALL
from oracle import same

from tablescore.llm import embeddings, oracles, queries, simhash
from tablescore.llm.common import connected_components, join_keyed, local_stars


def reachable(adjacent, ids):
    """Smallest id reachable from each row."""
    out = np.array(ids)
    while True:
        new = np.array([min([out[i], *out[adjacent[i]]]) for i in range(len(ids))])
        if (new == out).all():
            return out.tolist()
        out = new


def test_components(spark):
    r = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 120, (90, 2))] + [(k, k + 1) for k in range(200, 260)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {x.id: x.component for x in connected_components(df).collect()}
    known = [(a, b) for a, b in edges if a is not None and a != b]
    ids = sorted({x for e in known for x in e})
    label = local_stars(300, np.array([a for a, _ in known]), np.array([b for _, b in known]))
    assert got == {i: int(label[i]) for i in ids}
    assert connected_components(df.limit(0)).count() == 0


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode())
    h = [xxhash.xxh64(b" ".join(w[i : i + 3]), seed=42).intdigest() for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h)) if h else 0


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One TWO", "a b c", "É é x ß İ", "x " * 5000 + "y", "w" * 100_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == fingerprint(text)


def test_simhash_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    fp = np.array([fingerprint(r.text) for r in rows], dtype=np.uint64)
    want = reachable(np.bitwise_count(fp[:, None] ^ fp[None]) <= 3, [r.doc_id for r in rows])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash_dedup(spark, SMALL).collect()}
    assert got == {r.doc_id: (f"{int(f):016x}", c) for r, f, c in zip(rows, fp, want, strict=True)}


def test_simhash_odd_rows(spark):
    rows = [(7, "a b c d", 1), (3, "A B  c\td", 2), (9, None, 3), (4, "", 4), (None, "a b c d", 5), (5, "q r s t u v", 6), (5, "q r s t u v", 6), (8, "lone words here now", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, None), (3, 3), (4, 4), (5, 5), (5, 5), (7, 3), (8, 8), (9, 4)]
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 4, 5, 8]
    assert simhash.near_duplicates(df.limit(0)).count() == simhash.one_of_each(df.limit(0)).count() == 0


def test_one_doc_id_with_two_texts_hangs_together(spark):
    df = spark.createDataFrame([(2, "a b c d"), (2, "l m n o p"), (1, "l m n o p"), (6, "a b c d")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == {1: 1, 2: 1, 6: 1}


@pytest.mark.parametrize("node_rows", [50_000, 40, 4, 1])
def test_trie_join(spark, node_rows):
    r = np.random.default_rng(2)
    keys = set()
    for base in r.integers(0, 1 << 63, 40, dtype=np.int64).tolist():
        for _ in range(25):
            v = base
            for k in r.integers(0, 64, r.integers(0, 6)).tolist():
                v ^= 1 << k
            keys.add(v)
    keys = np.array(sorted(keys), dtype=np.uint64)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(keys.view(np.int64))], "id long, bits long")
    f = simhash.hamming_forest(df, 3, node_rows).collect()
    got = local_stars(len(keys), np.array([x.a for x in f]), np.array([x.b for x in f]))
    assert got.tolist() == reachable(np.bitwise_count(keys[:, None] ^ keys[None]) <= 3, range(len(keys)))


@pytest.mark.parametrize("n", [10, 1 << 23, 1 << 40])
def test_tries_cover_all_pairs(n):
    """Whatever three bits differ, some trie has both keys in one subtree."""
    r = np.random.default_rng(3)
    plans = simhash.layouts(n, 3)
    a = r.integers(0, 1 << 63, 500, dtype=np.int64).view(np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << r.integers(0, 64, 500).astype(np.uint64)
    met = np.zeros(500, bool)
    for order, depth in plans:
        assert sorted(order) == simhash.pieces(0, 64, len(order))
        s = np.uint64(64 - depth)
        met |= (simhash.rearranged(a, order) >> s) == (simhash.rearranged(b, order) >> s)
    assert met.all()


def vectors():
    r = np.random.default_rng(4)
    rows = []
    for c in range(12):
        centre = r.standard_normal(64)
        for _ in range(12):
            rows.append(((centre + r.standard_normal(64) * r.choice([0.02, 0.1, 0.15])).astype("f4").tolist(), c % 3))
    rows += rows[:10]
    odd = [(None, 0), ([0.0] * 64, 0), ([float("nan")] * 64, 0), ([float("inf")] * 64, 0), ([1.0, None], 0), ([], 0), ([1.0] * 3, 1), ([2.0] * 3, 1), (rows[0][0], None), ([3e38] * 64, 2), ([1e-40] * 64, 2)]
    return [(i, x, y) for i, (x, y) in enumerate(rows + odd)]


def linked(rows):
    ok = [x is not None and len(x) > 0 and None not in x and np.isfinite(x).all() and any(x) and y is not None for _, x, y in rows]
    out = np.zeros((len(rows), len(rows)), bool)
    for i, (_, x, y) in enumerate(rows):
        for j, (_, v, w) in enumerate(rows):
            if i != j and ok[i] and ok[j] and y == w and len(x) == len(v):
                a, b = np.array(x, "f4").astype(float), np.array(v, "f4").astype(float)
                out[i, j] = a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.93
    return out


@pytest.mark.parametrize("block", [2_048, 5])
def test_embeddings_equal_brute_force(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    adjacent = linked(rows)
    want = reachable(adjacent, range(len(rows)))
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, block=block).collect()}
    n = np.array([got[i].n_links for i in range(len(rows))])
    assert (n <= adjacent.sum(1)).all() and n.sum() >= 0.99 * adjacent.sum()
    assert [got[i].component_id for i in range(len(rows))] == want
    assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())


def test_embeddings_rerun_repeat_and_empty(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as n_links", "2 as id")
    found = sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect())
    assert found == [(-1, 0, None, False), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embedding_recall_of_the_production_tables():
    for n in (0, 1, 1_000, 10**5, 10**6, 10**8):
        tables, floors = embeddings.tables_for(n, 0.93)
        assert embeddings.recall(0.93, tables, floors) >= 0.985 and embeddings.recall(0.97, tables, floors) > 0.999 and n * embeddings.share(0.0) ** floors <= embeddings.NODE
    assert embeddings.tables_for(1, 0.93) == (16, 9) and embeddings.tables_for(10**8, 0.93)[0] < 80


@pytest.mark.parametrize("bucket", [4_096, 8])
def test_meetings_of_large_buckets(spark, bucket):
    """Half of the vectors share every bucket; dealt out as pairs of blocks, they hang together all the same."""
    r = np.random.default_rng(7)
    rows = [(i, ([1.0] * 64 + r.standard_normal(64) * 1e-3).astype("f4").tolist() if i % 2 else r.standard_normal(64).astype("f4").tolist(), 1) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    node = {x.vec_id: x.d1 for x in embeddings.with_digests(df).collect()}
    found = {x.id: x.component for x in connected_components(embeddings.meetings(df, 4, 9, 2.0, bucket)).collect()}
    assert len({found[node[i]] for i in range(1, 400, 2)}) == 1
    got = embeddings.near_duplicates(df, block=32).collect()
    assert all((x.n_links, x.component_id) == ((199, 1) if x.vec_id % 2 else (0, x.vec_id)) for x in got)


def test_hot_keys_are_joined_whole(spark):
    left = spark.range(50_000).selectExpr("if(id < 30000, 1, id) as k", "id")
    right = left.groupBy("k").count().withColumnRenamed("count", "n").withColumn("x", queries.F.col("k") * 2).where("k <> 40000")
    for how, want in (("inner", 49_999), ("left", 50_000)):
        out = join_keyed(left, right, "k", "n", 50_000, how)
        assert out.count() == want and out.where("x <> 2 * k").count() == 0 and out.where("x is null").count() == want - 49_999


def test_embedding_query_equals_sql(spark):
    same(spark, queries.op1_embedding_dedup, oracles.EMBEDDINGS, SMALL)


def test_one_of_each_joins_what_has_four_fifths_of_its_five_word_shingles_in_common(spark):
    """Copies with some words replaced, a group of them too, against all pairs of sets; few are within three bits of three-word fingerprints."""
    r = np.random.default_rng(5)
    rows = []
    for base in range(60):
        w = [f"w{k}" for k in r.integers(0, 5_000, 300)]
        for changed in r.integers(0, 14, 30 if base == 7 else 2).tolist():
            v = list(w)
            for k in r.choice(300, changed, replace=False).tolist():
                v[k] = f"x{r.integers(0, 5_000)}"
            rows.append((len(rows), " ".join(v)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x.split() for _, x in rows)]
    adjacent = np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    fp = np.array([fingerprint(x) for _, x in rows], dtype=np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= 3
    assert (adjacent & ~near).sum() > 40 and not adjacent.all(1).any()
    want = reachable(adjacent, range(len(rows)))
    got = sorted(x.doc_id for x in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(set(want))


def test_unrelated_vectors_meet_seldom(spark, monkeypatch):
    """Random vectors of one label, some near copies among them: all links are found, and buckets stay small."""
    monkeypatch.setattr(embeddings, "NODE", 2)
    r = np.random.default_rng(4)
    v = r.standard_normal((1500, 32))
    v[1000:1400] = v[:400] + 0.15 * r.standard_normal((400, 32))
    v = v.astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").repartition(4)
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1)[:, None]
    near = (unit @ unit.T >= 0.93) & ~np.eye(len(v), dtype=bool)
    assert near.sum() > 500
    got = {x.vec_id: (x.n_links, x.component_id) for x in embeddings.near_duplicates(df).collect()}
    want = dict(enumerate(zip(near.sum(axis=1).tolist(), reachable(near, list(range(len(v)))), strict=True)))
    # RECALL is a probability for each pair at the limit; most of these are well above it.
    assert sum(got[k] == want[k] for k in want) >= 0.985 * len(want) and all(got[k][0] <= want[k][0] for k in want)
    tables, floors = embeddings.tables_for(1500, 0.93)
    sizes = embeddings.memberships(df, tables, floors, embeddings.WIDTH).groupBy("slot").count()
    pairs = sum(x["count"] * (x["count"] - 1) // 2 for x in sizes.collect())
    assert pairs < 1500 * tables * 2


def test_a_star_of_the_largest_id(spark, monkeypatch):
    """Its centre is joined apart in both steps."""
    from tablescore.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 8)
    edges = [(1000, k) for k in range(300)] + [(2000, 1000 + k) for k in range(500, 520)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {x.id: x.component for x in connected_components(df).collect()}
    assert got == {k: 0 for k in (*range(300), 1000)} | {k: 1500 for k in (*range(1500, 1520), 2000)}


def test_many_rows_of_one_id(spark):
    """One row of an id stays, whatever the number of its rows and texts; extra columns are kept."""
    rows = [(7, "a b c d e f g", "x", {"k": 1})] * 300 + [(7, f"other words {k} here now and then", "y", None) for k in range(50)] + [(8, "a b c d e f g", "z", None), (9, "not alike in any way at all", "z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _near_number string, extra map<string, int>").repartition(6)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [7, 9]
    assert "Window" not in kept._jdf.queryExecution().executedPlan().toString()
