import random

import pandas as pd
import pytest
from conftest import SMALL
from oracle import same

from tablescore.llm import mixing, oracles, queries


def table(seed, n=300):
    r = random.Random(seed)
    rows = [(i, " ".join("w" * r.randint(1, 3) for _ in range(r.choice([0, 1, 5, 30]))), r.choice(["a", "a", "a", "B", "é", "z", None])) for i in range(n)]
    return rows + [(n, "one", "tiny"), (n + 1, None, "void"), (n + 2, "", None), (n + 3, " \t\n\x0b\x0c\r", "a"), (n + 4, "x " * 50_000, "big")]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("small", [False, True])
def test_mix_equals_sql(spark, tmp_path, monkeypatch, seed, small):
    if small:
        monkeypatch.setattr(mixing, "RUN_ROWS", 7)
    df = pd.DataFrame(table(seed), columns=["doc_id", "text", "source"])
    df["size"], df["rank"], df["target"] = 1, 2, 3
    df.to_parquet(tmp_path / "documents.parquet")
    same(spark, queries.op7_mix, oracles.MIX, str(tmp_path))


def test_query_equals_sql(spark):
    same(spark, queries.op7_mix, oracles.MIX, SMALL)


def test_targets_and_limits(spark):
    df = spark.createDataFrame(table(3), "doc_id long, text string, source string")
    rows = [r.asDict() for r in mixing.mix(df).collect()]
    total = sum(r["size"] for r in rows)
    assert all(r["copies"] <= 3 for r in rows) and sum(r["taken"] for r in rows) <= total
    by = {}
    for r in rows:
        s = by.setdefault(r["source"], {"target": r["target"], "size": r["source_size"], "taken": 0, "largest": 0})
        s["taken"] += r["taken"]
        s["largest"] = max(s["largest"], r["size"])
    assert sum(s["target"] for s in by.values()) == pytest.approx(total)
    largest = max(s["largest"] for s in by.values())
    for s in by.values():
        assert s["target"] <= 3 * s["size"] + 1e-9 and abs(s["taken"] - s["target"]) <= s["largest"] + largest


def test_repeated_rows_and_reruns(spark):
    df = spark.createDataFrame(table(4) * 2, "doc_id long, text string, source string")
    key = lambda d: sorted((tuple(r) for r in d.collect()), key=str)
    assert key(mixing.mix(df)) == key(mixing.mix(df.repartition(7)))


def test_repeated_documents(spark):
    df = spark.createDataFrame(table(6, 60) * 3, "doc_id long, text string, source string")
    m = sorted((r.doc_id, r.copies) for r in mixing.mix(df).collect() if r.copies)
    want = {}
    for i, n in m:
        want[i] = want.get(i, 0) + n
    rows = [r.doc_id for r in mixing.mixed_documents(df).collect()]
    assert pd.Series(rows).value_counts().to_dict() == want


@pytest.mark.parametrize("run", [1_000, 7])
def test_many_rows_alike(spark, monkeypatch, run):
    """A third of all rows has no id, the same source and the same size; each copy is counted, and reruns take the same texts."""
    monkeypatch.setattr(mixing, "RUN_ROWS", run)
    rows = [(None, f"{k} one two", "hot") for k in range(400)] + table(7)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m = mixing.mix(df).collect()
    assert len(m) == len(rows)
    hot = sorted(r.copies for r in m if r.doc_id is None and r.source == "hot")
    total = sum(r["size"] for r in m)
    assert total - sum(r.taken for r in m) <= 3 * 50_000 and sum(r.taken for r in m) <= total
    a, b = (sorted(x.text for x in mixing.mixed_documents(d).collect() if x.source == "hot") for d in (df, df.repartition(5)))
    assert a == b and len(a) == sum(hot) and max(hot) - min(hot) <= 1


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == mixing.mixed_documents(df).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, None)], df.schema)).first().taken == 0


def test_documents(spark):
    df = spark.createDataFrame(table(5), "doc_id long, text string, source string").selectExpr("*", "'k' as copy", "5 as size")
    m = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    out = mixing.mixed_documents(df)
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "source", "size", "copy"]
    assert {i: n for i, n in m.items() if n} == pd.Series([r.doc_id for r in rows]).value_counts().to_dict()


def test_no_python_in_the_plan(spark):
    plan = mixing.mix(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
