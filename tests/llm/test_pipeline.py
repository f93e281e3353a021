import duckdb
import pandas as pd
from conftest import SMALL
from test_near_duplicates import reachable
from test_passages import words

import corpus_pipeline
from tablescore.llm import langid, mixing, oracles, pii


def test_run_equals_brute_force(spark):
    """Each stage anew: languages text by text, all pairs of sets of five-word shingles, all windows, spans one by one, and SQL for the mix."""
    import numpy as np

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.learn(docs)
    rows = docs.toPandas()
    found = [model.predict([x]) for x in rows.text]
    bound = [langid.LEAST_SCORE * min(1, sum(c.isalpha() for c in x) / langid.FULL_LETTERS) ** 0.5 for x in rows.text]
    rows = rows[[lang[0] != "und" and s[0] >= b for (lang, s), b in zip(found, bound, strict=True)]].sort_values("doc_id")
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (x.encode().lower().split() for x in rows.text)]
    near = np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    assert near.sum() > len(rows)
    rows = rows[np.array(reachable(near, rows.doc_id.tolist())) == rows.doc_id]
    windows = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[j : j + 10]) for j in range(max(len(w) - 9, 1))}
    assert {len(w) for w in windows} == {10}
    rows = rows[[not any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9)) for w in map(words, rows.text)]]
    rows["text"] = [pii.redacted(x, b + pii.added_spans([x], [b])[0]) for x, b in ((x, pii.base_spans(x)) for x in rows.text)]
    documents = rows  # noqa: F841
    c = duckdb.connect()
    c.register("documents", rows)
    copies = {r[0]: r[1] for r in c.sql(f"select doc_id, copies from ({oracles.MIX})").fetchall()}
    want = sorted((r.doc_id, r.text, k) for r in rows.itertuples() for k in range(1, copies[r.doc_id] + 1))
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == [*docs.columns, "copy"]
    assert sorted((r.doc_id, r.text, r.copy) for r in out.collect()) == want


def test_stages_take_odd_rows(spark, tmp_path):
    rows = [(1, "the cat and the dog " * 9, "en", "s", 1), (1, "the cat and the dog " * 9, "en", "s", 1), (2, None, None, None, None), (None, "the bird sings", "en", None, 5), (3, "", "en", "s", 0), (4, "x" * 200_000, "en", "t", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: mixing.F.lit(7) for c in ("score", "size", "copies", "contaminated", "spans", "fp", "id", "bits", "block", "component_id")})
    pd.DataFrame({"item_id": [1], "text": ["q " * 12]}).to_parquet(tmp_path / "benchmark.parquet")
    for data in (df, df.limit(0)):
        d = data
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            d = stage(spark, d, str(tmp_path))
            assert d.columns[: len(df.columns)] == df.columns and (k == 4 or d.columns == df.columns)
            if data is df and k == 3:
                ids = [r.doc_id for r in d.collect()]
                assert ids.count(1) == 1 and None in ids and 2 not in ids and 3 not in ids
                assert all(v == 7 for r in d.collect() for v in r[len(rows[0]) :])
        assert data is df or d.count() == 0
