import zlib
from collections import Counter

import numpy as np
from conftest import SMALL

from tablescore.llm import langid, queries


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.op3_language_id(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def test_odd_rows(spark):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog with them", "en"), ("der hund und die katze mit ihnen", "de")] * 20)]
    odd = [(1000, None, "xx"), (1001, "", "xx"), (1002, "123 !!", "xx"), (1003, "the dog", None), (1004, "汉字", None), (1005, "und die katze " * 20_000, None), (None, "the cat", "en")]
    df = spark.createDataFrame(train + odd, "doc_id long, text string, lang string").selectExpr("*", "'?' as score")
    model = langid.learn(df)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, model).collect()}
    assert got[1000] == got[1001] == got[1002] == ("und", 0.0)
    assert got[1003][0] == "en" and got[1005][0] == "de"
    assert set(model.languages) <= {"en", "de", "xx"} and "doc_id" in df.columns
    kept = langid.recognised(df)
    assert kept.columns == df.columns and {1003, 1005, None} <= {r.doc_id for r in kept.collect()}
    assert not {1000, 1001, 1002} & {r.doc_id for r in kept.collect()}


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(0, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(df, langid.learn(df)).collect()] == [("und", 0.0)]
    assert langid.identify(df.limit(0), langid.learn(df.limit(0))).count() == 0


def test_sample_is_bounded_and_reruns_agree(spark):
    df = spark.createDataFrame([(i, f"word{chr(97 + i % 26)} text", "en") for i in range(200)], "doc_id long, text string, lang string")
    a, b = langid.learn(df, 10), langid.learn(df.repartition(3), 10)
    assert np.allclose(a.unit, b.unit)
    assert langid.learn(df, 10).unit.shape == (1, langid.DIMENSIONS)


def test_encoding_does_not_depend_on_neighbours():
    texts = ["Élan vital, oui", "", "x", "a b", "ab", "汉字汉字"]
    whole = langid.encode(texts)
    assert all(np.array_equal(whole[i], langid.encode([t])[0]) for i, t in enumerate(texts))
    assert np.array_equal(langid.encode(["AB-c"])[0], langid.encode(["ab  ,C"])[0])
    assert not whole[1].any() and whole[2].any()


def test_many_distinct_trigrams():
    text = "".join(chr(0x4E00 + k) for k in range(6_000))
    assert np.array_equal(langid.encode([text, "x"])[0], langid.encode([text])[0])


def test_unlearned_scripts_are_not_recognised(spark):
    """Letters of scripts that no training text has, whose scores are noise; texts that no prototype contains stay."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    r = np.random.default_rng(6)
    scripts = [range(0x430, 0x450), range(0x3B1, 0x3CA), range(0x627, 0x64B), range(0xAC00, 0xD7A3)]
    foreign = [" ".join("".join(map(chr, r.choice(s, r.integers(2, 9)))) for _ in range(n)) for s in scripts for n in (10, 200) for _ in range(10)]
    model = langid.learn(docs)
    assert not (model.predict(foreign)[1] >= langid.LEAST_SCORE).any()
    unseen = [x.text for x in docs.where(langid.held_out(langid.F.col("doc_id"))).collect()]
    assert (model.predict(unseen)[1] >= langid.LEAST_SCORE).all()


def plain_model(rows):
    """Languages and prototypes from (text, lang), letter by letter and trigram by trigram."""
    sums = {}
    for text, lang in rows:
        sums[lang] = sums.get(lang, np.zeros(langid.DIMENSIONS)) + plain_encoding(text)
    names = sorted(sums, key=lambda s: s.encode())
    return names, [sums[k] / (np.linalg.norm(sums[k]) or 1) for k in names]


def plain_encoding(text):
    letters, total = [0], np.zeros(langid.DIMENSIONS)
    for c in text:
        code = ord(c.lower()[0]) if c.isalpha() else 0
        if code or letters[-1]:
            letters.append(code)
    grams = Counter(zip(*(x[k:] for k, x in enumerate([(letters + [0] if letters[-1] else letters)] * 3)), strict=False))
    for (a, b, c), n in grams.items():
        total += n * (np.roll(langid.letter_vector(a), 2).astype(int) * np.roll(langid.letter_vector(b), 1) * langid.letter_vector(c))
    return total


def test_query_equals_brute_force(spark):
    """No language of the small table has more training documents than the sample takes."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    is_held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in docs}
    train = [(r.text, r.lang) for r in docs if not is_held[r.doc_id] and r.lang is not None and r.text is not None]
    assert max(Counter(lang for _, lang in train).values()) <= langid.SAMPLE
    names, unit = plain_model(train)
    got = {r.doc_id: r for r in queries.op3_language_id(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for r in docs:
        x = plain_encoding(r.text or "")
        cos = [float(x @ u) / (np.linalg.norm(x) or 1) for u in unit]
        want = names[int(np.argmax(cos))] if x.any() else "und"
        g = got[r.doc_id]
        assert (g.held_out, g.lang_pred) == (is_held[r.doc_id], want)
        assert abs(g.score - (min(max(max(cos), 0), 1) if x.any() else 0)) < 1e-9


def test_short_clean_texts_stay(spark):
    """The bound falls with the letters: most single words of unseen documents stay, and noise of some words goes."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.learn(docs)
    words = [w for r in docs.where(langid.held_out(docs.doc_id)).collect() for w in (r.text or "").split() if w.isalpha()]
    assert [langid.few_letters(x) for x in (None, "", "1 a-b", "x" * 99)] == [0, 0, 2, langid.FULL_LETTERS]
    bound = lambda texts: langid.LEAST_SCORE * np.sqrt([langid.few_letters(x) / langid.FULL_LETTERS for x in texts])
    for k, share in ((1, 0.88), (3, 0.97), (8, 0.995)):
        texts = [" ".join(words[i : i + k]) for i in range(0, len(words) - k, 7)][:1500]
        assert (model.predict(texts)[1] >= bound(texts)).mean() > share
    r = np.random.default_rng(3)
    noise = ["".join(chr(c) if c % 7 else " " for c in r.integers(0x430, 0x450, 60)) for _ in range(500)]
    assert (model.predict(noise)[1] >= bound(noise)).mean() < 0.01
