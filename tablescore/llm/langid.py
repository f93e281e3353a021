"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a seed and its code point. Three letters
in a row (a word boundary counts as a letter) bind to the product of their vectors, permuted by
place; a text is the sum of its bound trigrams, a language the sum of its training texts. A text is
given the language whose prototype has the largest cosine with it.

Training texts are a bounded sample: at most SAMPLE documents of each language, in the order of a
hash of the id, out of those that are not held out and have a language and a text. Prediction reads
whole texts and nothing else, in blocks of trigrams, so that a very long one takes no more memory.
Null texts and texts without a letter are `und` with score 0, as is everything if there is nothing to
learn from. Ties go to the first language in code-point order. Rows that repeat a doc_id are documents of
their own; in training all of them count where the id is in the sample. An empty table gives an empty one.
Columns that identify() adds replace those of the same names; recognised() adds none and keeps all.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filter_rows, slices, with_columns
from .mixing import shuffle_key

DIMENSIONS = 1_024
SEED = 20_240_502
#: Training documents of a language at most.
SAMPLE = 500
#: Rows of languages or of sampled ids up to which they are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Distinct trigrams whose vectors are held at a time.
HELD = 4_096
#: Texts below this score fit no learned language; see recognised(). Scores of unlearned scripts are noise with a standard
#: deviation of 0.031 and reached 0.115; the lowest of 3,000 texts that no prototype contains was 0.134. With fewer than
#: FULL_LETTERS letters clean texts score lower, so the bound falls with the root of their number.
LEAST_SCORE, FULL_LETTERS = 0.12, 25


@functools.cache
def letters() -> np.ndarray:
    """Lower-case code point of every code point that is a letter, 0 for all others."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low[0])
    return table


@functools.lru_cache(maxsize=20_000)
def letter_vector(code: int) -> np.ndarray:
    return (np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1).astype(np.int8)


def encode(texts: list[str]) -> np.ndarray:
    """Sum of the bound trigram vectors of each text; zero without letters."""
    n = len(texts)
    joined = "".join(f" {t} " for t in texts)
    codes = letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")].astype(np.uint64)
    doc = np.repeat(np.arange(n), [len(t) + 2 for t in texts])
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (doc[1:] != doc[:-1])
    codes, doc = codes[keep], doc[keep]
    # Sums of whole numbers, exact in any order: in single precision as long as no text has 2^24 letters.
    kind = np.float32 if len(joined) < 1 << 24 else np.float64
    out = np.zeros((n, DIMENSIONS), dtype=np.float64)
    if len(codes) < 3:
        return out
    grams = (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]
    ok = (doc[:-2] == doc[2:]) & (grams != 0)
    grams, place = np.unique(grams[ok], return_inverse=True)
    doc = doc[:-2][ok]
    mask = np.uint64((1 << 21) - 1)
    for start in range(0, len(grams), HELD):
        g = grams[start : start + HELD]
        alphabet, at = np.unique(np.concatenate([g >> np.uint64(42), (g >> np.uint64(21)) & mask, g & mask]), return_inverse=True)
        a, b, c = at.reshape(3, -1)
        v = np.stack([letter_vector(int(x)) for x in alphabet])
        bound = (np.roll(v, 2, axis=1)[a] * np.roll(v, 1, axis=1)[b] * v[c]).astype(kind)
        if len(grams) > HELD:
            own = (place >= start) & (place < start + HELD)
            d, p = doc[own], place[own] - start
        else:
            d, p = doc, place
        out += np.bincount(d * len(g) + p, minlength=n * len(g)).reshape(n, len(g)).astype(kind) @ bound
    return out


def held_out(doc_id: Column) -> Column:
    """Whether the CRC-32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Profiles:
    def __init__(self, languages: list[str], sums: np.ndarray):
        self.languages = languages
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        self.unit = sums / np.where(norm, norm, 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        x = encode([t or "" for t in texts])
        norm = np.linalg.norm(x, axis=1)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        # One product a row and language: a row's score does not depend on the rows beside it.
        cos = np.stack([np.einsum("ij,j->i", x, u) for u in self.unit], axis=1) / np.where(norm, norm, 1)[:, None]
        best = cos.argmax(axis=1)
        score = np.clip(cos[np.arange(len(texts)), best], 0, 1)
        return [self.languages[k] if m else "und" for k, m in zip(best.tolist(), norm.tolist(), strict=True)], np.where(norm, score, 0.0)


def sent(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def learn(docs: DataFrame, sample: int = SAMPLE) -> Profiles:
    """Profiles from docs (doc_id, text, lang); one vector for each language reaches the driver."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    # Ids whose hashes are low enough for about twice the sample, so that few rows of a frequent language meet in the window.
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(2.0 * sample + 100) / F.count(F.lit(1))).alias("share"))
    low = rows.select("doc_id", "lang").join(sent(share), "lang").where(shuffle_key(F.col("doc_id")) <= F.col("share") * 2.0**60)
    order = Window.partitionBy("lang").orderBy(shuffle_key(F.col("doc_id")), "doc_id")
    chosen = low.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).select("doc_id", "lang").distinct()
    train = rows.where("text is not null").select("doc_id", "lang", "text").join(sent(chosen), ["doc_id", "lang"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", 1 << 20):
                x = encode(part.column("text").to_pylist())
                langs = np.array(part.column("lang").to_pylist(), dtype=object)
                for lang in sorted(set(langs)):
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([x[langs == lang].sum(axis=0, dtype=np.float64).tobytes()], pa.binary())], names=["lang", "v"])

    def total(rows: pa.Table) -> pa.Table:
        sums = np.frombuffer(b"".join(rows.column("v").to_pylist()), dtype=np.float64).reshape(-1, DIMENSIONS)
        return pa.table({"lang": rows.column("lang").slice(0, 1), "v": pa.array([sums.sum(axis=0).tobytes()], pa.binary())})

    kinds = "lang string, v binary"
    sums = {r.lang: np.frombuffer(r.v, dtype=np.float64) for r in train.select("lang", "text").mapInArrow(run, kinds).groupBy("lang").applyInArrow(total, kinds).collect()}
    names = sorted(sums, key=lambda s: s.encode())
    return Profiles(names, np.array([sums[k] for k in names]).reshape(len(names), DIMENSIONS))


PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """docs with lang_pred and score, from the column text alone; columns of these names are replaced."""
    model = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batch: pa.RecordBatch) -> dict:
        lang, score = model.value.predict(batch.column("text").to_pylist())
        return {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())}

    return with_columns(docs, "text", PREDICTED, run, 1 << 20)


def few_letters(text: str | None) -> int:
    """Number of letters, FULL_LETTERS at most."""
    n = 0
    for c in text or "":
        n += c.isalpha()
        if n == FULL_LETTERS:
            break
    return n


def recognised(docs: DataFrame, sample: int = SAMPLE, least: float = LEAST_SCORE) -> DataFrame:
    """docs without the documents that fit no learned language: those that are `und` or score below least, or below as
    much less as their letters are few."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, sample))

    def keep(batch: pa.RecordBatch) -> np.ndarray:
        texts = batch.column("text").to_pylist()
        lang, score = model.value.predict(texts)
        letters = np.array([few_letters(x) for x in texts], dtype=float)
        return (np.array(lang, dtype=object) != "und") & (score >= least * np.sqrt(letters / FULL_LETTERS))

    return filter_rows(docs, "text", keep, 1 << 20)
