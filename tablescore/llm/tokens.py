"""Token counts under a unigram model, one forward pass over a trie of the distinct pre-tokens.

The pieces are those of a byte-level vocabulary file, the path of which is a parameter. Such files
hold ranks, not probabilities; a piece of rank r gets the Zipf-Mandelbrot cost ln(r + SHIFT) + ln Z,
in whole millionths, so that sums are exact. A pre-token is cut into the pieces of least total cost,
among those into the fewest. Every byte is a piece, so each text has a segmentation.

The distinct pre-tokens of a slice of documents are walked in sorted order, which is a depth-first
walk of their trie: the forward costs of a shared prefix stay on a stack and are computed once. The
result at a pre-token's last node is stored and added up for each document.

Null and empty texts have no tokens. Rows that repeat a doc_id are documents of their own. Texts are
counted whole; a pre-token of any length is walked once. An empty table gives an empty one. Columns
that the operator adds replace those of the same names.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import with_columns

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
SHIFT = 2.7
#: Low bits of a value that count tokens; the others hold the cost. No text has 2^32 bytes, and each token has one at least.
COUNT_BITS = 32
#: Pre-tokens whose values a worker keeps from one slice to the next.
KEPT = 500_000


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Unigram:
    """values() gives (cost << COUNT_BITS) + tokens of each word."""

    def __init__(self, ranks: dict[bytes, int]):
        total = math.log(sum(1 / (r + SHIFT) for r in ranks.values()))
        self.step: dict[bytes, int] = {}
        for piece, rank in ranks.items():
            for k in range(1, len(piece)):
                self.step.setdefault(piece[:k], 0)
            self.step[piece] = (round(1e6 * (math.log(rank + SHIFT) + total)) << COUNT_BITS) + 1

    def values(self, words: list[bytes]) -> dict[bytes, int]:
        """Of distinct words."""
        get, out = self.step.get, {}
        best, open_at = [0], [[]]  # by depth: least value of the prefix, starts of pieces that may go on
        last = b""
        for word in sorted(words):
            depth = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                depth += 1
            del best[depth + 1 :], open_at[depth + 1 :]
            for end in range(depth + 1, len(word) + 1):
                alive, least = [], None
                for start in (*open_at[-1], end - 1):
                    v = get(word[start:end])
                    if v is not None:
                        alive.append(start)
                        if v and (least is None or best[start] + v < least):
                            least = best[start] + v
                best.append(least)
                open_at.append(alive)
            out[word] = best[-1]
            last = word
        return out


COUNTED = T.StructType([T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("cost", T.DoubleType())])


def count(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """docs with n_pretokens, n_tokens and cost (negative log-probability in nats); columns of these names are replaced."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    state: dict = {}

    def run(batch: pa.RecordBatch) -> dict:
        if not state:
            state.update(model=Unigram(ranks.value), split=regex.compile(pattern), known={})
        known: dict[bytes, int] = state["known"]
        docs = [state["split"].findall(x or "") for x in batch.column("text").to_pylist()]
        new = {w for d in docs for w in d if w not in known}
        if len(known) + len(new) > KEPT:
            known.clear()
            new = {w for d in docs for w in d}
        coded = {w: w.encode("utf-8", "surrogatepass") for w in new}
        found = state["model"].values(list(coded.values()))
        known.update((w, found[b]) for w, b in coded.items())
        mask = (1 << COUNT_BITS) - 1
        n, cost = [], []
        for d in docs:
            v = [known[w] for w in d]
            n.append(sum(x & mask for x in v))
            cost.append(sum(x >> COUNT_BITS for x in v) / 1e6)
        return {"n_pretokens": pa.array([len(d) for d in docs], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "cost": pa.array(np.array(cost), pa.float64())}

    return with_columns(docs, "text", COUNTED, run)
