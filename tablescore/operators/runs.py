"""Runs of extractors over samples: registry, retries, validation, records, summaries.

An extractor is any object with `extract(image: bytes, path: str) -> str`; a factory of such objects
stands for a model. Services are out of reach here, so recorded answers stand in for them
(replayed(), resolved()); attempts() runs live ones, with bounded concurrency, a retry policy of its own
and a ledger of answers, so that a lost task repeats no more calls than it must.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import RUN
from ..sources.stores import Ledger
from .converters import payload_to_html
from .scoring import score_tables


class Extractor(Protocol):
    def extract(self, image: bytes, path: str) -> str | None: ...


class Fatal(Exception):
    """An error that no retry mends: missing credentials, a refused request."""


@dataclass(frozen=True)
class Retry:
    attempts: int = 3
    first_wait: float = 1.0

    def waits(self) -> list[float]:
        """Seconds before each further attempt; they double."""
        return [self.first_wait * 2**k for k in range(self.attempts - 1)]

    def worst_wait(self) -> float:
        return sum(self.waits())


#: Families, their retry policy and how many calls may run at a time.
POLICIES = {
    "layout": (Retry(), 1), "forms": (Retry(first_wait=2.0), 1), "markdown": (Retry(), 1), "math": (Retry(), 1),
    "vision": (Retry(), 3), "elements": (Retry(attempts=20), 1), "pages": (Retry(), 1),
}
#: Families and the models that are asked by default.
MODELS = {
    "vision": ("google/gemini-2.5-pro", "google/gemini-2.5-flash", "anthropic/claude-3.5-sonnet", "openai/gpt-4o", "openai/gpt-4o-mini"),
    "layout": ("prebuilt-layout",), "math": ("mathpix",), "markdown": ("mistral-ocr-latest",), "forms": ("default",), "elements": ("hi_res",), "pages": ("default",),
}


def registry(spark: SparkSession) -> DataFrame:
    """(family, model, attempts, first_wait, worst_wait, slots), one row for each model."""
    rows = [(f, m, p.attempts, p.first_wait, p.worst_wait(), slots) for f, (p, slots) in POLICIES.items() for m in MODELS[f]]
    return spark.createDataFrame(rows, "family string, model string, attempts int, first_wait double, worst_wait double, slots int")


def worst_wait(attempts: Column, first_wait: Column) -> Column:
    """Seconds that a policy waits at most."""
    return first_wait * (F.pow(F.lit(2.0), attempts - 1) - 1)


def call(make: Callable[[], Extractor], image: bytes, path: str, policy: Retry, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, float]:
    """(result, error, seconds) of one sample; the time holds construction, calls and waits."""
    began = time.time()
    error = None
    for wait in [*policy.waits(), None]:
        try:
            return make().extract(image, path), None, time.time() - began
        except Fatal as e:
            error = str(e)
            break
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"
        if wait is not None:
            sleep(wait)
    return None, error, time.time() - began


def noted(ledger: Ledger | None, key: str, answer: Callable[[], tuple]) -> tuple:
    """The answer that the ledger has for a key, or a new one, which it gets."""
    if ledger is None:
        return answer()
    known = ledger.get(key)
    if known is None:
        ledger.put(key, known := {"answer": list(answer())})
    return tuple(known["answer"])


def attempts(samples: DataFrame, make: Callable[[], Extractor], policy: Retry = Retry(), slots: int = 1, ledger: str | None = None, name: str = "") -> DataFrame:
    """samples (image_path, content, ...) with pred_html, error and processing_time; as many calls at a time as there are slots.

    Partitions are read one after the other in so many tasks; images are not shuffled for it. With a ledger, a folder that
    all executors reach, each outcome is noted below name and image_path as soon as it is known, and no call is made for
    an image that has one: a lost task repeats one call, and a run that is started again goes on where it ended.
    """
    kept = [c for c in samples.columns if c != "content"]
    schema = ", ".join(f"`{c}` {t}" for c, t in samples.dtypes if c != "content") + ", pred_html string, error string, processing_time double"
    book = Ledger(ledger) if ledger else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [noted(book, f"{name}\n{p}", lambda c=c, p=p: call(make, c, p, policy)) for c, p in zip(batch["content"], batch["image_path"], strict=True)]
            yield batch[kept].assign(pred_html=[f[0] for f in found], error=[f[1] for f in found], processing_time=[f[2] for f in found])

    return samples.coalesce(slots).mapInPandas(run, schema)


def resolved(log: DataFrame, keys: Sequence[str], policy: Retry = Retry()) -> DataFrame:
    """What a retry policy makes of recorded attempts (keys, attempt, result, error, fatal, seconds): keys with pred_html, error,
    attempts (those made) and processing_time with the waits between them.

    A sample's attempts are made in their order until one has no error, is fatal, or the policy's number is
    reached; those recorded beyond that are not looked at, and no attempts are kept beyond it.
    """
    one = F.struct("attempt", "result", "error", F.coalesce("fatal", F.lit(False)).alias("fatal"), "seconds")
    tried = F.slice(F.array_sort(F.collect_list(one)), 1, policy.attempts)
    ends = F.transform("tried", lambda x: x["error"].isNull() | x["fatal"])
    n = F.when(F.array_position(ends, True) > 0, F.array_position(ends, True)).otherwise(F.size("tried")).cast("int")
    waits = F.lit(policy.first_wait) * (F.pow(F.lit(2.0), F.col("n") - 1) - 1)
    last = F.element_at("tried", F.col("n"))
    seconds = F.aggregate(F.slice("tried", 1, F.col("n")), F.lit(0.0), lambda s, x: s + x["seconds"])
    d = log.groupBy(*keys).agg(tried.alias("tried")).withColumn("n", n)
    return d.select(*keys, F.when(last["error"].isNull(), last["result"]).alias("pred_html"), last["error"].alias("error"), F.col("n").alias("attempts"), (seconds + waits).alias("processing_time"))


def replayed(pairs: DataFrame, payloads: DataFrame) -> DataFrame:
    """pairs with the recorded answer of each model: family, model, pred_html, error, processing_time."""
    p = payloads.select("stem", "family", "model", F.when(F.coalesce(F.col("status"), F.lit("ok")) == "ok", payload_to_html(F.col("family"), F.col("payload"))).alias("pred_html"), F.when(F.col("status") != "ok", F.col("status")).alias("error"), F.col("seconds").alias("processing_time"))
    return pairs.join(p, "stem")


def validated(result: Column) -> Column:
    """Whether an extractor's result counts: a string that is not empty."""
    return F.coalesce(result != "", F.lit(False))


def records(extracted: DataFrame, metrics: tuple[str, ...] = ("levenshtein", "teds"), graded_in: float | None = None) -> DataFrame:
    """Run records of extracted (family, model, image_path, ground_truth_path, gt_html, pred_html, error, processing_time).

    Failed runs are graded in no time and have no scores. graded_in: seconds of grading for each run that
    succeeded; by default those that its own parsing, grids and trees took.
    """
    ok = validated(F.col("pred_html"))
    s = score_tables(extracted.withColumn("scored_html", F.when(ok, F.col("pred_html"))), "gt_html", "scored_html", metrics, timed=True)
    grading = F.when(ok, F.col("grading_seconds") if graded_in is None else F.lit(float(graded_in))).otherwise(0.0)
    error = F.when(~ok, F.coalesce(F.col("error"), F.when(F.col("pred_html") == "", "empty result").otherwise("no result")))
    values = {
        "processor": F.col("family"), "grading_time": grading, "total_time": F.col("processing_time") + grading, "result": F.when(ok, F.col("pred_html")), "error": error,
        "scores": F.when(ok, F.struct("scores.levenshtein", "scores.teds")), "timestamp": F.unix_micros(F.current_timestamp()) / 1e6, "success": ok,
    }
    return s.select(*(values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in RUN))


def summary(runs: DataFrame, *keys: str) -> DataFrame:
    """Successes and runs for each key, by key."""
    return runs.groupBy(*keys).agg(F.count_if("success").alias("successes"), F.count(F.lit(1)).alias("runs")).orderBy(*keys)
