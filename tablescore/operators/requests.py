"""Requests to extraction services as JSON columns, and live calls whose answers take the way of recorded ones.

What a service is asked is data: request() builds it from columns. How it is sent is a function that
the caller brings, `send(request, image) -> answer as JSON`; called() runs it with the family's retry
policy and as many calls at a time as the family allows. Credentials belong to that function.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import data_uri, encoded
from ..sources.stores import Ledger
from .converters import TABLE_PROMPT, payload_to_html
from .runs import POLICIES, Fatal, call, noted

#: Fixed value: the role of models that see the page.
SYSTEM_PROMPT = "You are an expert at analyzing documents and extracting table data. Extract all tables from the provided images and return them in clean HTML table format. If no tables are found, return an empty table."  # noqa: E501


def constant(**fields) -> Column:
    return F.struct(*(F.lit(v).alias(k) for k, v in fields.items()))


def strings(*values: str) -> Column:
    return F.array(*map(F.lit, values))


def vision_request(model: Column, pages: Column, prompt: Column | None = None) -> Column:
    """A chat with the system's role, the prompt and one image for each of pages (base 64 of JPEGs), at temperature 0."""
    text = F.coalesce(prompt, F.lit(TABLE_PROMPT)) if prompt is not None else F.lit(TABLE_PROMPT)
    entry = lambda kind, x, url: F.struct(F.lit(kind).alias("type"), x.alias("text"), F.when(url.isNotNull(), F.struct(url.alias("url"))).alias("image_url"))
    none = F.lit(None).cast("string")
    content = F.concat(F.array(entry("text", text, none)), F.transform(pages, lambda p: entry("image_url", none, F.concat(F.lit("data:image/jpeg;base64,"), p))))
    system = F.to_json(constant(role="system", content=SYSTEM_PROMPT))
    user = F.to_json(F.struct(F.lit("user").alias("role"), content.alias("content")))
    return F.concat(F.lit('{"model":'), F.to_json(F.array(model)).substr(F.lit(2), F.length(F.to_json(F.array(model))) - 2), F.lit(',"messages":['), system, F.lit(","), user, F.lit('],"temperature":0.0}'))


def request(family: str, path: Column, content: Column, model: Column, prompt: Column | None = None) -> Column:
    """What a service of the family is asked for the image at path."""
    if family == "vision":
        return vision_request(model, F.array(encoded(content)), prompt)
    fields = {
        "layout": F.struct(F.lit("prebuilt-layout").alias("model")),
        "forms": F.struct(strings("TABLES").alias("features")),
        "markdown": F.struct(model.alias("model"), F.struct(F.lit("image_url").alias("type"), data_uri(F.lit(".jpg"), content).alias("image_url")).alias("document"), F.lit(False).alias("include_image_base64")),
        "math": F.struct(
            strings("text", "data", "html").alias("formats"), constant(include_tsv=True, include_table_html=True, include_latex=True).alias("data_options"),
            strings("$", "$").alias("math_inline_delimiters"), F.lit(True).alias("rm_spaces"),
        ),
        "elements": F.struct(F.regexp_extract(path, "[^/]*$", 0).alias("file_name"), F.lit("hi_res").alias("strategy")),
        "pages": F.struct(F.lit("All").alias("ocr_strategy"), F.lit("Page").alias("segmentation_strategy"), F.struct(constant(strategy="LLM", format="Html").alias("page")).alias("segment_processing")),
    }
    return F.to_json(fields[family])


def polled(start: Callable[[], dict], refresh: Callable[[dict], dict], sleep: Callable[[float], None] = time.sleep, every: float = 1.0) -> dict:
    """The state of a task once it is completed."""
    state = start()
    while not state.get("completed"):
        sleep(every)
        state = refresh(state)
    return state


def region(*candidates: str | None) -> str:
    """The first region that is given."""
    return next((c for c in candidates if c), "us-east-1")


class Call:
    """One request, as an extractor. With refresh, what send returns is the state of a task that is polled until it is completed."""

    def __init__(self, send: Callable[[str, bytes], str], body: str, refresh: Callable[[dict], dict] | None = None, every: float = 1.0):
        self.send, self.body, self.refresh, self.every = send, body, refresh, every

    def extract(self, image: bytes, path: str) -> str | None:
        answer = self.send(self.body, image)
        return answer if self.refresh is None else json.dumps(polled(lambda: json.loads(answer), self.refresh, every=self.every))


def called(samples: DataFrame, family: str, model: str, send: Callable[[str, bytes], str], prompt: str | None = None, refresh: Callable[[dict], dict] | None = None, every: float = 1.0, ledger: str | None = None) -> DataFrame:  # noqa: E501
    """samples (image_path, content, ...) with family, model, pred_html, error and processing_time; refresh asks for the
    state of a task anew, every so many seconds. Slots and ledger are those of attempts()."""
    policy, slots = POLICIES[family]
    asked = samples.withColumn("request", request(family, F.col("image_path"), F.col("content"), F.lit(model), F.lit(prompt) if prompt else None))
    kept = [c for c in samples.columns if c != "content"]
    schema = ", ".join(f"`{c}` {t}" for c, t in samples.dtypes if c != "content") + ", payload string, error string, processing_time double"

    book = Ledger(ledger) if ledger else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            one = lambda body, c, p: noted(book, f"{family}/{model}\n{p}", lambda: call(lambda: Call(send, body, refresh, every), c, p, policy))
            found = [one(*x) for x in zip(b["request"], b["content"], b["image_path"], strict=True)]
            yield b[kept].assign(payload=[f[0] for f in found], error=[f[1] for f in found], processing_time=[f[2] for f in found])

    out = asked.coalesce(slots).mapInPandas(run, schema)
    return out.select(*kept, F.lit(family).alias("family"), F.lit(model).alias("model"), payload_to_html(F.lit(family), F.col("payload")).alias("pred_html"), "error", "processing_time")


__all__ = ["Fatal", "called", "polled", "region", "request", "vision_request"]
