import json

import pytest
from pyspark.sql import functions as F

from tablescore.operators import requests as Q
from tablescore.operators import runs as R
from tablescore.operators.converters import TABLE_PROMPT


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([("/x/a b.png", bytearray(b"\x00\xff"), "a"), ("/x/c.jpg", bytearray(b"no"), "c")], "image_path string, content binary, stem string")


def asked(samples, family, prompt=None):
    return json.loads(samples.select(Q.request(family, F.col("image_path"), F.col("content"), F.lit('m"1'), prompt)).first()[0])


def test_requests(samples):
    assert asked(samples, "layout") == {"model": "prebuilt-layout"}
    assert asked(samples, "forms") == {"features": ["TABLES"]}
    assert asked(samples, "markdown") == {"model": 'm"1', "document": {"type": "image_url", "image_url": "data:image/jpeg;base64,AP8="}, "include_image_base64": False}
    assert asked(samples, "math")["math_inline_delimiters"] == ["$", "$"] and asked(samples, "math")["data_options"]["include_tsv"]
    assert asked(samples, "elements") == {"file_name": "a b.png", "strategy": "hi_res"}
    assert asked(samples, "pages")["segment_processing"] == {"page": {"strategy": "LLM", "format": "Html"}}


def test_chat(samples):
    chat = asked(samples, "vision")
    assert (chat["model"], chat["temperature"], [m["role"] for m in chat["messages"]]) == ('m"1', 0.0, ["system", "user"])
    assert chat["messages"][1]["content"] == [{"type": "text", "text": TABLE_PROMPT}, {"type": "image_url", "image_url": {"url": "data:image/jpeg;base64,AP8="}}]
    assert asked(samples, "vision", F.lit("find"))["messages"][1]["content"][0]["text"] == "find"


def test_called(samples):
    def send(body, image):
        if bytes(image) == b"no":
            raise Q.Fatal("refused")
        return json.dumps({"pages": [{"markdown": f"|{json.loads(body)['model']}|"}]})

    rows = {r.stem: r for r in Q.called(samples, "markdown", "m", send).collect()}
    assert rows["a"].pred_html == "<table><tr><td>m</td></tr></table>" and rows["a"].error is None
    assert (rows["c"].pred_html, rows["c"].error) == (None, "refused")
    truth = Q.called(samples, "markdown", "m", send).withColumns({"ground_truth_path": F.lit("g"), "gt_html": F.lit("<table><tr><td>m</td></tr></table>")})
    assert sorted(r.success for r in R.records(truth).collect()) == [False, True]


def test_polling_and_region():
    slept = []
    states = iter([{"completed": False}, {"completed": True, "status": "Succeeded"}])
    assert Q.polled(lambda: {"completed": False}, lambda s: next(states), slept.append)["status"] == "Succeeded" and slept == [1.0, 1.0]
    assert (Q.region(None, "", "eu-west-1"), Q.region(None)) == ("eu-west-1", "us-east-1")
