import json
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescore.functions.text import SPACES
from tablescore.operators import converters as X

ONE = "<table><tr><td>{}</td></tr></table>"


def convert(spark, f, x, kind="string"):
    return spark.createDataFrame([(x,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("f", "x", "expected"),
    [
        (X.latex_math_to_html, "x^2 + y_{i}", "x<sup>2</sup> + y<sub>i</sub>"),
        (X.latex_math_to_html, "x^{ab}_é", "x<sup>ab</sup><sub>é</sub>"),
        (X.latex_table_to_html, r"\begin{tabular}{cc} A & B \\ 1 & 2 \end{tabular}", "<table>\n</table>"),
        (X.latex_table_to_html, "\\begin{tabular}{c}\n A & B \\\\\n\\hline\n1&2\\\\\n\\end{tabular}", "<table>\n<tr>\n<td>A</td>\n<td>B</td>\n</tr>\n<tr>\n<td>1</td>\n<td>2</td>\n</tr>\n</table>"),
        (X.markdown_to_html, "| Header 1 | Header 2 |\n| Value 1 | Value 2 |", "<table><tr><td>Header 1</td><td>Header 2</td></tr><tr><td>Value 1</td><td>Value 2</td></tr></table>"),
        (X.markdown_to_html, "|a|b|\n|---|---|\n| | |", "<table><tr><td>a</td><td>b</td></tr><tr><td>---</td><td>---</td></tr></table>"),
        (X.markdown_to_html, "|売上|b|\n|売上|c|", "<table><tr><th>売上</th><td>b</td></tr><tr><td>売上</td><td>c</td></tr></table>"),
        (X.markdown_to_html, "", X.EMPTY),
        (X.markdown_to_html, None, X.EMPTY),
        (X.markdown_to_html, "|", ONE.format("|")),
        (X.text_to_html, "Product A  $10.99  In Stock\nProduct B  $15.49  Out of Stock", "<table><tr><td>Product A</td><td>$10.99</td><td>In Stock</td></tr><tr><td>Product B</td><td>$15.49</td><td>Out of Stock</td></tr></table>"),
        (X.text_to_html, "two words", ONE.format("two words")),
        (X.text_to_html, "5%\nskip this\na b c", "<table><tr><td>5%</td></tr><tr><td>a</td><td>b</td><td>c</td></tr></table>"),
        (X.text_to_html, "a\tb c\t d%", "<table><tr><td>a</td><td>b c</td><td>d%</td></tr></table>"),
        (X.text_to_html, "増加 業 x", "<table><tr><th>増加</th><td>業</td><td>x</td></tr></table>"),
        (X.without_fences, "```html\n<table></table>\n```", "\n<table></table>\n"),
        (X.without_fences, "plain", "plain"),
    ],
)
def test_text(spark, f, x, expected):
    assert convert(spark, f, x) == expected


@pytest.mark.parametrize(
    ("family", "payload", "expected"),
    [
        ("layout", [], X.EMPTY),
        ("layout", [{"row_count": 1, "column_count": 2, "cells": [{"row_index": 0, "column_index": 0, "content": "a", "kind": "columnHeader"}]}], "<table><tr><th>a</th><td></td></tr></table>"),
        ("layout", [{"row_count": 2, "column_count": 2, "cells": [{"row_index": 0, "column_index": 0, "row_span": 9, "column_span": 0, "content": "a"}, {"row_index": 5, "column_index": 0, "content": "no"}, {"row_index": 1, "column_index": 1}]}], '<table><tr><td rowspan="9">a</td><td></td></tr><tr><td></td></tr></table>'),
        ("layout", [{"row_count": 1, "column_count": 2, "cells": [{"row_index": 0, "column_index": 1, "content": "b"}, {"row_index": 0, "column_index": 0, "column_span": 2, "content": "a"}]}], '<table><tr><td colspan="2">a</td></tr></table>'),
        ("layout", [{"row_count": 1, "column_count": 2, "cells": [{"row_index": 0, "column_index": 0, "column_span": 2, "content": "a"}, {"row_index": 0, "column_index": 1, "content": "b"}]}], '<table><tr><td colspan="2">a</td><td>b</td></tr></table>'),
        ("layout", [{"row_count": 0, "column_count": 0, "cells": []}, {"row_count": 1, "column_count": 1}], "<table></table>\n<table><tr><td></td></tr></table>"),
        ("forms", [{"html": "<table>1</table>"}, {"confidence": 0.5}], "<table>1</table>\n<table></table>"),
        ("forms", [], X.EMPTY),
        ("markdown", {"pages": [{"markdown": ""}, {"markdown": "|a|"}]}, ONE.format("a")),
        ("markdown", {"pages": [{"markdown": ""}]}, X.EMPTY),
        ("markdown", {"text": "", "content": "x y", "output": "z"}, ONE.format("x y")),
        ("markdown", {}, X.EMPTY),
        ("math", {"data": [{"type": "html", "value": ""}, {"type": "html", "value": '<p><table class="k"><tr><td>1<latex style="display: none">x</latex><latex>y</latex></td></tr></table></p>'}]}, '<table class="k"><tr><td>1<latex>y</latex></td></tr></table>'),
        ("math", {"html": "no table"}, X.EMPTY),
        ("math", {}, X.EMPTY),
        ("elements", [{"type": "Table", "text": "t", "metadata": {"text_as_html": "<table>h</table>"}}, {"type": "Table", "text": "t"}, {"type": "Table"}, {"type": "Title", "text": "a|b\nc"}], "<table>h</table>\n" + ONE.format("t")),
        ("elements", [{"type": "Header", "text": "a\tb\n\nc"}, {"type": "Header", "text": "a|b"}], "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>"),
        ("elements", [], X.EMPTY),
        ("pages", {"status": "Succeeded", "chunks": [{"content": "a"}, {}, {"content": "b"}]}, "ab"),
        ("pages", {"status": "Failed", "message": "m"}, None),
    ],
)
def test_payload(spark, family, payload, expected):
    row = spark.createDataFrame([(family, json.dumps(payload, ensure_ascii=False))], "f string, p string")
    assert row.select(X.payload_to_html(F.col("f"), F.col("p"))).first()[0] == expected


def painted(t):
    """A layout by painting its cells one after the other."""
    rows, columns = t["row_count"], t["column_count"]
    at = [[None] * columns for _ in range(rows)]
    for k, c in enumerate(t["cells"]):
        if not (0 <= c["row_index"] < rows and 0 <= c["column_index"] < columns):
            continue
        down, across = c["row_span"] or 1, c["column_span"] or 1
        at[c["row_index"]][c["column_index"]] = k
        if down > 0 and across > 0:
            for r in range(c["row_index"], min(c["row_index"] + down, rows)):
                at[r][c["column_index"] : c["column_index"] + across] = [k] * (min(c["column_index"] + across, columns) - c["column_index"])
    out = []
    for r in range(rows):
        line = ""
        for x in range(columns):
            c = t["cells"][at[r][x]] if at[r][x] is not None else None
            if c is None:
                line += "<td></td>"
            elif (c["row_index"], c["column_index"]) == (r, x):
                tag = "th" if c["kind"] in X.HEADER_KINDS else "td"
                more = "".join(f' {name}="{c[n]}"' for name, n in (("rowspan", "row_span"), ("colspan", "column_span")) if c[n] and c[n] > 1)
                line += f"<{tag}{more}>{c['content'] or ''}</{tag}>"
        out.append(f"<tr>{line}</tr>")
    return f"<table>{''.join(out)}</table>"


@pytest.mark.parametrize("overlap", [X.OVERLAP, 1, -1])
def test_layout_equals_painting(spark, monkeypatch, overlap):
    monkeypatch.setattr(X, "OVERLAP", overlap)
    monkeypatch.setattr(X, "FEW_POSITIONS", -1)
    r = random.Random(4)

    def table():
        rows, columns = r.randint(0, 6), r.randint(0, 6)
        some = lambda n: r.choice([None, -1, 0, 1, 1, 1, 2, 3, 50])
        cell = lambda: {"row_index": r.randint(-1, rows), "column_index": r.randint(-1, columns), "row_span": some(rows), "column_span": some(columns), "content": r.choice([None, "a", "b<i>c</i>"]), "kind": r.choice([None, "content", "rowHeader"])}
        return {"row_count": rows, "column_count": columns, "cells": [cell() for _ in range(r.randint(0, 12))]}

    tables = [(k, [table()]) for k in range(200)]
    df = spark.createDataFrame(tables, T.StructType([T.StructField("k", T.IntegerType()), T.StructField("t", X.LAYOUT)]))
    got = {x.k: x.html for x in df.select("k", X.layout_to_html(F.col("t")).alias("html")).collect()}
    assert got == {k: painted(t) for k, (t,) in tables}


def test_large_layouts_are_quick(spark):
    """1,000 x 50 cells, and 2,000 cells that each span all of 200 x 50."""
    n = F.sequence(F.lit(0), F.lit(49_999))
    cell = lambda r, c, span, k: F.struct(r.cast("int").alias("row_index"), c.cast("int").alias("column_index"), F.lit(span).alias("row_span"), F.lit(span).alias("column_span"), k.cast("string").alias("content"), F.lit("content").alias("kind"))
    wide = F.struct(F.lit(1000).alias("row_count"), F.lit(50).alias("column_count"), F.transform(n, lambda k: cell(F.floor(k / 50), k % 50, 1, k)).alias("cells"))
    deep = F.struct(F.lit(200).alias("row_count"), F.lit(50).alias("column_count"), F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda k: cell(F.lit(0), F.lit(0), 500, k)).alias("cells"))
    spark.range(1).select(X.layout_to_html(F.array(deep))).collect()
    began = time.perf_counter()
    html = spark.range(1).select(X.layout_to_html(F.array(wide))).first()[0]
    assert time.perf_counter() - began < 10
    assert html == "<table>" + "".join("<tr>" + "".join(f"<td>{50 * r + c}</td>" for c in range(50)) + "</tr>" for r in range(1000)) + "</table>"


def test_unknown_family(spark):
    assert spark.createDataFrame([("x", "y")], "f string, p string").select(X.payload_to_html(F.col("f"), F.col("p"))).first()[0] is None


def test_white_space():
    assert sorted(SPACES) == [c for c in map(chr, range(0x110000)) if c.isspace()]


def test_blank_label(spark):
    from tablescore.functions.text import blank_label

    for x, blank in ((None, True), ("", True), (" |x", True), ("a|", False), ("\u00a0|b|c", True), ("td", False)):
        assert convert(spark, blank_label, x) is blank
