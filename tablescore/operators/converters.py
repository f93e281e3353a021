"""Payloads of extraction services to HTML tables, as native column expressions.

Each function takes columns of the payload's fields and returns the HTML; nothing is escaped, as the
payloads hold markup of their own. What has no table is an empty one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dom import parse
from ..functions.text import SPACE, let, lines, strip, tokens, truthy

EMPTY = "<table></table>"

#: Words that mark a header row or tabular text.
HEADER_WORDS = ("売上", "増加", "減少", "不変")
MARKDOWN_HEADER_WORDS = ("売上", "増加", "減少", "不変", "業")
TABULAR_WORDS = ("%", "増加", "減少", "不変", "業", "売上")
TEXT_ELEMENTS = ("Header", "NarrativeText", "ListItem")
HEADER_KINDS = ("columnHeader", "rowHeader")
#: Fixed value: the instruction for models that see the page.
TABLE_PROMPT = "OCR the table and convert it to HTML. Use simple HTML tags, and specify colspan and rowspan where it is greater than 1. No additional styling required. Use simple HTML tags for formulas. The output should begin with <table> and end with </table>. Output your content in ```html ``` tags."  # noqa: E501

CELL = T.StructType([
    T.StructField("row_index", T.IntegerType()), T.StructField("column_index", T.IntegerType()), T.StructField("row_span", T.IntegerType()),
    T.StructField("column_span", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("kind", T.StringType()),
])
LAYOUT = T.ArrayType(T.StructType([T.StructField("row_count", T.IntegerType()), T.StructField("column_count", T.IntegerType()), T.StructField("cells", T.ArrayType(CELL))]))
FORMS = T.ArrayType(T.StructType([T.StructField("html", T.StringType()), T.StructField("confidence", T.DoubleType())]))
PAGES = T.StructType([T.StructField("pages", T.ArrayType(T.StructType([T.StructField("markdown", T.StringType())]))), *(T.StructField(n, T.StringType()) for n in ("text", "content", "result", "output"))])
MATH = T.StructType([T.StructField("data", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType())]))), T.StructField("html", T.StringType()), T.StructField("confidence", T.DoubleType())])
ELEMENTS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("metadata", T.StructType([T.StructField("text_as_html", T.StringType())]))]))
CHUNKS = T.StructType([T.StructField("status", T.StringType()), T.StructField("message", T.StringType()), T.StructField("chunks", T.ArrayType(T.StructType([T.StructField("content", T.StringType())])))])


def any_of(x: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | x.contains(w)
    return out


def tagged(tag: Column, x: Column) -> Column:
    return F.concat(F.lit("<"), tag, F.lit(">"), x, F.lit("</"), tag, F.lit(">"))


def table_of(rows: Column) -> Column:
    """HTML of an array of row contents."""
    return F.concat(F.lit("<table>"), F.array_join(F.transform(rows, lambda r: F.concat(F.lit("<tr>"), r, F.lit("</tr>"))), ""), F.lit("</table>"))


#: A stripped line of three parts or more between white space.
THREE_TOKENS = rf"(?U){SPACE}[^\s\x1c-\x1f]++{SPACE}"


def in_one_cell(x: Column) -> Column:
    return F.concat(F.lit("<table><tr><td>"), x, F.lit("</td></tr></table>"))


def sequence(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


#: Positions that cells cover, for each position of the table, beyond which they are not listed.
OVERLAP = 16
#: Positions of a table up to which each seeks its cell.
FEW_POSITIONS = 64


def layout_table(table: Column) -> Column:
    """A table of positioned cells. The last cell to touch a position has it: in its own place it shows, elsewhere it
    covers. Cells out of range are dropped, coverage ends at the border, span attributes keep their full value.

    Every position and every position that a cell covers become a number, position before ordinal of the cell; in
    sorted order the last number of a position names its cell. In small tables, and where cells lie over each other so
    much that this would be many times the table, each position seeks its cell among those of its row instead.
    """
    rows, columns = table["row_count"], table["column_count"]
    whole = lambda x: F.coalesce(F.nullif(x, F.lit(0)), F.lit(1))
    cells = F.transform(
        F.coalesce(table["cells"], F.array().cast(T.ArrayType(CELL))),
        lambda c: F.struct(c["row_index"].alias("r"), c["column_index"].alias("c"), whole(c["row_span"]).alias("down"), whole(c["column_span"]).alias("across"), F.coalesce(c["content"], F.lit("")).alias("content"), c["kind"].alias("kind")),
    )
    cells = F.filter(cells, lambda x: x["r"].between(0, rows - 1) & x["c"].between(0, columns - 1))
    covers = lambda x: (x["down"] > 0) & (x["across"] > 0)
    cells = F.transform(
        cells,
        lambda x: F.struct(
            *(x[n].alias(n) for n in ("r", "c", "down", "across", "content", "kind")),
            F.when(covers(x), F.least(x["down"], rows - x["r"])).otherwise(1).alias("height"), F.when(covers(x), F.least(x["across"], columns - x["c"])).otherwise(1).alias("width"),
        ),
    )
    number = lambda r, c, k: F.shiftleft(r.cast("long") * columns + c, 32) + k

    def covered(x: Column, k: Column) -> Column:
        """The positions of one cell, with its ordinal."""
        one = F.array(number(x["r"], x["c"], k + 1))
        return F.when((x["height"] == 1) & (x["width"] == 1), one).otherwise(
            F.flatten(F.transform(sequence(x["height"]), lambda i: F.transform(sequence(x["width"]), lambda j: number(x["r"] + i, x["c"] + j, k + 1))))
        )

    def swept(own: Column) -> Column:
        """The HTML of each row."""
        every = F.flatten(F.transform(sequence(rows), lambda r: F.transform(sequence(columns), lambda c: number(r, c, F.lit(0)))))
        return let(F.array_sort(F.concat(every, F.flatten(F.transform(own, covered)))), lambda all_: let(last_of(all_), lambda last: F.transform(sequence(rows), lambda r: in_row(own, last, r))))

    def last_of(numbers: Column) -> Column:
        place = lambda x: F.shiftright(x, 32)
        return F.filter(numbers, lambda x, i: F.coalesce(place(F.get(numbers, i + 1)) != place(x), F.lit(True)))

    def in_row(own: Column, last: Column, r: Column) -> Column:
        ordinal = lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
        return F.array_join(F.transform(F.slice(last, r * columns + 1, columns), lambda x, c: let(F.get(own, ordinal(x) - 1), lambda cell: markup(cell, r, c))), "")

    def sought(own: Column) -> Column:
        """The same row by row, without a list of what is covered."""

        def shown(near: Column, r: Column, c: Column) -> Column:
            touching = F.filter(near, lambda x: c.between(x["c"], x["c"] + x["width"] - 1))
            return let(F.try_element_at(touching, F.lit(-1)), lambda last: markup(last, r, c))

        near = lambda r: F.filter(own, lambda x: r.between(x["r"], x["r"] + x["height"] - 1))
        return F.transform(sequence(rows), lambda r: let(near(r), lambda some: F.array_join(F.transform(sequence(columns), lambda c: shown(some, r, c)), "")))

    def markup(last: Column, r: Column, c: Column) -> Column:
        tag = F.when(F.coalesce(last["kind"].isin(*HEADER_KINDS), F.lit(False)), "th").otherwise("td")
        attribute = lambda name, n: F.when(n > 1, F.concat(F.lit(f' {name}="'), n.cast("string"), F.lit('"'))).otherwise("")
        cell = F.concat(F.lit("<"), tag, attribute("rowspan", last["down"]), attribute("colspan", last["across"]), F.lit(">"), last["content"], F.lit("</"), tag, F.lit(">"))
        return F.when(last.isNull(), "<td></td>").when((last["r"] == r) & (last["c"] == c), cell).otherwise("")

    def of(own: Column) -> Column:
        area = F.aggregate(own, F.lit(0).cast("long"), lambda n, x: n + x["height"].cast("long") * x["width"])
        positions = rows.cast("long") * columns
        return F.when((positions > FEW_POSITIONS) & (area <= OVERLAP * positions), swept(own)).otherwise(sought(own))

    return let(cells, lambda own: table_of(of(own)))


def layout_to_html(tables: Column) -> Column:
    return F.coalesce(truthy(F.array_join(F.transform(tables, layout_table), "\n")), F.lit(EMPTY))


def forms_to_html(tables: Column) -> Column:
    """Tables that came as HTML; one that failed is an empty table."""
    return F.when(F.coalesce(F.size(tables), F.lit(0)) > 0, F.array_join(F.transform(tables, lambda t: F.coalesce(t["html"], F.lit(EMPTY))), "\n")).otherwise(EMPTY)


def text_to_html(text: Column) -> Column:
    """Lines that look tabular, cut at tabs, else at double spaces, else at white space; without any, all text in one cell."""
    kept = F.filter(F.transform(lines(text), strip), lambda x: (x != "") & (any_of(x, TABULAR_WORDS) | x.rlike(THREE_TOKENS)))

    def cells(x: Column) -> Column:
        wide = F.filter(F.transform(F.split(x, "  "), strip), lambda c: c != "")
        parts = F.when(x.contains("\t"), F.split(x, "\t")).when(x.contains("  "), wide).otherwise(tokens(x))
        return F.filter(F.transform(parts, strip), lambda c: c != "")

    def row(x: Column, i: Column) -> Column:
        return F.array_join(F.transform(cells(x), lambda c: tagged(F.when((i == 0) & any_of(c, HEADER_WORDS), "th").otherwise("td"), c)), "")

    return F.when(F.coalesce(text, F.lit("")) == "", EMPTY).otherwise(let(kept, lambda k: F.when(F.size(k) == 0, in_one_cell(text)).otherwise(table_of(F.transform(k, row)))))


def markdown_to_html(markdown: Column) -> Column:
    """Lines between pipes as rows, blank cells dropped, rules kept as rows; without any, as text."""
    piped = F.filter(F.transform(lines(markdown), strip), lambda x: x.startswith("|") & x.endswith("|"))
    rows = F.transform(piped, lambda x: F.filter(F.transform(F.split(F.substring(x, F.lit(2), F.greatest(F.length(x) - 2, F.lit(0))), r"\|"), strip), lambda c: c != ""))
    rows = F.filter(rows, lambda r: F.size(r) > 0)

    def row(r: Column, i: Column) -> Column:
        return F.array_join(F.transform(r, lambda c: tagged(F.when((i == 0) & any_of(c, MARKDOWN_HEADER_WORDS), "th").otherwise("td"), c)), "")

    return F.when(F.coalesce(markdown, F.lit("")) == "", EMPTY).otherwise(let(rows, lambda k: F.when(F.size(k) == 0, text_to_html(markdown)).otherwise(table_of(F.transform(k, row)))))


def pages_to_html(p: Column) -> Column:
    """The first page with markdown; without pages the first of the text fields that is not empty."""
    marked = F.try_element_at(F.filter(p["pages"], lambda x: truthy(x["markdown"]).isNotNull()), F.lit(1))["markdown"]
    text = F.coalesce(*(truthy(p[n]) for n in ("text", "content", "result", "output")))
    return F.when(F.coalesce(F.size(p["pages"]), F.lit(0)) > 0, F.coalesce(markdown_to_html(marked), F.lit(EMPTY))).otherwise(F.coalesce(text_to_html(text), F.lit(EMPTY)))


@F.pandas_udf(T.StringType())
def math_table(html: pd.Series) -> pd.Series:
    """The first table without the formula sources that are not displayed; without a table an empty one."""

    def one(x: str) -> str:
        table = next((n for n in parse(x, repair=False).walk() if n.tag == "table"), None)
        if table is None:
            return EMPTY
        table.dissolve(lambda n: False if n.tag == "latex" and "display: none" in n.attrs.get("style", "") else None)
        return table.markup()

    return html.map(one, na_action="ignore").astype(object)


def math_html(p: Column) -> Column:
    """The HTML that a formula service sent: the first such entry with a value, else the field of its own; null without."""
    entry = F.try_element_at(F.filter(p["data"], lambda d: (d["type"] == "html") & truthy(d["value"]).isNotNull()), F.lit(1))
    return F.coalesce(entry["value"], truthy(p["html"]))


def math_to_html(p: Column) -> Column:
    return F.coalesce(math_table(math_html(p)), F.lit(EMPTY))


def latex_math_to_html(x: Column) -> Column:
    """Superscripts, then subscripts; braced ones first."""
    for mark, tag in ((r"\^", "sup"), ("_", "sub")):
        x = F.regexp_replace(x, mark + r"\{([^}]+)\}", f"<{tag}>$1</{tag}>")
        x = F.regexp_replace(x, rf"(?U){mark}(\w)", f"<{tag}>$1</{tag}>")
    return x


def latex_table_to_html(x: Column) -> Column:
    """Lines with ampersands as rows, every piece of markup on a line of its own; lines that begin or end the table are passed over."""
    kept = F.filter(F.transform(lines(x), strip), lambda t: ~t.startswith("\\begin{tabular}") & ~t.startswith("\\end{tabular}") & t.contains("&"))
    cells = lambda t: F.transform(F.split(F.replace(t, F.lit("\\\\"), F.lit("")), "&"), lambda c: F.concat(F.lit("<td>"), strip(c), F.lit("</td>")))
    rows = F.flatten(F.transform(kept, lambda t: F.concat(F.array(F.lit("<tr>")), cells(t), F.array(F.lit("</tr>")))))
    return F.array_join(F.concat(F.array(F.lit("<table>")), rows, F.array(F.lit("</table>"))), "\n")


def without_fences(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("```html"), F.lit("")), F.lit("```"), F.lit(""))


def element_html(e: Column) -> Column:
    """HTML of one element of a page, null if it holds no table."""
    text = truthy(e["text"])
    table = F.coalesce(truthy(e["metadata"]["text_as_html"]), in_one_cell(text))

    def row(x: Column) -> Column:
        cells = F.filter(F.transform(F.split(F.replace(x, F.lit("\t"), F.lit("|")), r"\|"), strip), lambda c: c != "")
        return F.when(F.size(cells) > 1, F.array_join(F.transform(cells, lambda c: tagged(F.lit("td"), c)), "")).otherwise(tagged(F.lit("td"), strip(x)))

    split = F.split(text, "\n")
    tabular = any_of(F.lower(text), TABULAR_WORDS) | text.contains("\t") | text.contains("|")
    listed = F.when(tabular & (F.size(split) > 1), table_of(F.transform(F.filter(split, lambda x: strip(x) != ""), row)))
    return F.when(e["type"] == "Table", table).when(e["type"].isin(*TEXT_ELEMENTS), listed)


def elements_to_html(elements: Column) -> Column:
    found = F.filter(F.transform(elements, element_html), lambda x: x.isNotNull())
    return F.coalesce(truthy(F.array_join(found, "\n")), F.lit(EMPTY))


def chunks_to_html(p: Column) -> Column:
    """Contents of all chunks, one after the other; null unless the task succeeded."""
    joined = F.array_join(F.transform(p["chunks"], lambda c: F.coalesce(c["content"], F.lit(""))), "")
    return F.when(p["status"] == "Succeeded", F.coalesce(joined, F.lit("")))


#: What turns the payload of each family into HTML: the schema to read its JSON with (None: plain text), and the conversion.
FAMILIES = {
    "layout": (LAYOUT, layout_to_html),
    "forms": (FORMS, forms_to_html),
    "markdown": (PAGES, pages_to_html),
    "math": (MATH, math_to_html),
    "vision": (None, without_fences),
    "elements": (ELEMENTS, elements_to_html),
    "pages": (CHUNKS, chunks_to_html),
}


def payload_to_html(family: Column, payload: Column) -> Column:
    """HTML of a recorded payload, by its family; null for an unknown family or without payload."""
    out = F.lit(None).cast("string")
    for name, (schema, convert) in FAMILIES.items():
        own = F.when(family == name, payload)
        out = F.when(family == name, convert(own if schema is None else F.from_json(own, schema))).otherwise(out)
    return F.when(payload.isNotNull(), out)
