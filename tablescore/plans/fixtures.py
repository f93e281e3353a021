"""Tables of known scores, made of the orders in lineitem: the truth, and predictions with one kind of change each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.converters import table_of

#: Content that shares no character with any cell.
WRONG = "@@@@@@@@@@@@@@@@"
KINDS = ("same", "first row dropped", "last row dropped", "row added", "wrong cell", "decorated")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of lineitem is in the tables, dealt out by order: lists made before a shuffle are no fewer, and cost a sort and more bytes."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus").repartition("l_orderkey")


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, grid): line number, quantity, return flag and status of each order, as text."""
    line = dealt_lines(spark, sf_dir)
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.array(F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("string"), "l_returnflag", "l_linestatus").alias("cells"))
    return line.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["cells"]).alias("grid"))


def kind_of(key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod(key, F.lit(len(KINDS))) + 1).cast("int"))


def changed(grid: Column, kind: Column) -> Column:
    """The grid with its change; an only row is not dropped."""
    n = F.size(grid)
    wrong = F.transform(grid, lambda r, i: F.transform(r, lambda c, j: F.when((i == 0) & (j == 1), WRONG).otherwise(c)))
    return (
        F.when((kind == "first row dropped") & (n > 1), F.slice(grid, F.lit(2), n - 1))
        .when((kind == "last row dropped") & (n > 1), F.slice(grid, F.lit(1), n - 1))
        .when(kind == "row added", F.concat(grid, F.array(F.array(*[F.lit(WRONG)] * 4))))
        .when(kind == "wrong cell", wrong)
        .otherwise(grid)
    )


def plain_html(grid: Column) -> Column:
    return table_of(F.transform(grid, lambda r: F.concat(F.lit("<td>"), F.array_join(r, "</td><td>"), F.lit("</td>"))))


def decorated_html(grid: Column) -> Column:
    """The same table with sections, header cells, attributes, emphasis, math spans and elements that do not count."""
    head = F.array_join(F.transform(F.get(grid, F.lit(0)), lambda c: F.concat(F.lit('<th class="h" colspan="1"><b>'), c, F.lit('</b><span class="math-inline"> </span></th>'))), "")
    rest = F.transform(F.slice(grid, F.lit(2), F.greatest(F.size(grid) - 1, F.lit(0))), lambda r: F.concat(F.lit('<tr id="r">'), F.array_join(F.transform(r, lambda c: F.concat(F.lit('<td style="x" rowspan="1"><em><span class="math-inline">'), c, F.lit("</span></em><tsv>0</tsv></td>"))), ""), F.lit("</tr>")))
    return F.concat(F.lit('<table border="1"><thead><tr>'), head, F.lit("</tr></thead><tbody>"), F.array_join(rest, ""), F.lit("</tbody></table>"))


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, kind, gt, pred, gt_html, pred_html)."""
    p = order_tables(spark, sf_dir).withColumn("kind", kind_of(F.col("l_orderkey"))).withColumn("pred", changed(F.col("grid"), F.col("kind")))
    html = F.when(F.col("kind") == "decorated", decorated_html(F.col("pred"))).otherwise(plain_html(F.col("pred")))
    return p.select("l_orderkey", "kind", F.col("grid").alias("gt"), "pred", plain_html(F.col("grid")).alias("gt_html"), html.alias("pred_html"))


def html_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, kind, gt_html, pred_html) of scored_pairs(), made of rows that are texts from the start: without lambdas,
    which Spark does not compile."""
    between = "</td><td>"
    html = F.concat(F.lit("<tr><td>"), F.concat_ws(between, F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("string"), "l_returnflag", "l_linestatus"), F.lit("</td></tr>"))
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", html.alias("html"))
    o = dealt_lines(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    o = o.select("l_orderkey", kind_of(F.col("l_orderkey")).alias("kind"), F.col("rows.html").alias("rows"))

    n, first, rest = F.size("rows"), F.get("rows", F.lit(0)), F.array_join(F.slice("rows", F.lit(2), F.size("rows")), "")
    replaced = lambda x, *by: x if not by else replaced(F.replace(x, F.lit(by[0][0]), F.lit(by[0][1])), *by[1:])
    whole = lambda x: F.concat(F.lit("<table>"), x, F.lit("</table>"))
    every = F.array_join("rows", "")
    # The second cell of the first row, if there is one.
    wrong = F.regexp_replace(first, r"\A(<tr><td>[^<]*</td><td>)[^<]*", f"$1{WRONG}")
    head = replaced(first, ("<td>", '<th class="h" colspan="1"><b>'), ("</td>", '</b><span class="math-inline"> </span></th>'))
    body = replaced(rest, ("<tr>", '<tr id="r">'), ("<td>", '<td style="x" rowspan="1"><em><span class="math-inline">'), ("</td>", "</span></em><tsv>0</tsv></td>"))
    guess = (
        F.when((F.col("kind") == "first row dropped") & (n > 1), whole(rest))
        .when((F.col("kind") == "last row dropped") & (n > 1), whole(F.array_join(F.slice("rows", F.lit(1), n - 1), "")))
        .when(F.col("kind") == "row added", whole(F.concat(every, F.lit(f"<tr><td>{between.join([WRONG] * 4)}</td></tr>"))))
        .when(F.col("kind") == "wrong cell", whole(F.concat(wrong, rest)))
        .when(F.col("kind") == "decorated", F.concat(F.lit('<table border="1"><thead>'), head, F.lit("</thead><tbody>"), body, F.lit("</tbody></table>")))
        .otherwise(whole(every))
    )
    return o.select("l_orderkey", "kind", whole(every).alias("gt_html"), guess.alias("pred_html"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a run log: five models, errors as failures, sign-ups as empty answers."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.concat(F.lit("m"), F.pmod("user_id", F.lit(5)).cast("string")).alias("model"), F.col("value").alias("processing_time"), (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "empty").otherwise("ok").alias("status"),
        (F.pmod("event_id", F.lit(101)) / 100.0).alias("levenshtein"), (F.pmod("event_id", F.lit(53)) / 52.0).alias("teds"),
    )
