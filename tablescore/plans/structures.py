"""Registered queries of long cells, trees of other shapes, tables as rows, and reports over many keys at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.converters import in_one_cell
from ..operators.rows import register, table_rows
from ..operators.scoring import tree_similarity
from . import report
from .fixtures import order_tables, plain_html, run_log, table
from .queries import ROWS, query, six

#: DuckDB's levenshtein counts bytes, so characters beyond ASCII stand in as ASCII ones that no text has.
ONE_BYTE = """
with c as (select distinct unnest(string_split(text, '')) as c from documents),
f as (select string_agg(c, '' order by c) as many, count(*) as n from c where unicode(c) > 127),
g as (select string_agg(chr(k::int), '' order by k) as one from (select k from range(1, 127) as t(k) where chr(k::int) not in (select c from c) order by k limit (select n from f))),
d as (select doc_id, coalesce(translate(text, many, one), '') as x from documents, f, g)"""


@query(ONE_BYTE + """
select a.doc_id, round(1 - levenshtein(a.x, b.x)::double / greatest(length(a.x), length(b.x), 1) / 2, 6) as teds from d a join d b on b.doc_id = a.doc_id + 1""")
def t4_text_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as cells: each against the one with the next id."""
    html = in_one_cell(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")))
    d = table(spark, sf_dir, "documents").select("doc_id", html.alias("a"))
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return d.join(after, "doc_id").select("doc_id", six(tree_similarity("a", "b")).alias("teds"))


@query(ROWS + """,
k as (select l_orderkey, count(*)::double as r from l group by l_orderkey)
select l_orderkey, change, round(case change when 'same' then 1 when 'caption dropped' then 1 - 1 / (5 * r + 1) when 'columns described' then 1 - 5 / (5 * r + 6) when 'inner table' then 1 - 2 / (5 * r + 3)
  else 1 - (case when r > 1 then 5 else 0 end) / (5 * r + 1) end, 6) as teds
from k, (select unnest(['same', 'caption dropped', 'columns described', 'inner table', 'last row dropped']) as change)""")
def t4_other_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with a caption, a group of columns, or a table in a row between the others: of distances in closed form."""
    caption = lambda x: F.concat(F.lit("<table><caption>c</caption>"), x, F.lit("</table>"))
    rows = lambda g: F.regexp_replace(plain_html(g), "</?table>", "")
    all_, most = rows(F.col("grid")), rows(F.slice("grid", 1, F.greatest(F.size("grid") - 1, F.lit(1))))
    columns = F.lit("<colgroup>" + "<col></col>" * 4 + "</colgroup>")
    inner = F.lit("<tr><table></table></tr>")
    changes = {"same": caption(all_), "caption dropped": plain_html(F.col("grid")), "columns described": caption(F.concat(columns, all_)), "inner table": caption(F.concat(inner, all_)), "last row dropped": caption(most)}
    each = F.inline(F.array(*(F.struct(F.lit(k).alias("change"), v.alias("html")) for k, v in changes.items())))
    o = order_tables(spark, sf_dir).select("l_orderkey", caption(all_).alias("truth"), each)
    return o.select("l_orderkey", "change", six(tree_similarity("truth", "html")).alias("teds"))


@query(ROWS + """,
w as (select l_orderkey, 0 as top, a || ',' || b || ',' || c || ',' || d as cells, i from l union all select l_orderkey, 1, 'k,k,' || count(*) || ',', 0 from l group by l_orderkey)
select l_orderkey, (row_number() over (partition by l_orderkey order by i) - 1)::int as row_index, cells from w""")
def g1_lateral_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of each order's table, below a row with a span, by a lateral join with the table function."""
    head = F.concat(F.lit('<table><tr><td colspan="2">k</td><td>'), F.size("grid").cast("string"), F.lit("</td></tr></table>"))
    o = order_tables(spark, sf_dir).select("l_orderkey", F.concat(head, plain_html(F.col("grid"))).alias("html"))
    return table_rows(o, "html").select("l_orderkey", "row_index", F.array_join("cells", ",").alias("cells"))


@query(ROWS + " select l_linenumber, count(*) as rows, count(distinct cells) as kinds from (select l_orderkey, i - 1 as l_linenumber, b || c || d as cells from l) group by l_linenumber")
def g1_rows_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table function in SQL: how many rows stand at each place, and how many different ones."""
    register(spark)
    o = order_tables(spark, sf_dir).select("l_orderkey", plain_html(F.col("grid")).alias("html"))
    return spark.sql("select r.row_index as l_linenumber, count(*) as rows, count(distinct concat(r.cells[1], r.cells[2], r.cells[3])) as kinds from {o} as o, lateral table_rows(o.html) as r group by r.row_index", o=o)


@query("""
with r as (
  select 'm' || (user_id % 5) as model, source as domain, lang as language, case when n_chars is null then 'none' when n_chars < 500 then 'short' when n_chars < 2500 then 'medium' else 'long' end as size, event_type <> 'error' as success,
         case event_type when 'error' then null when 'signup' then 0 else (event_id % 101) / 100.0::double end as levenshtein, case event_type when 'error' then null when 'signup' then 0 else (event_id % 53) / 52.0::double end as teds
  from events left join documents on doc_id = event_id % 1000)
select model, domain, language, size, grouping(model, domain, language, size)::bigint as level, count(*) as runs, round(avg(success::int), 6) as success_rate, round(avg(levenshtein), 6) as levenshtein, round(avg(teds), 6) as teds
from r group by cube(model, domain, language, size)""")
def a12_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaderboard, stability and make-up of the sample by model, domain, language and size class, and by all subsets of them, in one pass."""
    size = F.when(F.col("n_chars").isNull(), "none").when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 2500, "medium").otherwise("long")
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("domain"), F.col("lang").alias("language"), "n_chars")
    runs = run_log(spark, sf_dir).withColumn("doc_id", F.pmod("event_id", F.lit(1000))).join(d, "doc_id", "left").withColumn("size", size)
    found = report.breakdown(runs, ("model", "domain", "language", "size"))
    return found.select("model", "domain", "language", "size", "level", "runs", *(six(F.col(c)).alias(c) for c in ("success_rate", "levenshtein", "teds")))
