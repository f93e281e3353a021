"""Registered queries of the scoring engine, each over whole tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.align import cell_similarity, content_score, floor_score, row_alignment
from ..functions.text import collapse, normalised_cell, stem
from ..operators import converters as X
from ..operators.runs import POLICIES, records, registry, summary, validated, worst_wait
from ..operators.scoring import canonical_html, html_grid, row_alignment_score, score_tables, with_tree_score
from ..sources.files import encoded, paired, scaled_size
from . import report
from .fixtures import WRONG, decorated_html, html_pairs, order_tables, plain_html, run_log, scored_pairs, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def six(c: Column) -> Column:
    return F.round(c, 6)


ROWS = """
with l as (
  select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as i,
         l_linenumber::varchar as a, l_quantity::varchar as b, l_returnflag as c, l_linestatus as d
  from lineitem)"""
SIZES = ROWS + """,
k as (
  select l_orderkey, count(*)::double as r,
         ['same', 'first row dropped', 'last row dropped', 'row added', 'wrong cell', 'decorated'][(l_orderkey % 6 + 1)::int] as kind
  from l group by l_orderkey),
s as (
  select l_orderkey, kind,
         case when kind in ('first row dropped', 'last row dropped') and r > 1 then (r - 1) / r when kind = 'row added' then r / (r + 1) when kind = 'wrong cell' then 1 - 2 / (9 * r) else 1 end as levenshtein,
         case when kind in ('first row dropped', 'last row dropped') and r > 1 then (r - 1) / r when kind = 'row added' then r / (r + 1) when kind = 'wrong cell' then 1 - 1 / (5 * r) else 1 end as teds
  from k)"""
PLAIN = ROWS + """,
h as (
  select l_orderkey, '<table>' || string_agg('<tr><td>' || a || '</td><td>' || b || '</td><td>' || c || '</td><td>' || d || '</td></tr>', '' order by i) || '</table>' as html
  from l group by l_orderkey)"""


@query(SIZES + " select kind, count(*) as n, round(avg(levenshtein), 6) as levenshtein, round(avg(teds), 6) as teds from s group by kind")
def m1_score_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both metrics of every order table in HTML, by kind of change."""
    s = score_tables(scored_pairs(spark, sf_dir), metrics=("levenshtein", "teds"))
    return s.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), six(F.avg("scores.levenshtein")).alias("levenshtein"), six(F.avg("scores.teds")).alias("teds"))


@query(SIZES + " select l_orderkey, kind, round(levenshtein, 6) as levenshtein from s")
def l10_table_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content score of grids, without HTML: native from end to end."""
    p = scored_pairs(spark, sf_dir)
    return p.select("l_orderkey", "kind", six(content_score(F.col("gt"), F.col("pred"))).alias("levenshtein"))


@query(SIZES + " select l_orderkey, kind, round(teds, 6) as teds from s")
def t4_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = with_tree_score(html_pairs(spark, sf_dir))
    return p.select("l_orderkey", "kind", six(F.col("teds")).alias("teds"))


@query(ROWS + ", r as (select l_orderkey, count(*)::double as r from l group by l_orderkey) select l_orderkey, round(4 * 5 * least(r, 1) / 4 / (r * 9), 6) as levenshtein from r")
def l10_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a prediction of one wholly wrong row gets."""
    wrong = F.array(F.array(*[F.lit(WRONG)] * 4))
    o = order_tables(spark, sf_dir)
    return o.select("l_orderkey", six(F.greatest(content_score(F.col("grid"), wrong), floor_score(F.size("grid"), F.lit(1), F.lit(4)))).alias("levenshtein"))


@query("""
select p_partkey, round(case when p_name = p_type then 1.0 else -1 + 2 * (1 - levenshtein(p_name, p_type)::double / greatest(length(p_name), length(p_type))) end, 6) as similarity from part""")
def l1_cell_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", six(cell_similarity(F.col("p_name"), F.col("p_type"))).alias("similarity"))


@query("""
with recursive c as (select p_partkey as k, [p_brand, p_type, p_size::varchar, p_name] as x from part),
p as (select a.k, a.x as x, b.x as y from c a join c b on b.k = a.k + 1),
s(k, x, y, i, prev, best) as (
  select k, x, y, 0, [0.0::double, 0, 0, 0, 0], 0.0::double from p
  union all
  select k, x, y, i + 1, row, greatest(best, row[5]) from (
    select *, [0.0::double, r1, r2, r3, greatest(prev[4] + m[4], prev[5] - 1, r3 - 1)] as row from (
      select *, greatest(prev[3] + m[3], prev[4] - 1, r2 - 1) as r3 from (
        select *, greatest(prev[2] + m[2], prev[3] - 1, r1 - 1) as r2 from (
          select *, greatest(prev[1] + m[1], prev[2] - 1, -1.0) as r1 from (
            select *, list_transform(y, lambda v: case when v = x[i + 1] then 1.0::double else -1 + 2 * (1 - levenshtein(v, x[i + 1])::double / greatest(length(v), length(x[i + 1]))) end) as m from s where i < 4)))))
  )
select k as p_partkey, round(greatest(best, list_max(prev)), 6) as score from s where i = 4""")
def l5_row_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's cells against those of the part with the next key."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.array("p_brand", "p_type", F.col("p_size").cast("string"), "p_name").alias("x"))
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("x").alias("y"))
    return p.join(after, "p_partkey").select("p_partkey", six(row_alignment(F.col("x"), F.col("y"))).alias("score"))


@query(ROWS + ", r as (select l_orderkey, count(*)::double as r from l group by l_orderkey) select l_orderkey, 9 * r as best from r")
def l7_row_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row pairs of each order with itself, every distinct pair scored once, then aligned."""
    o = order_tables(spark, sf_dir)
    return row_alignment_score(o, ["l_orderkey"], "grid", "grid")


@query(r"select p_partkey, regexp_replace(p_name || ' -' || chr(9) || p_type || '-x ', '[\s-]+', '', 'g') as cell from part")
def l3_normalised_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", normalised_cell(F.concat("p_name", F.lit(" -\t"), "p_type", F.lit("-x "))).alias("cell"))


@query(PLAIN + " select l_orderkey, html from h")
def c_canonical_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decorated order tables in canonical form."""
    return order_tables(spark, sf_dir).select("l_orderkey", canonical_html(decorated_html(F.col("grid"))).alias("html"))


@query()
def c_canonical_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real pages, none of which has a table."""
    return table(spark, sf_dir, "pages").select("page_id", canonical_html("html").alias("html"))


@query(r"select doc_id, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) as text from documents")
def c12_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", collapse(F.col("text")).alias("text"))


@query(ROWS + ", r as (select l_orderkey, string_agg(l_orderkey || ',' || a || ',' || b || ',' || c || ',' || d, ';' order by i) as g, count(*) as n from l group by l_orderkey) select l_orderkey, g || ';note,,,,' as grid from r")
def g_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell that spans all rows, and a paragraph after the table, as a rectangle."""
    o = order_tables(spark, sf_dir)
    row = lambda r, i: F.concat(F.when(i == 0, F.concat(F.lit('<td rowspan="'), F.size("grid").cast("string"), F.lit('">'), F.col("l_orderkey").cast("string"), F.lit("</td>"))).otherwise(""), F.lit("<td>"), F.array_join(r, "</td><td>"), F.lit("</td>"))
    html = F.concat(X.table_of(F.transform("grid", row)), F.lit("<p>note</p>"))
    return o.select("l_orderkey", F.array_join(F.transform(html_grid(html), lambda r: F.array_join(r, ",")), ";").alias("grid"))


@query("select p.page_id, 'img/' || p.page_id || '.png' as image_path, 'gt/' || p.page_id || '.html' as ground_truth_path from pages p where p.page_id % 3 <> 0")
def s3_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image and ground-truth paths by file stem; every third page has no truth."""
    p = table(spark, sf_dir, "pages").select("page_id")
    images = p.select("page_id", F.concat(F.lit("img/"), F.col("page_id").cast("string"), F.lit(".png")).alias("image_path"))
    truths = p.where("page_id % 3 <> 0").select(F.concat(F.lit("gt/"), F.col("page_id").cast("string"), F.lit(".html")).alias("ground_truth_path"))
    return paired(images.withColumn("stem", stem(F.col("image_path"))), truths.withColumn("stem", stem(F.col("ground_truth_path")))).drop("stem")


@query("select page_id, to_base64(encode(html)) as content from pages")
def s7_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", encoded(F.encode("html", "utf-8")).alias("content"))


@query("""
with s as (select p_partkey, 100 + p_partkey % 7919 as w, 100 + p_size * 97 as h from part)
select p_partkey, (case when greatest(w, h) * 2 > 8000 then trunc(w * 2 * (8000.0::double / (greatest(w, h) * 2))) else w * 2 end)::int as width,
       (case when greatest(w, h) * 2 > 8000 then trunc(h * 2 * (8000.0::double / (greatest(w, h) * 2))) else h * 2 end)::int as height from s""")
def s9_image_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (100 + F.col("p_partkey") % 7919).alias("w"), (100 + F.col("p_size") * 97).alias("h"))
    return p.withColumn("s", scaled_size(F.col("w"), F.col("h"))).select("p_partkey", "s.width", "s.height")


@query("select * from (values ('vision', 5, 15.0::double), ('layout', 1, 3.0), ('math', 1, 3.0), ('markdown', 1, 3.0), ('forms', 1, 6.0), ('elements', 1, 524287.0), ('pages', 1, 3.0)) t(family, models, worst_wait)")
def s17_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families with their models and the longest time that they wait for all of them."""
    r = registry(spark).withColumn("w", worst_wait(F.col("attempts"), F.col("first_wait")))
    return r.groupBy("family").agg(F.count("model").alias("models"), F.sum("w").alias("worst_wait")).where(F.col("family").isin(*POLICIES))


def cells_of(spark: SparkSession, sf_dir: str, each: Callable[[Column], Column], between: str) -> DataFrame:
    return order_tables(spark, sf_dir).select("l_orderkey", "grid", F.array_join(F.transform("grid", each), between).alias("x"))


@query(PLAIN + " select l_orderkey, html from h")
def x4_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe rows between lines of prose."""
    o = cells_of(spark, sf_dir, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")), "\n")
    return o.select("l_orderkey", X.markdown_to_html(F.concat(F.lit("A table:\n"), "x", F.lit("\n\nend"))).alias("html"))


@query(r"""
with d as (select doc_id, text, list_filter(list_transform(string_split(trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13))), lambda l: l <> '' and (contains(l, '%') or len(list_filter(regexp_split_to_array(l, '\s+'), lambda t: t <> '')) > 2)) as k from documents)
select doc_id, case when coalesce(text, '') = '' then '<table></table>' when len(k) = 0 then '<table><tr><td>' || text || '</td></tr></table>'
  else '<table>' || array_to_string(list_transform(k, lambda l: '<tr>' || array_to_string(list_transform(list_filter(list_transform(case when contains(l, chr(9)) then string_split(l, chr(9)) when contains(l, '  ') then string_split(l, '  ') else regexp_split_to_array(l, '\s+') end, lambda c: trim(c, ' ' || chr(9) || chr(13))), lambda c: c <> ''), lambda c: '<td>' || c || '</td>'), '') || '</tr>'), '') || '</table>' end as html
from d""")
def x5_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as recognised text."""
    return table(spark, sf_dir, "documents").select("doc_id", X.text_to_html(F.col("text")).alias("html"))


@query("select p_partkey, 'x<sup>' || p_size || '</sup> + y<sub>' || p_brand || '</sub> + z<sup>2</sup> - w<sub>i</sub>' as html from part")
def x8_latex_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.concat(F.lit("x^{"), F.col("p_size").cast("string"), F.lit("} + y_{"), "p_brand", F.lit("} + z^2 - w_i"))
    return table(spark, sf_dir, "part").select("p_partkey", X.latex_math_to_html(x).alias("html"))


@query(ROWS + ", t as (select l_orderkey, string_agg(concat_ws(chr(10), '<tr>', '<td>' || a || '</td>', '<td>' || b || '</td>', '<td>' || c || '</td>', '<td>' || d || '</td>', '</tr>'), chr(10) order by i) as r from l group by l_orderkey) select l_orderkey, concat_ws(chr(10), '<table>', r, '</table>') as html from t")
def x9_latex_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = cells_of(spark, sf_dir, lambda r: F.concat(F.lit("  "), F.array_join(r, " & "), F.lit(" \\\\")), "\n")
    return o.select("l_orderkey", X.latex_table_to_html(F.concat(F.lit("\\begin{tabular}{cccc}\n"), "x", F.lit("\n\\end{tabular}"))).alias("html"))


@query(PLAIN + " select l_orderkey, chr(10) || html || chr(10) as html from h")
def x10_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = order_tables(spark, sf_dir)
    return o.select("l_orderkey", X.without_fences(F.concat(F.lit("```html\n"), plain_html(F.col("grid")), F.lit("\n```"))).alias("html"))


@query(PLAIN + " select l_orderkey, html from h")
def x1_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned cells, out of order, with one out of range and one that a later cell replaces."""
    cell = lambda r, c, x: F.struct(r.cast("int").alias("row_index"), c.cast("int").alias("column_index"), F.lit(1).alias("row_span"), F.lit(0).alias("column_span"), x.alias("content"), F.lit("content").alias("kind"))
    cells = F.flatten(F.transform("grid", lambda r, i: F.transform(r, lambda x, j: cell(i, j, x))))
    wrong = F.array(cell(F.lit(0), F.lit(0), F.lit(WRONG)), cell(F.lit(99), F.lit(0), F.lit(WRONG)))
    t = F.struct(F.size("grid").alias("row_count"), F.lit(4).alias("column_count"), F.concat(wrong, F.reverse(cells)).alias("cells"))
    return order_tables(spark, sf_dir).select("l_orderkey", X.layout_to_html(F.array(t)).alias("html"))


@query(PLAIN + " select l_orderkey, html || chr(10) || '<table></table>' as html from h")
def x2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables, of which the second failed."""
    t = lambda x: F.struct(x.alias("html"), F.lit(0.9).alias("confidence"))
    return order_tables(spark, sf_dir).select("l_orderkey", X.forms_to_html(F.array(t(plain_html(F.col("grid"))), t(F.lit(None).cast("string")))).alias("html"))


@query(PLAIN + " select l_orderkey, html from h")
def x3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded JSON in which the second page is the first with markdown."""
    o = cells_of(spark, sf_dir, lambda r: F.concat(F.lit("|"), F.array_join(r, "|"), F.lit("|")), "\n")
    page = lambda x: F.struct(x.alias("markdown"))
    recorded = F.to_json(F.struct(F.array(page(F.lit("")), page(F.col("x")), page(F.lit("| other |"))).alias("pages")))
    return o.select("l_orderkey", X.payload_to_html(F.lit("markdown"), recorded).alias("html"))


@query(PLAIN + " select l_orderkey, html from h")
def x7_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded JSON with an empty entry, and a formula source that is not displayed."""
    entry = lambda t, x: F.struct(F.lit(t).alias("type"), x.alias("value"))
    html = F.concat(F.lit("<div>"), F.replace(plain_html(F.col("grid")), F.lit("</table>"), F.lit('<latex style="display: none">x</latex></table>')), F.lit("</div>"))
    recorded = F.to_json(F.struct(F.array(entry("tsv", F.lit("1")), entry("html", F.lit("")), entry("html", html)).alias("data")))
    return order_tables(spark, sf_dir).select("l_orderkey", X.payload_to_html(F.lit("math"), recorded).alias("html"))


@query(PLAIN + " select l_orderkey, html || chr(10) || '<table><tr><td>only text</td></tr></table>' || chr(10) || '<table><tr><td>a</td><td>5%</td></tr><tr><td>b</td></tr></table>' as html from h")
def x11_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded JSON of page elements: a table, a table without markup, tabular prose and prose."""
    e = lambda t, x, h: F.struct(F.lit(t).alias("type"), F.lit(x).alias("text"), F.struct(h.alias("text_as_html")).alias("metadata"))
    none = F.lit(None).cast("string")
    recorded = F.to_json(F.array(e("Table", "t", plain_html(F.col("grid"))), e("Table", "only text", none), e("ListItem", "a | 5%\n\n b", none), e("NarrativeText", "one line", none)))
    return order_tables(spark, sf_dir).select("l_orderkey", X.payload_to_html(F.lit("elements"), recorded).alias("html"))


@query(PLAIN + " select l_orderkey, html || 'tail' as html from h")
def x13_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda x: F.struct(x.alias("content"))
    recorded = F.to_json(F.struct(F.lit("Succeeded").alias("status"), F.array(c(plain_html(F.col("grid"))), c(F.lit(None).cast("string")), c(F.lit("tail"))).alias("chunks")))
    return order_tables(spark, sf_dir).select("l_orderkey", X.payload_to_html(F.lit("pages"), recorded).alias("html"))


RUNS = """
with r as (
  select 'm' || (user_id % 5) as model, value as processing_time, event_type <> 'error' as success, case event_type when 'error' then 'failed' when 'signup' then 'empty' else 'ok' end as status,
         (event_id % 101) / 100.0::double as levenshtein, (event_id % 53) / 52.0::double as teds from events),
m as (select model as name, round(avg(case status when 'empty' then 0 when 'ok' then levenshtein end), 6) as levenshtein, round(avg(case status when 'empty' then 0 when 'ok' then teds end), 6) as teds from r group by model),
t as (select model as name, round(avg(processing_time), 6) as time_seconds from r group by model)"""


def named_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.mean_scores(run_log(spark, sf_dir), "model").select(F.col("model").alias("name"), six(F.col("levenshtein")).alias("levenshtein"), six(F.col("teds")).alias("teds"))


def named_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.mean_time(run_log(spark, sf_dir), "model").select(F.col("model").alias("name"), six(F.col("time_seconds")).alias("time_seconds"))


@query(RUNS + " select model, count(*) filter (where success) as successes, count(*) as runs from r group by model")
def r9_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(run_log(spark, sf_dir), "model")


@query(RUNS + " select *, rank() over (order by levenshtein desc) as rank from m")
def a1_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.ranked(named_scores(spark, sf_dir), "levenshtein").withColumn("rank", F.col("rank").cast("long"))


@query(RUNS + " select *, rank() over (order by time_seconds) as rank from t")
def a2_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.ranked(named_times(spark, sf_dir), "time_seconds", descending=False).withColumn("rank", F.col("rank").cast("long"))


@query(RUNS + " select model, round(avg(success::int), 6) as success_rate, round(avg((not success)::int), 6) as error_rate from r group by model")
def a3_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.success_rate(run_log(spark, sf_dir), "model").select("model", six(F.col("success_rate")).alias("success_rate"), six(F.col("error_rate")).alias("error_rate"))


@query("select source, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from documents group by source")
def a5_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.shares(table(spark, sf_dir, "documents"), "source").withColumn("share", six(F.col("share")))


@query(ROWS + """, o as (select l_orderkey, count(*) as r, 1 + l_orderkey % 13 as c from l group by l_orderkey),
k as (select case when c = 1 then 'single column' when c > 10 then 'large' when c between 3 and 6 and r between 5 and 15 then 'medium' when r < 5 and c <= 6 then 'small' else 'other' end as size from o)
select size, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from k group by size""")
def a6_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = order_tables(spark, sf_dir).withColumn("size", report.size_class(F.size("grid"), 1 + F.col("l_orderkey") % 13))
    return report.shares(o, "size").withColumn("share", six(F.col("share")))


@query("select lang, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from documents group by lang")
def a7_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.shares(table(spark, sf_dir, "documents"), "lang").withColumn("share", six(F.col("share")))


@query("select round(avg((quality = 1)::int), 6) as good, round(avg((toxic = 1)::int), 6) as toxic, round(avg(contains(text, '%')::int), 6) as percent, round(avg(contains(text, '|')::int), 6) as pipes from documents left join labels using (doc_id)")
def a8_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are shares of the labelled documents, what the text shows of all."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    p = report.prevalence(d, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1, "percent": F.col("text").contains("%"), "pipes": F.col("text").contains("|")})
    return p.select(*(six(F.col(c)).alias(c) for c in p.columns))


@query(RUNS + """ select model, count(*) filter (where levenshtein >= 0.5 and teds >= 0.5) as good, count(*) filter (where levenshtein >= 0.5 and teds < 0.5) as "content without structure",
count(*) filter (where levenshtein < 0.5 and teds >= 0.5) as "structure without content", count(*) filter (where levenshtein < 0.5 and teds < 0.5) as poor from r group by model""")
def a9_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.diagnosis(run_log(spark, sf_dir), "model")


@query(RUNS + """ select m.*, t.time_seconds, coalesce(levenshtein > max(levenshtein) over (order by time_seconds, levenshtein desc rows between unbounded preceding and 1 preceding), true) as best_of_its_speed from m join t using (name)""")
def a11_trade_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.trade_off(named_scores(spark, sf_dir), named_times(spark, sf_dir))


@query("select p_partkey, levenshtein(p_name, p_type)::int as distance from part")
def l2_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"))


@query(ROWS + " select l_orderkey, 0.0::double as levenshtein, 0.0::double as teds, true as failed from l group by l_orderkey")
def m2_metric_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions whose grid cannot be built and that have no table: both scores are 0, the run goes on."""
    o = order_tables(spark, sf_dir).select("l_orderkey", plain_html(F.col("grid")).alias("gt_html"), F.concat(F.lit('<p>x</p><div><tr><td colspan="inf">'), F.col("l_orderkey").cast("string"), F.lit("</td></tr></div>")).alias("pred_html"))
    s = score_tables(o, metrics=("levenshtein", "teds"))
    return s.select("l_orderkey", "scores.levenshtein", "scores.teds", F.col("score_error").isNotNull().alias("failed"))


@query("select event_id, event_type not in ('error', 'signup') as success from events")
def r5_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing or an empty result is no success."""
    e = table(spark, sf_dir, "events")
    result = F.when(F.col("event_type") == "signup", "").when(F.col("event_type") != "error", F.col("event_type"))
    return e.select("event_id", validated(result).alias("success"))


@query("""
select event_type as model, count(*) filter (where user_id % 7 <> 0) as successes, count(*) as runs, round(avg(value) filter (where user_id % 7 <> 0), 6) as seconds, count(*) filter (where user_id % 7 = 0) as errors from events group by event_type""")
def r7_run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records of recorded answers, every one scored; each seventh user's answer is missing."""
    e = table(spark, sf_dir, "events")
    html = F.concat(F.lit("<table><tr><td>"), F.col("event_type"), F.lit("</td></tr></table>"))
    x = e.select(F.lit("vision").alias("family"), F.col("event_type").alias("model"), F.col("event_id").cast("string").alias("image_path"), F.lit("g").alias("ground_truth_path"), html.alias("gt_html"), F.when(F.col("user_id") % 7 != 0, html).alias("pred_html"), F.lit(None).cast("string").alias("error"), F.col("value").alias("processing_time"))
    r = records(x)
    return r.groupBy("model").agg(F.count_if(F.col("success") & (F.col("scores.teds") == 1)).alias("successes"), F.count(F.lit(1)).alias("runs"), six(F.avg(F.when(F.col("success") & (F.col("total_time") >= F.col("processing_time")), F.col("processing_time")))).alias("seconds"), F.count("error").alias("errors"))


from . import edges, structures  # noqa: E402, F401  more queries, registered by being imported
