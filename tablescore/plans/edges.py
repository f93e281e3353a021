"""Registered queries of files, requests, retries, and tables at the edge of what can be scored."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.align import content_score
from ..functions.text import blank_label
from ..operators import converters as X
from ..operators.requests import SYSTEM_PROMPT, called, request
from ..operators.runs import Fatal, Retry, attempts, records, replayed, resolved
from ..operators.scoring import align_rows, canonical_html, cell_agreement, comparable, html_grid, register_metric, score_tables
from ..sources.files import DEFAULT_IMAGES, DEFAULT_TRUTHS, read_runs, samples, sending_plan, write_runs
from ..sources.stores import materialised, read_payloads, shared_folder, write_files, write_payloads
from ..streaming.polling import available, run_through, track, with_state
from .fixtures import WRONG, order_tables, plain_html, scored_pairs, table
from .queries import PLAIN, ROWS, SIZES, query, six


def next_cell(j: int) -> str:
    """SQL of the value and the way of the j-th cell of a line, given the line before as p and the matches as m."""
    values = f"p[{j}] + m[{j}]", f"p[{j + 1}] - 1::float", f"v{j - 1} - 1::float"
    return f"greatest({', '.join(values)}) as v{j}, case greatest({', '.join(values)}) when {values[0]} then 'd' when {values[1]} then 'v' else 'h' end as d{j}"


TRACE = (
    ROWS.replace("with l as", "with recursive l as")
    + f""",
w as (select l_orderkey as k, arg_min([a, b, c, d], i) as x, arg_max([a, b, c, d], i) as y from l group by l_orderkey),
s(k, x, y, i, vals, dirs) as (
  select k, x, y, 0, [[0::float, 0::float, 0::float, 0::float, 0::float]], []::varchar[][] from w
  union all
  select k, x, y, i + 1, list_append(vals, [0::float, v1, v2, v3, v4]), list_append(dirs, [d1, d2, d3, d4]) from (
    select *, {next_cell(4)} from (select *, {next_cell(3)} from (select *, {next_cell(2)} from (select *, {next_cell(1)} from (
      select *, 0::float as v0, vals[i + 1] as p,
             list_transform(y, lambda v: (case when v = x[i + 1] then 1.0::double else -1 + 2 * (1 - levenshtein(v, x[i + 1])::double / greatest(length(v), length(x[i + 1]))) end)::float) as m
      from s where i < 4)))))),
e as (select *, vals[5][5] as corner, list_transform(vals, lambda r: r[5]) as col, vals[5] as line from s where i = 4),
f as (select *, list_max(col) > corner as by_col, greatest(corner, list_max(col)) as best from e),
t(k, x, y, dirs, score, i, j, a, b) as (
  select k, x, y, dirs, greatest(best, list_max(line)), (case when list_max(line) > best or not by_col then 4 else list_position(col, list_max(col)) - 1 end)::int,
         (case when list_max(line) > best then list_position(line, list_max(line)) - 1 else 4 end)::int, []::varchar[], []::varchar[] from f
  union all
  select k, x, y, dirs, score, (i - (way <> 'h')::int)::int, (j - (way <> 'v')::int)::int, list_prepend(case when way = 'h' then '-' else x[i] end, a), list_prepend(case when way = 'v' then '-' else y[j] end, b)
  from (select *, case when i = 0 then 'h' when j = 0 then 'v' else dirs[i][j] end as way from t where i > 0 or j > 0))
select k as l_orderkey, array_to_string(a, '|') as a, array_to_string(b, '|') as b, round(score::double, 4) as score from t where i = 0 and j = 0"""
)


@query(TRACE)
def l6_alignment_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each order against its last, gaps as dashes."""
    o = order_tables(spark, sf_dir).select("l_orderkey", align_rows(F.get("grid", F.lit(0)), F.element_at("grid", -1)).alias("t"))
    shown = lambda x: F.array_join(F.transform(x, lambda c: F.coalesce(c, F.lit("-"))), "|")
    return o.select("l_orderkey", shown(F.col("t.a")).alias("a"), shown(F.col("t.b")).alias("b"), F.round("t.score", 4).alias("score"))


def supplier_files(spark: SparkSession, sf_dir: str) -> str:
    """An image and a truth for each supplier, but for every fifth, which has no truth; and what is neither. Tasks write them."""
    s = table(spark, sf_dir, "supplier").withColumn("key", F.col("s_suppkey").cast("string"))
    suffix = F.get(F.array(*map(F.lit, ("png", "jpg", "jpeg", "gif"))), F.pmod("s_suppkey", F.lit(4)).cast("int"))
    truth = F.concat(F.lit("\n  <table><tr><td>"), "s_name", F.lit("</td></tr></table>\n"))
    file = lambda name, content: F.struct(name.alias("file"), content.alias("content"))
    found = F.array(
        file(F.concat(F.lit("img/"), "key", F.lit("."), suffix), F.col("s_name")),
        file(F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("gt/"), "key", F.lit(".html"))), truth),
        file(F.concat(F.lit("img/more/"), "key", F.lit(".png")), F.lit("nested")),
        file(F.concat(F.lit("img/"), "key", F.lit(".txt")), F.lit("x")),
    )
    folder = shared_folder(spark)
    write_files(s.select(F.inline(found)).where("file is not null"), folder)
    return folder


SUPPLIERS = "select s_suppkey as k, s_name as name, s_suppkey % 4 as kind from supplier where s_suppkey % 5 <> 0"


@query(f"select k::varchar as stem, length(name) as bytes, '<table><tr><td>' || name || '</td></tr></table>' as gt_html, ['png', 'jpg', 'jpeg'][(kind + 1)::int] as suffix from ({SUPPLIERS}) where kind < 3")
def s1_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of a folder with their truths, stripped; other files, subfolders and images without truth are passed over."""
    top = supplier_files(spark, sf_dir)
    found = samples(spark, f"{top}/img", f"{top}/gt").select("stem", F.length("content").cast("long").alias("bytes"), "gt_html", F.regexp_extract("image_path", r"[^.]*$", 0).alias("suffix"))
    return materialised(found, top)


@query(f"select k::varchar as stem, name as content, '<table><tr><td>' || name || '</td></tr></table>' as gt_html, mode from ({SUPPLIERS}), (select unnest(['single', 'default']) as mode) where k = (select min(k) from ({SUPPLIERS}) where kind = 1)")
def s4_single_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image and one truth instead of folders, of unlike names; and the folders that the session names, of which one pair is shown."""
    top = supplier_files(spark, sf_dir)
    least = table(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0 and s_suppkey % 4 = 1").agg(F.min("s_suppkey")).first()[0]
    write_files(table(spark, sf_dir, "supplier").where(F.col("s_suppkey") == least).select(F.lit("other.html").alias("file"), F.concat(F.lit("<table><tr><td>"), "s_name", F.lit("</td></tr></table>")).alias("content")), f"{top}/one")
    shown = lambda d, mode: d.select("stem", F.decode("content", "utf-8").alias("content"), "gt_html", F.lit(mode).alias("mode"))
    single = shown(samples(spark, f"{top}/img/{least}.jpg", f"{top}/one/other.html"), "single")
    spark.conf.set(DEFAULT_IMAGES, f"{top}/img")
    spark.conf.set(DEFAULT_TRUTHS, f"{top}/gt")
    default = shown(samples(spark).where(F.col("stem") == str(least)), "default")
    spark.conf.unset(DEFAULT_IMAGES)
    spark.conf.unset(DEFAULT_TRUTHS)
    return materialised(single.unionByName(default), top)


def logged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as run records; each seventh user's answer is missing."""
    e = table(spark, sf_dir, "events")
    html = F.concat(F.lit("<table><tr><td>"), F.col("event_type"), F.lit("</td></tr></table>"))
    x = e.select(F.lit("vision").alias("family"), F.concat("event_type", F.lit("/x")).alias("model"), F.col("event_id").cast("string").alias("image_path"), F.lit("g").alias("ground_truth_path"), html.alias("gt_html"), F.when(F.col("user_id") % 7 != 0, html).alias("pred_html"), F.lit(None).cast("string").alias("error"), F.col("value").alias("processing_time"))
    return records(x)


@query("""
with r as (select event_type || '/x' as model, case when user_id % 7 = 0 then 'error' else 'result' end as outcome, user_id from events)
select model, 'vision_' || replace(model, '/', '_') || '_' || outcome || '.json' as file, count(*) as runs, count(*) filter (where user_id % 7 <> 0) as graded, count(*) filter (where user_id % 7 = 0) as errors from r
where model <> 'view/x' or outcome = 'result' group by all""")
def s5_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records in a file for each model and outcome. One model runs again without a failure: its files are replaced, and the one with its errors goes."""
    path, runs = shared_folder(spark), logged_runs(spark, sf_dir)
    write_runs(runs, path)
    write_runs(runs.where("model = 'view/x' and success"), path)
    log = read_runs(spark, path).withColumn("file", F.regexp_extract(F.input_file_name(), "[^/]*$", 0))
    return materialised(log.groupBy("model", "file").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("success") & (F.col("scores.teds") == 1)).alias("graded"), F.count("error").alias("errors")), path)


@query(PLAIN + " select l_orderkey, 'markdown' as family, html, 1.0::double as seconds from h where l_orderkey % 3 <> 0")
def s10_recorded_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of three families in a store, of which one family's are read and converted; every third failed."""
    o = order_tables(spark, sf_dir)
    line = F.array_join(F.transform("grid", lambda r: F.concat(F.lit("|"), F.array_join(r, "|"), F.lit("|"))), "\n")
    answer = lambda family, x: F.struct(F.lit(family).alias("family"), x.alias("payload"))
    answers = F.array(answer("markdown", F.to_json(F.struct(F.array(F.struct(line.alias("markdown"))).alias("pages")))), answer("vision", plain_html(F.col("grid"))), answer("pages", F.lit("{}")))
    rows = o.select(F.col("l_orderkey").cast("string").alias("stem"), F.lit("m").alias("model"), F.when(F.col("l_orderkey") % 3 == 0, "busy").otherwise("ok").alias("status"), F.lit(1.0).alias("seconds"), F.inline(answers))
    path = shared_folder(spark)
    write_payloads(rows, path)
    pairs = o.select(F.col("l_orderkey").cast("string").alias("stem"), "l_orderkey")
    found = replayed(pairs, read_payloads(spark, path, families=["markdown"])).where("error is null")
    return materialised(found.select("l_orderkey", "family", F.col("pred_html").alias("html"), F.col("processing_time").alias("seconds")), path)


@query(f"select 'm' as model, count(*) filter (where k % 2 = 0) as successes, count(*) as runs, count(*) filter (where k % 2 = 1) as errors from ({SUPPLIERS}) where kind < 3")
def s18_command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from folders and a store of answers to the log, by the command line; every other answer failed."""
    from ..cli import main

    top = supplier_files(spark, sf_dir)
    html = F.concat(F.lit("```html\n<table><tr><td>"), "s_name", F.lit("</td></tr></table>\n```"))
    answers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("stem"), F.explode(F.array(F.lit("vision"), F.lit("markdown"))).alias("family"), F.lit("m").alias("model"), html.alias("payload"), F.when(F.col("s_suppkey") % 2 == 1, "busy").otherwise("ok").alias("status"), F.lit(1.0).alias("seconds"))
    write_payloads(answers, f"{top}/answers")
    main(["--image", f"{top}/img", "--ground-truth", f"{top}/gt", "--payloads", f"{top}/answers", "--family", "vision", "--output", f"{top}/log"], spark)
    log = read_runs(spark, f"{top}/log")
    return materialised(log.groupBy("model").agg(F.count_if(F.col("success") & (F.col("scores.levenshtein") == 1)).alias("successes"), F.count(F.lit(1)).alias("runs"), F.count("error").alias("errors")), top)


def quoted(x: str) -> str:
    return json.dumps(x, ensure_ascii=False).replace("'", "''")


#: The field names of the services' requests.
CONTENT = "replace(to_base64(encode(p_name)), chr(10), '')"
REQUESTS = f"""
select p_partkey, f.family, sha256(case f.family when 'layout' then '{{"model":"prebuilt-layout"}}' when 'forms' then '{{"features":["TABLES"]}}'
  when 'markdown' then '{{"model":"m/1","document":{{"type":"image_url","image_url":"data:image/jpeg;base64,' || {CONTENT} || '"}},"include_image_base64":false}}'
  when 'math' then '{{"formats":["text","data","html"],"data_options":{{"include_tsv":true,"include_table_html":true,"include_latex":true}},"math_inline_delimiters":["$","$"],"rm_spaces":true}}'
  when 'elements' then '{{"file_name":"' || p_partkey || '.png","strategy":"hi_res"}}'
  when 'pages' then '{{"ocr_strategy":"All","segmentation_strategy":"Page","segment_processing":{{"page":{{"strategy":"LLM","format":"Html"}}}}}}'
  else '{{"model":"m/1","messages":[{{"role":"system","content":{quoted(SYSTEM_PROMPT)}}},{{"role":"user","content":[{{"type":"text","text":{quoted(X.TABLE_PROMPT)}}},{{"type":"image_url","image_url":{{"url":"data:image/jpeg;base64,' || {CONTENT} || '"}}}}]}}],"temperature":0.0}}' end) as request
from part, (select unnest(['layout', 'forms', 'markdown', 'math', 'elements', 'pages', 'vision']) as family) f"""


@query(REQUESTS)
def s10_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each family of services is asked for an image, as a digest; the vision models' request holds the prompt."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("img/"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("path"), F.encode("p_name", "utf-8").alias("content"))
    each = [F.struct(F.lit(f).alias("family"), F.sha2(request(f, F.col("path"), F.col("content"), F.lit("m/1")), 256).alias("request")) for f in ("layout", "forms", "markdown", "math", "elements", "pages", "vision")]
    return p.select("p_partkey", F.inline(F.array(*each)))


class Tasks:
    """A service of tasks: each is completed at the third look, or fails if its image says so."""

    def send(self, body: str, image: bytes) -> str:
        return json.dumps({"looks": 0, "name": image.decode(), "completed": False})

    def refresh(self, state: dict) -> dict:
        looks = state["looks"] + 1
        fine = not state["name"].endswith("A")
        return state | {"looks": looks, "completed": looks == 3, "status": "Succeeded" if fine else "Failed", "message": "no", "chunks": [{"content": f"{state['name']}:{looks}"}] if fine else None}


@query("select n_name as stem, case when n_name like '%A' then null else n_name || ':3' end as pred_html, true as timed from nation")
def s16_polled_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A live service whose tasks are polled until they are completed."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("stem"), F.lit("x.png").alias("image_path"), F.encode("n_name", "utf-8").alias("content"))
    service = Tasks()
    found = called(n, "pages", "default", service.send, refresh=service.refresh, every=0.0)
    return found.select("stem", "pred_html", (F.col("processing_time") >= 0).alias("timed"))


class Flaky:
    """Fails as often as the image says before it answers; some images get no key, some no answer."""

    seen: dict[str, int] = {}

    def extract(self, image: bytes, path: str) -> str | None:
        n = int(image)
        if n == 8:
            raise Fatal("no key")
        if n == 9:
            return None
        Flaky.seen[path] = Flaky.seen.get(path, 0) + 1
        if Flaky.seen[path] % 10 <= n:
            raise ValueError("busy")
        Flaky.seen[path] = 0
        return f"<table><tr><td>{n}</td></tr></table>"


@query("""
select s_suppkey, case when s_suppkey % 10 <= 2 then '<table><tr><td>' || s_suppkey % 10 || '</td></tr></table>' end as pred_html, case when s_suppkey % 10 = 8 then 'no key' when s_suppkey % 10 between 3 and 7 then 'ValueError: busy' end as error, true as timed,
(select count(*) from supplier) >= 3 as bounded from supplier""")
def r1_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three attempts at each answer; a refusal is not tried again, no answer is no error, three calls run at a time."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.expr("uuid()"), F.lit(".png")).alias("image_path"), F.encode((F.col("s_suppkey") % 10).cast("string"), "utf-8").alias("content"))
    found = attempts(s, Flaky, Retry(first_wait=0.0), slots=3)
    return found.select("s_suppkey", "pred_html", "error", (F.col("processing_time") >= 0).alias("timed"), (F.spark_partition_id() < 3).alias("bounded"))


@query("select l_orderkey, true as timed from (select distinct l_orderkey from lineitem)")
def r6_grading_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run has the time of its own grading, which the total includes."""
    html = plain_html(F.col("grid"))
    x = order_tables(spark, sf_dir).select(F.lit("vision").alias("family"), F.lit("m").alias("model"), F.col("l_orderkey").cast("string").alias("image_path"), F.lit("g").alias("ground_truth_path"), html.alias("gt_html"), html.alias("pred_html"), F.lit(None).cast("string").alias("error"), F.lit(2.0).alias("processing_time"))
    r = records(x)
    return r.select(F.col("image_path").cast("long").alias("l_orderkey"), ((F.col("grading_time") > 0) & (F.col("total_time") == F.col("grading_time") + 2.0)).alias("timed"))


@query("""select p_partkey, '<p id="k">' || p_name || ' and ' || p_type || '</p><div class="inline-tabular">' || p_brand || ' x</div>' as html from part""")
def c2_without_a_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only emphasis goes where there is no table; attributes and other elements stay."""
    x = F.concat(F.lit('<p id="k"><b>'), "p_name", F.lit("</b>\n and <em><span>"), "p_type", F.lit('</span></em></p><div class="inline-tabular">'), "p_brand", F.lit("   x</div>"))
    return table(spark, sf_dir, "part").select("p_partkey", canonical_html(x).alias("html"))


@query("select p_partkey, '<table><tr><td>' || p_name || '<table><tr><td rowspan=\"2\">' || p_brand || '</td></tr></table></td><td><div>' || p_size || '</div></td></tr></table>' as html from part")
def c5_inline_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A division of a table within a table goes, the inner table stays; other divisions stay without attributes."""
    x = F.concat(F.lit("<table><tbody><tr><td>"), "p_name", F.lit('<div class="x inline-tabular"><table id="i"><tr><td rowspan="2">'), "p_brand", F.lit('</td></tr></table></div></td><td><div class="y">'), F.col("p_size").cast("string"), F.lit("</div></td></tr></tbody></table>"))
    return table(spark, sf_dir, "part").select("p_partkey", canonical_html(x).alias("html"))


def joined(html: Column) -> Column:
    return F.array_join(F.transform(html_grid(html), lambda r: F.array_join(r, ",")), ";")


@query("select p_partkey, p_brand || ',' || p_brand || ',' || p_size || ';' || p_name || ',,' as grid from part")
def g5_column_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans over columns repeat their text; 2.5 is read as 2, and what is no number as 1."""
    x = F.concat(F.lit('<table><tr><td colspan="2.5">'), "p_brand", F.lit('</td><td colspan="x">'), F.col("p_size").cast("string"), F.lit("</td></tr><tr><td>"), "p_name", F.lit("</td></tr></table>"))
    return table(spark, sf_dir, "part").select("p_partkey", joined(x).alias("grid"))


@query("select p_partkey, 'a,b,' || p_brand || ';c,,;d,e,' || p_brand || ';f,g,' || p_brand || ';h,,' as grid from part")
def g8_stale_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span that a short row does not reach stays due, and goes on into the next table."""
    x = F.concat(F.lit('<table><tr><td>a</td><td>b</td><td rowspan="3">'), "p_brand", F.lit("</td></tr><tr><td>c</td></tr><tr><td>d</td><td>e</td></tr></table><table><tr><td>f</td><td>g</td></tr><tr><td>h</td></tr></table>"))
    return table(spark, sf_dir, "part").select("p_partkey", joined(x).alias("grid"))


CASES = {
    "rows without cells": ("<table><tr></tr></table><p>x</p>", 0.0, 0.5),
    "no table": ("plain text", 0.0, 0.0),
    "empty table": ("<table></table>", 0.0, 0.0),
    "empty rows": ("<table><tr></tr></table>", 0.833333, 0.5),
    "many more nodes": ("<table><tr><td>@</td></tr>" + "<tr><td>@</td><td>@</td></tr>" * 9 + "</table>", None, None),
}


@query("select p_partkey, kind, levenshtein::double as levenshtein, teds::double as teds from part, (values " + ", ".join(f"('{k}', {v[1]}, {v[2]})" for k, v in CASES.items() if v[1] is not None) + ") t(kind, levenshtein, teds)")
def t2_degenerate_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions without rows or cells against a table of one cell: a score is 0 where its side has no row; a row without cells is blank."""
    truth = F.concat(F.lit("<table><tr><td>"), "p_name", F.lit("</td></tr></table>"))
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(v[0]).alias("pred_html")) for k, v in CASES.items() if v[1] is not None))
    p = table(spark, sf_dir, "part").select("p_partkey", truth.alias("gt_html"), F.inline(each))
    return score_tables(p, metrics=("levenshtein", "teds")).select("p_partkey", "kind", six(F.col("scores.levenshtein")).alias("levenshtein"), six(F.col("scores.teds")).alias("teds"))


@query("select p_partkey, 0.0::double as both, 0.0::double as one, round(1 - 27.0::double / 29, 6) as capped from part")
def t5_empty_and_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two empty tables are no match; a table of 29 nodes against one of 2 has 27 nodes too many, and no score is below 0."""
    row = F.concat(F.lit("<tr><td>"), "p_brand", F.lit("</td><td>"), "p_type", F.lit("</td></tr>"))
    one = F.concat(F.lit("<table><tr><td>"), "p_name", F.lit("</td></tr>"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(one, F.lit("</table>")).alias("t"), F.concat(one, F.repeat(row, 9), F.lit("</table>")).alias("wide"))
    for name, a, b in (("both", F.lit("<table></table>"), F.lit("<table> </table>")), ("one", F.col("t"), F.lit("<table></table>")), ("capped", F.col("t"), F.col("wide"))):
        p = score_tables(p.withColumns({"gt_html": a, "pred_html": b}), metrics=("teds",)).withColumn(name, six(F.col("scores.teds"))).drop("scores", "score_error", "gt_html", "pred_html")
    return p.select("p_partkey", "both", "one", "capped")


@query(ROWS + ", r as (select l_orderkey, count(*)::double as r from l group by l_orderkey) select l_orderkey, round((5 + 3) / (5 + 5.0::double), 6) as padded, 0.0::double as empty from r")
def l4_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A truth of four columns against the same with a fifth: the blank beside it counts as unlike. A side without rows has 0."""
    five = F.transform("grid", lambda r: F.concat(r, F.array(F.lit(WRONG))))
    none = F.array().cast("array<array<string>>")
    return order_tables(spark, sf_dir).select("l_orderkey", six(content_score(F.col("grid"), five)).alias("padded"), content_score(F.col("grid"), none).alias("empty"))


@query("select p_partkey, replace(replace(p_name, ' ', ''), '-', '') || '&é<' || replace(replace(p_type, ' ', ''), '-', '') as cell from part")
def l3_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as they are compared, character references resolved."""
    return table(spark, sf_dir, "part").select("p_partkey", comparable(F.concat("p_name", F.lit(" &amp;&eacute;&#60; - "), "p_type")).alias("cell"))


@query(SIZES + """,
n as (select l_orderkey, (a = lead(a) over w)::int + (b = lead(b) over w)::int + (c = lead(c) over w)::int + (d = lead(d) over w)::int as same from l window w as (partition by l_orderkey order by i)),
e as (select l_orderkey, coalesce(sum(same), 0) as shifted from n group by l_orderkey)
select l_orderkey, kind, round(levenshtein, 6) as levenshtein, null::double as teds,
  round(case when kind = 'first row dropped' and r > 1 then shifted / (4 * r) when kind = 'last row dropped' and r > 1 then (r - 1) / r when kind = 'row added' then r / (r + 1) when kind = 'wrong cell' then 1 - 1 / (4 * r) else 1 end, 6) as agreement
from s join k using (l_orderkey, kind) join e using (l_orderkey)""")
def m4_metric_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric that is not asked for is null, an unknown name is passed over, and a third metric comes by registration."""
    register_metric("agreement", cell_agreement)
    s = score_tables(scored_pairs(spark, sf_dir), metrics=("levenshtein", "bleu", "agreement"))
    return s.select("l_orderkey", "kind", six(F.col("scores.levenshtein")).alias("levenshtein"), "scores.teds", six(F.col("scores.agreement")).alias("agreement"))


@query(PLAIN + " select l_orderkey, replace(html, '<table>', '<table><tr><td>---</td><td>:-:</td><td>---</td><td>---</td></tr>') as html from h")
def x4a_separator_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule below a header is a row like any other."""
    x = F.array_join(F.transform("grid", lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))), "\n")
    return order_tables(spark, sf_dir).select("l_orderkey", X.markdown_to_html(F.concat(F.lit("|---|:-:|---|---|\n"), x)).alias("html"))


@query("""
with s as (select p_partkey, 1000 + p_size as w, 500 + p_size as h, (p_partkey % 9)::double as mb from part)
select p_partkey, (case when mb <= 4.8 then 95 when mb - 1 <= 4.8 then 90 when mb - 2 <= 4.8 then 85 else 85 end)::int as quality,
       (case when mb - 2 <= 4.8 then w else trunc(w * sqrt(4.8::double / (mb - 2))) end)::int as width, (case when mb - 2 <= 4.8 then h else trunc(h * sqrt(4.8::double / (mb - 2))) end)::int as height from s""")
def s9_sending_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and size at which an image is sent, given its megabytes at three qualities."""
    p = table(spark, sf_dir, "part").select("p_partkey", (1000 + F.col("p_size")).alias("w"), (500 + F.col("p_size")).alias("h"), (F.col("p_partkey") % 9).cast("double").alias("mb"))
    plan = sending_plan(F.col("w"), F.col("h"), F.array(F.col("mb"), F.col("mb") - 1, F.col("mb") - 2))
    return p.select("p_partkey", plan.alias("s")).select("p_partkey", "s.quality", "s.width", "s.height")


@query("select p_partkey, p_size % 2 = 0 as blank from part")
def t7_blank_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the part of a label before its first pipe is blank."""
    label = F.concat(F.when(F.col("p_size") % 2 == 0, "  ").otherwise("td"), F.lit("|"), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", blank_label(label).alias("blank"))


@query("""
with a as (select user_id, row_number() over (partition by user_id order by ts, event_id) as k, event_type, value from events),
e as (select *, min(case when event_type <> 'error' or value > 90 then k end) over (partition by user_id) as first_end, count(*) over (partition by user_id) as n_all from a where k <= 3),
n as (select *, coalesce(first_end, least(n_all, 3)) as n from e),
s as (select user_id, max(n) as n, sum(value) filter (where k <= n) as seconds, max(case when k = n then event_type end) as last, max(case when k = n then value end) as v from n group by user_id)
select user_id, case when last <> 'error' then last end as pred_html, case when last = 'error' then case when v > 90 then 'no key' else 'busy' end end as error, n::int as attempts, round(seconds + 2 * (power(2, n - 1) - 1), 6) as processing_time from s""")
def r1_recorded_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as attempts at one answer: errors are tried again, up to three attempts, unless they are refusals."""
    e = table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    fatal = failed & (F.col("value") > 90)
    log = e.select("user_id", F.struct("ts", "event_id").alias("attempt"), F.when(~failed, F.col("event_type")).alias("result"), F.when(fatal, "no key").when(failed, "busy").alias("error"), fatal.alias("fatal"), F.col("value").alias("seconds"))
    return resolved(log, ["user_id"], Retry(first_wait=2.0)).withColumn("processing_time", six(F.col("processing_time")))


@(query if available() else lambda sql: lambda f: f)("""
with t as (select user_id || '/' || strftime(ts, '%Y-%m-%d') as task, ts, event_type, min(ts) over (partition by user_id, date_trunc('day', ts)) as started from events),
e as (select task, started, min(ts) filter (where event_type in ('purchase', 'error') and ts <= started + interval 6 hour) as ended, max(event_type) filter (where false) as x from t group by task, started),
n as (select t.task, t.started, e.ended, count(*) as looks, max(case when t.ts = e.ended and event_type = 'purchase' then 1 else 0 end) as bought from t join e using (task, started) where t.ts <= coalesce(e.ended, t.started + interval 6 hour) group by all)
select task, strftime(started, '%Y-%m-%d %H:%M:%S.%f') as started_at, strftime(coalesce(ended, started + interval 6 hour), '%Y-%m-%d %H:%M:%S.%f') as finished_at, looks, case when ended is null then 'expired' when bought = 1 then 'completed' else 'failed' end as outcome
from n where ended is not null or started + interval 6 hour < (select max(ts) from events)""")
def s16_task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events of a day as states of a task, as a stream: a purchase completes it, an error fails it, and a timer ends it after six hours."""
    with_state(spark)
    # A pattern, as the source takes any other path for a folder.
    e = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    zero = F.lit("1970-01-01").cast("timestamp_ntz")
    at = F.timestamp_micros(F.timestamp_diff("MICROSECOND", zero, "ts"))
    states = e.select(F.concat("user_id", F.lit("/"), F.date_format("ts", "yyyy-MM-dd")).alias("task"), at.alias("at"), F.col("event_type").alias("state"))
    folder = shared_folder(spark)
    found = run_through(track(states, {"purchase": "completed", "error": "failed"}, 6 * 3600.0), folder)
    shown = lambda c: F.date_format(F.timestamp_add("MICROSECOND", F.unix_micros(c), zero), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return materialised(found.select("task", shown("started_at"), shown("finished_at"), "looks", "outcome"), folder)
