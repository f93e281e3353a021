import json

import pytest
from pyspark.sql import functions as F
from test_tables import html

from tablescore.operators import runs as R
from tablescore.plans import report
from tablescore.sources import files as S
from tablescore.sources.stores import PAYLOAD, Ledger, read_payloads, write_files, write_payloads
from tablescore.streaming import ingest, polling


class Answers:
    """Fails as often as the image's first byte says, then answers."""

    calls = 0

    def extract(self, image, path):
        Answers.calls += 1
        if image == b"fatal":
            raise R.Fatal("no key")
        if Answers.calls <= int(image[:1]):
            raise ValueError("busy")
        return html([["a"]])


@pytest.mark.parametrize(("image", "policy", "result", "error", "waits"), [(b"0", R.Retry(), True, None, []), (b"2", R.Retry(), True, None, [1.0, 2.0]), (b"3", R.Retry(), False, "ValueError: busy", [1.0, 2.0]), (b"9", R.Retry(2, 5.0), False, "ValueError: busy", [5.0]), (b"fatal", R.Retry(), False, "no key", [])])
def test_retries(image, policy, result, error, waits):
    Answers.calls, slept = 0, []
    r, e, seconds = R.call(Answers, image, "x", policy, slept.append)
    assert (r is not None, e, slept) == (result, error, waits) and seconds >= 0


def test_worst_waits():
    assert [R.POLICIES[f][0].worst_wait() for f in ("layout", "forms", "elements")] == [3, 6, 524287]


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    top = tmp_path_factory.mktemp("samples")
    (top / "img").mkdir()
    (top / "gt").mkdir()
    for name in ("a.png", "b.jpeg", "c.jpg", "d.gif"):
        (top / "img" / name).write_bytes(b"0" + name.encode())
    for name in ("a", "b", "z"):
        (top / "gt" / f"{name}.html").write_text(f"\n {html([[name]])} \n")
    return str(top / "img"), str(top / "gt")


def test_pairing(spark, folders):
    pairs = S.samples(spark, *folders)
    assert {(r.stem, r.gt_html) for r in pairs.collect()} == {("a", html([["a"]])), ("b", html([["b"]]))}
    assert pairs.where("stem = 'a'").select(S.data_uri(F.col("image_path"), F.col("content"))).first()[0].startswith("data:image/png;base64,")
    with pytest.raises(ValueError):
        S.required(pairs.limit(0))


def test_live_records_and_log(spark, folders, tmp_path):
    found = R.attempts(S.samples(spark, *folders), Answers, slots=2)
    found = found.withColumns({"family": F.lit("vision"), "model": F.lit("x/y")})
    bad = found.where("stem = 'b'").withColumn("pred_html", F.lit(""))
    log = R.records(found.unionByName(bad), graded_in=0.5).cache()
    rows = log.collect()
    assert log.schema == S.RUN or [f.name for f in log.schema] == [f.name for f in S.RUN]
    good = [r for r in rows if r.success]
    assert len(good) == 2 and all(r.grading_time == 0.5 and r.total_time >= 0.5 and r.error is None for r in good)
    failed = next(r for r in rows if not r.success)
    assert (failed.error, failed.scores, failed.grading_time, failed.result) == ("empty result", None, 0.0, None)
    assert max(r.scores.levenshtein for r in good) == 1.0
    S.write_runs(log, str(tmp_path / "log"))
    again = S.read_runs(spark, str(tmp_path / "log"))
    assert again.count() == 3 and (tmp_path / "log" / "vision_x_y_error.json").is_file()
    assert [tuple(r) for r in R.summary(again, "model").collect()] == [("x/y", 2, 3)]


def test_replay(spark, folders, tmp_path):
    path = tmp_path / "payloads.json"
    path.write_text("\n".join(json.dumps(x) for x in [
        {"stem": "a", "family": "markdown", "model": "m", "payload": json.dumps({"pages": [{"markdown": "|a|"}]}), "status": "ok", "seconds": 2.0},
        {"stem": "b", "family": "pages", "model": "p", "payload": json.dumps({"status": "Failed"}), "status": "ok", "seconds": 1.0},
        {"stem": "b", "family": "vision", "model": "v", "payload": "x", "status": "no key", "seconds": 0.0},
    ]))
    log = R.records(R.replayed(S.samples(spark, *folders), S.recorded_payloads(spark, str(path))))
    assert {(r.model, r.success, r.error) for r in log.collect()} == {("m", True, None), ("p", False, "no result"), ("v", False, "no key")}


def test_sending_plan(spark):
    df = spark.createDataFrame([(100, 50, [5.0, 4.8, 1.0]), (100, 50, [9.6])], "w int, h int, mb array<double>")
    got = [tuple(r[0]) for r in df.select(S.sending_plan(F.col("w"), F.col("h"), F.col("mb"))).collect()]
    assert got == [(90, 100, 50), (85, 70, 35)]


def test_aggregate_files(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"title": "t", "models": [{"name": "a", "levenshtein": 0.9, "teds": 0.8}, {"name": "b", "levenshtein": 0.5, "teds": 0.7}]}))
    (tmp_path / "t.json").write_text(json.dumps({"models": [{"name": "a", "time_seconds": 9.0}, {"name": "b", "time_seconds": 10.0}]}))
    both = report.trade_off(S.read_models(spark, str(tmp_path / "s.json"), S.LEADERBOARD), S.read_models(spark, str(tmp_path / "t.json"), S.SPEED))
    assert {(r.name, r.best_of_its_speed) for r in both.collect()} == {("a", True), ("b", False)}


def test_policy_of_means(spark):
    df = spark.createDataFrame([("m", "ok", 0.8, 0.6), ("m", "empty", 0.9, 0.9), ("m", "failed", 0.1, 0.1)], "model string, status string, levenshtein double, teds double")
    assert tuple(report.mean_scores(df, "model").first()) == ("m", 0.4, 0.3)


def test_streaming(spark, folders, tmp_path):
    log = R.records(R.attempts(S.samples(spark, *folders), Answers).withColumns({"family": F.lit("vision"), "model": F.lit("m")}))
    log.write.json(str(tmp_path / "in"))
    runs = ingest.stream_runs(spark, str(tmp_path / "in"))
    q = ingest.success_by_window(runs).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(successes), sum(runs) from windows").first() == (2, 2)
    pairs = runs.select(F.col("result").alias("gt_html"), F.col("result").alias("pred_html"))
    q = ingest.write_stream(ingest.score_stream(pairs), str(tmp_path / "out"), str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("scores.levenshtein").collect()] == [1.0, 1.0]


def test_command_line(spark, folders, tmp_path, capsys):
    from tablescore.cli import main

    (tmp_path / "p.json").write_text(json.dumps({"stem": "a", "family": "vision", "model": "v", "payload": html([["a"]]), "seconds": 1.0}))
    main(["--image", folders[0], "--ground-truth", f"{folders[1]}/a.html", "--payloads", str(tmp_path / "p.json"), "--output", str(tmp_path / "o")], spark)
    assert "v" in capsys.readouterr().out
    assert S.read_runs(spark, str(tmp_path / "o")).first().scores.teds == 1.0


class Mortal:
    """Answers with the path; the first attempt at one image takes its worker with it. Notes each call in a file."""

    def __init__(self, folder):
        self.folder = folder

    def extract(self, image, path):
        import os
        import uuid

        open(f"{self.folder}/calls/{path}-{uuid.uuid4().hex}", "w").close()
        if path == "5" and not os.path.exists(f"{self.folder}/died"):
            open(f"{self.folder}/died", "w").close()
            os._exit(1)
        if path == "7":
            raise R.Fatal("no key")
        return path


def test_a_lost_task_repeats_one_call(spark, tmp_path):
    import functools
    import os
    from collections import Counter

    (tmp_path / "calls").mkdir()
    df = spark.range(0, 12, 1, 3).select(F.col("id").cast("string").alias("image_path"), F.lit(b"x").alias("content"))
    found = R.attempts(df, functools.partial(Mortal, str(tmp_path)), R.Retry(first_wait=0.0), slots=1, ledger=str(tmp_path / "ledger"), name="m")
    with pytest.raises(Exception):  # noqa: B017, PT011  one attempt at a task in local mode
        found.collect()
    rows = {r.image_path: (r.pred_html, r.error) for r in found.collect()}
    assert rows == {str(k): (str(k), None) if k != 7 else (None, "no key") for k in range(12)}
    assert {r.image_path: (r.pred_html, r.error) for r in found.collect()} == rows
    calls = Counter(x.split("-")[0] for x in os.listdir(tmp_path / "calls"))
    assert calls == {str(k): 2 if k == 5 else 1 for k in range(12)}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_ledger(tmp_path):
    book = Ledger(str(tmp_path))
    assert book.get("a") is None
    book.put("a", {"x": None})
    book.put("a", {"x": 1})
    assert book.get("a") == {"x": 1} and Ledger(str(tmp_path)).get("a") == {"x": 1} and book.get("b") is None


def test_recorded_attempts(spark):
    rows = [("a", 1, None, "busy", False, 1.0), ("a", 2, "x", None, None, 1.0), ("a", 3, "y", None, None, 9.0), ("b", 2, None, "no key", True, 2.0), ("b", 3, "x", None, None, 9.0), ("c", 1, None, "e", False, 1.0), ("c", 2, None, "f", False, 1.0), ("c", 3, None, "g", None, 1.0), ("c", 4, "x", None, None, 9.0), ("d", 1, None, None, None, 1.0)]
    df = spark.createDataFrame(rows, "k string, attempt int, result string, error string, fatal boolean, seconds double")
    got = {r.k: tuple(r)[1:] for r in R.resolved(df, ["k"], R.Retry(3, 2.0)).collect()}
    assert got == {"a": ("x", None, 2, 4.0), "b": (None, "no key", 1, 2.0), "c": (None, "g", 3, 9.0), "d": (None, None, 1, 1.0)}
    assert R.resolved(df.limit(0), ["k"]).count() == 0


def test_run_files_are_replaced_as_a_whole(spark, tmp_path):
    """One file for each model and outcome; a job that fails leaves the old ones, and only the models of a job are replaced."""
    path = str(tmp_path / "log")
    one = lambda model, ok, k: ("vision", model, str(k), "g", 1.0, 0.0, 1.0, "r" if ok else None, None if ok else "e", (1.0, 1.0) if ok else None, 0.0, ok)
    log = lambda *rows: spark.createDataFrame([one(*r) for r in rows], S.RUN).repartition(3)
    S.write_runs(log(("x/y", True, 1), ("x/y", True, 2), ("x/y", False, 3), ("z", True, 1)), path)
    names = lambda: sorted(p.name for p in (tmp_path / "log").iterdir())
    assert names() == ["vision_x_y_error.json", "vision_x_y_result.json", "vision_z_result.json"]
    failing = log(*(("x/y", True, k) for k in range(50))).withColumn("result", F.when(F.col("image_path") == "30", F.raise_error(F.lit("lost"))).otherwise("new"))
    with pytest.raises(Exception, match="lost"):
        S.write_runs(failing, path)
    assert names() == ["vision_x_y_error.json", "vision_x_y_result.json", "vision_z_result.json"]
    assert {r.result for r in S.read_runs(spark, path).collect()} == {"r", None}
    S.write_runs(log(*(("x/y", True, k) for k in range(50))), path, files=2)
    assert names() == ["vision_x_y_result.1.json", "vision_x_y_result.json", "vision_z_result.json"]
    S.write_runs(log(("x/y", True, 9)), path)
    assert names() == ["vision_x_y_result.json", "vision_z_result.json"]
    assert sorted((r.model, r.image_path) for r in S.read_runs(spark, path).collect()) == [("x/y", "9"), ("z", "1")]
    S.write_runs(log(("x/y", True, 9)).limit(0), path)
    assert len(names()) == 2


def test_payload_store_reads_what_is_asked_for(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(str(k), f, "m", "é\n\"x\"" * k, None, 0.5) for k in range(40) for f in ("vision", "pages")] + [(None, "vision", "m", None, "busy", None)]
    write_payloads(spark.createDataFrame(rows, PAYLOAD), path)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, read_payloads(spark, path).collect()), key=key) == sorted(rows, key=key)
    parts = lambda df: df.rdd.getNumPartitions()
    one, two = read_payloads(spark, path, families=["pages"]), read_payloads(spark, path, stems=["7", "none"], families=["pages", "vision"])
    assert parts(two) <= 4 < parts(one) < parts(read_payloads(spark, path))
    assert one.count() == 40 and sorted(r.family for r in two.collect()) == ["pages", "vision"] and {r.stem for r in two.collect()} == {"7"}
    assert read_payloads(spark, path, families=["none"]).count() == read_payloads(spark, path, families=["pages"]).where("stem is null").count() == 0
    write_payloads(spark.createDataFrame([("x", "pages", "m", "p", None, 1.0)], PAYLOAD), path)
    assert read_payloads(spark, path).where("family = 'vision'").count() == 41


def test_rows_of_one_file_in_two_tasks_are_refused(spark, tmp_path):
    df = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "3")], "file string, content string").coalesce(1)
    with pytest.raises(Exception, match="more than one task"):
        write_files(df, str(tmp_path / "x"))
    assert list((tmp_path / "x").iterdir()) == []
    write_files(df.where("content <> '3'"), str(tmp_path / "x"))
    assert (tmp_path / "x" / "a").read_text() == "1"


def test_modes(spark, folders, tmp_path):
    """Two files of unlike names are a pair; without paths the session's are taken."""
    (tmp_path / "t.html").write_text(html([["t"]]))
    assert [(r.stem, r.gt_html) for r in S.samples(spark, f"{folders[0]}/a.png", str(tmp_path / "t.html")).collect()] == [("a", html([["t"]]))]
    with pytest.raises(ValueError):
        S.samples(spark)
    spark.conf.set(S.DEFAULT_IMAGES, folders[0])
    spark.conf.set(S.DEFAULT_TRUTHS, folders[1])
    assert S.samples(spark).count() == 2
    spark.conf.unset(S.DEFAULT_IMAGES)
    spark.conf.unset(S.DEFAULT_TRUTHS)


def test_polled_tasks_start_once(spark, tmp_path):
    """A stream that is stopped while tasks are open goes on after a restart; no task is started twice."""
    import functools
    import os
    import time

    pytest.importorskip("google.protobuf")
    polling.with_state(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "starts").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"task": t, "request": t}) for t in ("a", "b", "never", "a")))
    requests = lambda: spark.readStream.schema("task string, request string").json(str(tmp_path / "in"))
    found = lambda: polling.poll(requests(), functools.partial(start_task, str(tmp_path)), look_at_task, every=0.2, looks=6, ledger=str(tmp_path / "ledger"))
    go = lambda: found().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(processingTime="200 milliseconds").start()
    rows = lambda: {r.task: (json.loads(r.payload)["looks"] if r.payload else None, r.error, r.looks) for r in spark.read.schema(polling.POLLED).parquet(str(tmp_path / "out")).collect()} if (tmp_path / "out").exists() else {}

    def until(done):
        end = time.time() + 60
        while not done() and time.time() < end:
            time.sleep(0.3)
        assert done()

    q = go()
    until(lambda: len(os.listdir(tmp_path / "starts")) == 3)
    q.stop()
    q = go()
    until(lambda: len(rows()) == 3)
    q.stop()
    assert rows() == {"a": (3, None, 3), "b": (3, None, 3), "never": (None, "not completed", 6)}
    assert sorted(x.split("-")[0] for x in os.listdir(tmp_path / "starts")) == ["a", "b", "never"]


def start_task(folder, request):
    import uuid

    open(f"{folder}/starts/{request}-{uuid.uuid4().hex}", "w").close()
    return {"task": request, "looks": 0}


def look_at_task(state):
    looks = state["looks"] + 1
    return state | {"looks": looks, "completed": looks == 3 and state["task"] != "never"}


def test_breakdown(spark):
    df = spark.createDataFrame([("m", "a", "ok", True, 1.0, 0.5), ("m", None, "empty", True, 0.9, 0.9), ("n", "a", "failed", False, 0.3, 0.3)], "model string, domain string, status string, success boolean, levenshtein double, teds double")
    got = {(r.model, r.domain, r.level): (r.runs, r.success_rate, r.levenshtein) for r in report.breakdown(df, ["model", "domain"]).collect()}
    assert got[None, None, 3] == (3, pytest.approx(2 / 3), 0.5) and got["m", None, 0] == (1, 1.0, 0.0) and got["m", None, 1] == (2, 1.0, 0.5) and got[None, None, 2] == (1, 1.0, 0.0)
    some = report.breakdown(df, ["model", "domain"], [["model"], []])
    assert {(r.model, r.level) for r in some.collect()} == {("m", 1), ("n", 1), (None, 3)}
