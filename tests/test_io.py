import csv
import glob
import json
import re

from pyspark.sql import Row
from pyspark.sql import functions as F

from webstrata import session
from webstrata.operators import capture as C
from webstrata.operators import pages as P
from webstrata.operators import results as R
from webstrata.operators.corpus import corpus_rollup
from webstrata.plans.structure import capture_failures, structure_captures, structure_pages
from webstrata.sources import packed
from webstrata.sources import pages as sources
from webstrata.sources import sinks
from webstrata.sources.addresses import file_groups
from webstrata.streaming import ingest as streams
from webstrata.streaming.snapshot import KeptRollup, Snapshot

RESULTS = "links array<struct<text:string,href:string>>, tables array<array<array<string>>>"
PAGE = "<html><title>T{n}</title><p>{text}</p>"


def read_csv(path):
    lines = []
    for part in sorted(glob.glob(f"{path}/*.csv")):
        with open(part, newline="", encoding="utf-8") as f:
            lines += list(csv.reader(f))
    return lines


def test_csv_sinks(spark, tmp_path):
    row = ([(" First ", "https://e.org/a"), ('say "x", y', "/b"), ("gone", " ")], [[["Head"], ["Row 1a", "Row 1b"]]])
    df = spark.createDataFrame([row], RESULTS).coalesce(1)
    sinks.write_links_csv(df, str(tmp_path / "links"), [])
    sinks.write_links_csv(df.withColumn("url", F.lit("u")), str(tmp_path / "keyed"))
    assert read_csv(tmp_path / "keyed")[:2] == [["url", "text", "href"], ["u", "First", "https://e.org/a"]]
    assert read_csv(tmp_path / "links") == [["text", "href"], ["First", "https://e.org/a"], ['say "x", y', "/b"]]
    sinks.write_tables_csv(df, str(tmp_path / "tables"), keep=[])
    assert read_csv(tmp_path / "tables") == [
        ["table_index", "row_index", "col_1", "col_2"], ["1", "1", "Head", ""], ["1", "2", "Row 1a", "Row 1b"],
    ]


def test_csv_sinks_write_headers_without_rows(spark, tmp_path):
    df = spark.createDataFrame([([], [])], RESULTS).coalesce(1)
    sinks.write_links_csv(df, str(tmp_path / "l"), [])
    sinks.write_tables_csv(df, str(tmp_path / "t"), keep=[])
    assert read_csv(tmp_path / "l") == [["text", "href"]]
    assert read_csv(tmp_path / "t") == [["table_index", "row_index", "col_1"]]


def test_result_sinks(spark, pages_of, tmp_path):
    done = structure_pages(pages_of("<title>A</title>"))
    sinks.write_results(done, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).first().title == "A"
    sinks.write_json(done, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().title == "A"
    assert json.loads(sinks.as_json(done, ["page_id"]).first().json)["steps"] == []


def test_html_file_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.html").write_text("<title>één\nline</title>", encoding="utf-8")
    (tmp_path / "sub" / "b.html").write_bytes("<title>één</title>".encode("latin-1"))
    (tmp_path / "c.txt").write_text("no")
    text = sources.read_html_files(spark, str(tmp_path)).where(F.col("url").endswith("a.html"))
    assert text.first().html == "<title>één\nline</title>"
    raw = sources.read_html_bytes(spark, str(tmp_path), charset="ISO-8859-1").where(F.col("url").endswith("b.html"))
    assert P.parse(raw, ["url"]).first().title == "één"
    assert sources.read_html_files(spark, str(tmp_path)).count() == 2


def test_character_sets(spark, tmp_path):
    title = "<title>één \u2019 ö</title>"
    files = {
        "bom8": b"\xef\xbb\xbf" + title.encode(), "plain": title.encode(),
        "meta": ('<meta charset="windows-1252">' + title).encode("cp1252"),
        "http": ("<META http-equiv=Content-Type content='text/html; charset=ISO-8859-1'>" + title).encode("cp1252"),
        "le": b"\xff\xfe" + title.encode("utf-16-le"), "be": b"\xfe\xff" + title.encode("utf-16-be"),
        "utf": ("<meta charset=utf-8>" + title).encode(),
    }
    for name, data in files.items():
        (tmp_path / f"{name}.html").write_bytes(data)
    rows = sources.read_html_bytes(spark, str(tmp_path)).collect()
    assert len(rows) == len(files) and all(r.html.endswith(title) for r in rows), rows
    assert P.parse(sources.read_html_bytes(spark, str(tmp_path)), ["url"]).select("title").distinct().collect() == [("één \u2019 ö",)]


def test_page_scan_reads_only_what_is_used(spark):
    plan = P.parse(sources.read_pages(spark, "/root/testdata/sf0.001/pages.parquet"), ["page_id"])
    text = plan.select("title")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<html:string>" in text


def test_written_and_shared_folder(spark, pages_of):
    folder = session.shared_folder(spark, "x")
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert session.written(pages_of("a", "b"), "rows").count() == 2


def test_latest_result_over_batches(spark, tmp_path):
    schema = "page_id bigint, url string, html string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = streams.page_stream(spark, source, schema)
        query = streams.ingest(stream, lambda b: P.parse(b, ["page_id", "url"]), out, str(tmp_path / "state"))
        query.awaitTermination()

    arrive((1, "u", "<title>first</title>"), (2, "v", "<title>other</title>"))
    run()
    arrive((1, "u", "<title>second</title>"))
    run()
    run()
    latest = {r.url: r.title for r in streams.latest_results(spark, out, ["page_id"]).collect()}
    assert latest == {"u": "second", "v": "other"}
    assert spark.read.parquet(out).count() == 3
    one = streams.page_stream(spark, glob.glob(f"{source}/*.parquet")[0], schema)  # a single file
    streams.ingest(one, lambda b: b, str(tmp_path / "one"), str(tmp_path / "one-state")).awaitTermination()
    assert 1 <= spark.read.parquet(str(tmp_path / "one")).count() <= 2
    streams.ingest(streams.page_stream(spark, str(tmp_path / "none" / "x"), schema), lambda b: b, str(tmp_path / "no"), str(tmp_path / "no-state")).awaitTermination()
    assert streams.latest_results(spark, str(tmp_path / "no"), ["page_id"]).collect() == []
    streams.compact(spark, out, str(tmp_path / "small"), ["page_id"])
    assert {r.url: r.title for r in streams.latest_results(spark, str(tmp_path / "small"), ["page_id"]).collect()} == latest


def test_packed_pages_are_read_in_splits(spark, tmp_path):
    texts = ["<title>Zürich</title>" + "x" * (k * 37 % 400) for k in range(200)] + ["", "<p>" + "y" * 5000, None]
    rows = [(k, t, ("utf-8", "utf-16")[k % 2]) for k, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, "page_id bigint, html string, charset string")
    folder = str(tmp_path / "dump")
    assert packed.write_packed_pages(pages.coalesce(1), folder) == len(texts)
    for split, least in ((1000, 40), (1 << 30, 1)):
        found = packed.read_packed_pages(spark, folder, split=split)
        assert found.rdd.getNumPartitions() >= least
        assert {r.page_id: r.html for r in found.collect()} == {k: t or "" for k, t in enumerate(texts)}
    assert found.where("page_id = 3").first().url.endswith(".dump#3")
    assert packed.write_packed_pages(pages.limit(0), str(tmp_path / "none")) == 0
    assert packed.read_packed_pages(spark, str(tmp_path / "none")).collect() == []


def test_snapshot_and_rollup_follow_batches(spark, tmp_path):
    snapshot = Snapshot(spark, str(tmp_path / "s"), ["n"], buckets=4)
    rollup = KeptRollup(spark, str(tmp_path / "r"), ["host", "mode"], ["size"])
    schema = "url string, n bigint, host string, mode string, size bigint"
    snapshot.create(spark.createDataFrame([], schema).schema)
    snapshot.create(spark.createDataFrame([], schema).schema)
    batches = [
        [(f"u{k}", 1, f"h{k % 3}", "a", k) for k in range(30)] + [("u3", 2, "h0", "b", 100), (None, 1, "h0", "a", 5)],
        [],
        [("u4", 1, "h1", "b", None), ("new", 1, None, None, 7)],
        [(f"u{k}", 1, "h9", "z", 1) for k in range(0, 30, 2)],
    ]
    newest = {}
    for number, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, schema)
        held = snapshot.folders()
        for again in range(2):  # the second time as after a lost driver
            gone, came = snapshot.apply(batch, number)
            rollup.update(gone, came, number)
        for r in sorted(rows, key=lambda r: r[1]):
            if r[0] is not None:
                newest[r[0]] = r
        assert sorted(map(tuple, snapshot.read().collect())) == sorted(newest.values())
        full = corpus_rollup(spark.createDataFrame(list(newest.values()), schema), ["host", "mode"], ["size"])
        columns = full.columns
        assert rollup.read().columns == columns
        assert sorted(map(tuple, rollup.read().collect()), key=str) == sorted(map(tuple, full.collect()), key=str)
        touched = {b for b, p in snapshot.folders().items() if held.get(b) != p}
        assert len(touched) <= len({r[0] for r in rows if r[0]})  # other buckets stay where they are
    # a reader sees the batch before while the next one has not pointed to its files
    assert snapshot.folders(3) == held


def test_repeats_are_suppressed_within_the_horizon(spark, tmp_path):
    schema = "url string, n bigint, fetched_at timestamp"
    source, state = str(tmp_path / "in"), str(tmp_path / "c")

    def arrive(*rows):
        df = spark.createDataFrame(list(rows), "url string, n bigint, t string").select("url", "n", F.col("t").cast("timestamp").alias("fetched_at"))
        df.write.mode("append").parquet(source)

    def run():
        kept = streams.suppress_repeats(streams.page_stream(spark, source, schema), "1 day", delay="2 hours")
        query = (
            kept.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", state)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return streams.late_rows(query)

    def states(name):
        found = spark.read.format("statestore").option("stateVarName", name).load(state)
        return {r["key"][0] for r in found.select("key").collect()}

    # "a" at 05:00 is a repeat of 00:30, which comes after it; "b" waits for the watermark
    arrive(("a", 1, "2024-01-01 05:00:00"), ("a", 2, "2024-01-01 06:00:00"), ("b", 3, "2024-01-01 06:30:00"))
    assert run() == 0
    assert states("waiting") == {"a", "b"} and states("kept") == set()
    arrive(("a", 4, "2024-01-01 04:31:00"), ("b", 5, "2024-01-03 00:00:00"), ("a", 6, "2024-01-02 04:30:59"), ("a", 7, "2024-01-02 04:31:00"))
    assert run() == 0
    assert states("kept") == {"a"}  # the horizon of "b" is over
    arrive(("c", 8, "2024-01-01 00:00:00"), ("b", 9, "2024-01-02 23:00:00"), (None, 10, "2024-02-01 00:00:00"))
    assert run() == 1
    assert states("kept") == set() and states("waiting") == set()
    kept = sorted((r.url, r.n, str(r.fetched_at)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert kept == [
        ("a", 4, "2024-01-01 04:31:00"), ("a", 7, "2024-01-02 04:31:00"), ("b", 3, "2024-01-01 06:30:00"), ("b", 9, "2024-01-02 23:00:00"),
    ]


def test_an_arrival_reads_no_waiting_rows_and_lists_no_timers():
    """What a call costs does not grow with the rows that wait: a counted fake stands for the state store."""
    timers, reads = set(), []

    class Value:
        held = None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    class Waiting:
        rows = ()

        def get(self):
            reads.append(1)
            return iter(self.rows)

        def appendList(self, more):
            self.rows = [*self.rows, *more]

    class Handle:
        registerTimer, deleteTimer = timers.add, timers.remove

        def getValueState(self, *_):
            return Value()

        def getListState(self, *_):
            return Waiting()

    first = streams.FirstOfHorizon(["url", "at_us"], "at_us", 10**9)
    first.init(Handle())
    for us, wakes in ((5000, 5), (3001, 4), (9000, 4), (2000, 2)):
        assert not list(first.handleInputRows(("a",), iter([Row(url="a", at_us=us)]), None))
        assert timers == {wakes}
    assert not list(first.handleInputRows((None,), iter([Row(url=None, at_us=1)]), None))
    assert timers == {2} and not reads and [at for at, _ in first.waiting.rows] == [5000, 3001, 9000, 2000]


def body(n, extra=""):
    return f"<html><title>T{n}</title>{extra}<p>{'text of the page ' * 40}</p></html>"


def test_capture_log_end_to_end(spark, monkeypatch, tmp_path):
    schema = "url string, method string, attempt int, status_code int, content_type string, body string, error string"
    rows = [
        ("plain", "Requests", 1, 200, "text/html", body("static"), None),
        ("plain", "Playwright", 1, 200, "text/html", body("rendered"), None),
        ("app", "Requests", 1, 200, "text/html", body("static", "<div data-reactroot></div>"), None),
        ("app", "Playwright", 1, 200, "text/html", body("rendered"), None),
        ("app2", "Requests", 1, 200, "text/html", body("only", "<div data-reactroot></div>"), None),
        ("quiet", "Requests", 1, 200, "text/html", body("quiet"), None),
        ("down", "Requests", 1, 500, "text/html", body("x"), None),
    ]
    captures = spark.createDataFrame(rows, schema)
    answer = json.dumps({"website_type": "Blog", "content_confidence": 0.9, "table_confidence": 0.9})
    responses = spark.createDataFrame(
        [(u, 1, 200, answer) for u in ("plain", "app", "app2")] + [("quiet", 1, 200, "[]")],
        "url string, attempt int, status_code int, content string",
    )
    captures.repartition(3).write.parquet(str(tmp_path / "log"))
    for most, log in ((1, captures.repartition(4)), (500_000, captures), (2, str(tmp_path / "log"))):
        monkeypatch.setattr("webstrata.sources.addresses.ADDRESSES", most)
        got = {r.url: r for r in structure_captures(log, responses, spark=spark).collect()}
        assert set(got) == {"plain", "app", "app2", "quiet"}
        assert {u: (r.title, r.scrape_method) for u, r in got.items()} == {
            "plain": ("Tstatic", "Requests"), "app": ("Trendered", "Playwright"), "app2": ("Tonly", "Requests"), "quiet": ("Tquiet", "Requests"),
        }
        assert got["app"].strategy.requires_rendered and got["app"].steps[1].title == "Playwright selected"
        assert got["quiet"].strategy is None and got["quiet"].analysis is None and got["quiet"].steps == []
    failed = capture_failures(captures).first()
    assert (failed.url, failed.outcome, failed.api_status) == ("down", "server_error", 502)


def test_hot_url_does_not_change_the_result(spark):
    """A third of all attempts belong to one URL."""
    schema = "url string, method string, attempt int, status_code int, content_type string, body string, error string"
    rows = [("hot", "Requests", i, 500 if i < 150 else 200, "text/html", body(i), None) for i in range(200)]
    rows += [(f"u{i}", "Requests", 1, 200, "text/html", body(i), None) for i in range(400)]
    got = structure_captures(spark.createDataFrame(rows, schema))
    assert got.count() == 401
    assert got.where("url = 'hot'").first().title == "T150"


def exchanged(df):
    """Inputs of all exchanges of a plan."""
    text = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    sections = re.split(r"\n(?=\(\d+\) )", text)
    return [s for s in sections if re.match(r"\(\d+\) (?:Broadcast)?Exchange", s)]


def test_no_body_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr("webstrata.sources.addresses.ADDRESSES", 150)
    schema = "url string, method string, attempt int, status_code int, content_type string, body string, error string"
    rows = [(f"u{i % 300}", "Requests" if i % 2 else "Playwright", i, 200, "text/html", body(i), None) for i in range(1200)]
    seen = C.classify(spark.createDataFrame(rows, schema).repartition(6))
    needs = spark.createDataFrame([(f"u{i}", i % 3 == 0) for i in range(300)], "url string, requires_rendered boolean")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for chosen in (C.select_attempts(seen), C.reselect(seen, needs)):
            moved = exchanged(chosen)
            assert len(moved) >= 2  # several groups of files
            assert not any("body" in m for m in moved)
            assert chosen.count() == chosen.select("url").distinct().count() == 300
            assert chosen.columns == seen.columns
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_file_groups_hold_bounded_choices():
    counts = [(k, 1 + k % 7) for k in range(50)] + [(99, 1000)]
    groups = file_groups(counts, 20)
    assert sorted(f for g in groups for f in g) == sorted(f for f, _ in counts)
    assert all(sum(dict(counts)[f] for f in g) <= 20 for g in groups if g != [99])
    assert file_groups([], 20) == []


def test_latest_with_many_versions(spark):
    history = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), "id")).alias("url"), "id")
    assert R.latest_per_url(history, ["id"]).where("url = 'hot'").first().id == 999
