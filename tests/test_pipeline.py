"""Log lines to labelled sessions, import, labels, templates and links on small inputs."""

import hashlib

import pytest
from pyspark.sql import functions as F

from clickwarden.functions.paths import internal_url, is_page_path, normalize_path, normalize_referrer
from clickwarden.operators.labels import annotation_template, apply_session_labels, manual_labels, upsert_labels
from clickwarden.operators.pagelinks import broken_links, page_links
from clickwarden.operators.sessionize import load_session_requests, sessionize
from clickwarden.operators.summary import path_signatures, session_paths
from clickwarden.plans.human_import import import_human_requests
from clickwarden.sources.logs import dedupe_lines, infer_log_format, normalize_requests, parse_combined_log

CHROME = "Mozilla/5.0 Chrome/120.0"


def line(ip, time, path, agent, referrer="-", status=200):
    return f'{ip} - - [{time} +0000] "GET {path} HTTP/1.1" {status} 120 "{referrer}" "{agent}"'


def lines_df(spark, lines):
    return spark.createDataFrame([(text,) for text in lines], "value string")


def column_values(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_normalize_path(spark):
    cases = {
        None: None, "  ": None, "/a?b=1": "/a", "a#x": "/a", "http://h": "/", "https://h/x/y;p=1?q": "/x/y",
        "https://h/a;b/c": "/a;b/c", "http://h?q": "/", "?only": "/", "/a;b": "/a;b", "//a": "//a",
    }
    assert column_values(spark, list(cases), normalize_path) == list(cases.values())


def test_normalize_referrer(spark):
    cases = {"-": None, "": None, "http://h": None, "http://h/": "/", "https://h/a?b": "/a", "x": "/x", "http://h?q": None}
    assert column_values(spark, list(cases), normalize_referrer) == list(cases.values())


def test_page_paths(spark):
    cases = {"/favicon.ico": False, "/a": True, "/a.CSS": False, "/a.css/b": True, "/v1.2": True, "/a.html": True}
    assert column_values(spark, list(cases), is_page_path) == list(cases.values())


def test_internal_urls(spark):
    base = F.lit("https://h.example/docs/a.html?x=1#f")
    cases = {
        "b.html": "https://h.example/docs/b.html", "../c": "https://h.example/c", "/d?e=1#g": "https://h.example/d?e=1",
        "https://other/x": None, "mailto:a@b": None, "#top": None, "//h.example/z": "https://h.example/z",
        "?q=2": "https://h.example/docs/a.html?q=2", "https://h.example/y#z": "https://h.example/y",
        "./": "https://h.example/docs/", "../../..": "https://h.example/",
    }
    assert column_values(spark, list(cases), lambda v: internal_url(base, v)) == list(cases.values())


def test_combined_log_to_labels(spark):
    lines = [
        line("10.0.0.1", "01/Jan/2024:10:00:00", "/", CHROME), line("10.0.0.1", "01/Jan/2024:10:00:20", "/a", CHROME, "http://s/"),
        line("10.0.0.1", "01/Jan/2024:10:01:00", "/b", CHROME), line("10.0.0.2", "01/Jan/2024:10:00:00", "/", "python-requests/2"),
        line("10.0.0.2", "01/Jan/2024:10:00:01", "/a", "python-requests/2"), "", "   ",
    ]
    events = sessionize(parse_combined_log(lines_df(spark, lines)))
    labelled, summary = apply_session_labels(events)
    rows = {r["client_key"]: r for r in summary.collect()}
    assert len(rows) == 2
    assert rows[f"ip_ua:10.0.0.1|{CHROME}"]["proposed_label"] == "human"
    assert rows["ip_ua:10.0.0.2|python-requests/2"]["proposed_label"] == "bot"
    assert {r["label"] for r in labelled.select("label").collect()} == {"human", "bot"}


def test_bad_line_fails_the_job(spark):
    with pytest.raises(Exception, match="could not parse log line"):
        parse_combined_log(lines_df(spark, ["nonsense"])).collect()


def test_manual_label_metadata_reaches_events(spark):
    lines = [line("10.0.0.1", f"01/Jan/2024:10:00:0{i}", f"/{i}", CHROME) for i in range(2)]
    labels = manual_labels(spark.createDataFrame(
        [(f"ip_ua:10.0.0.1|{CHROME}", "HUMAN", "p1")], "client_key string, label string, participant_id string"))
    labelled, summary = apply_session_labels(sessionize(parse_combined_log(lines_df(spark, lines))), labels)
    assert summary.head()["participant_id"] == "p1"
    assert [(r["label"], r["participant_id"]) for r in labelled.collect()] == [("human", "p1")] * 2


def test_duplicate_label_key_fails(spark):
    lines = [line("10.0.0.1", f"01/Jan/2024:10:00:0{i}", f"/{i}", CHROME) for i in range(2)]
    labels = manual_labels(spark.createDataFrame(
        [(f"ip_ua:10.0.0.1|{CHROME}", "human"), (f"ip_ua:10.0.0.1|{CHROME}", "bot")], "client_key string, label string"))
    with pytest.raises(Exception, match="duplicate label rows"):
        apply_session_labels(sessionize(parse_combined_log(lines_df(spark, lines))), labels)[1].collect()


def test_timeout_is_strict_and_short_sessions_keep_their_number(spark):
    rows = [("c", 0.0, "/a"), ("c", 1800.0, "/b"), ("c", 3600.5, "/c"), ("c", 9000.0, "/d"), ("c", 9001.0, "/e")]
    events = sessionize(spark.createDataFrame(rows, "client_key string, timestamp double, path string"))
    found = {r["path"]: (r["session_index"], r["seq"]) for r in events.collect()}
    assert found == {"/a": (0, 1), "/b": (0, 2), "/d": (2, 1), "/e": (2, 2)}


def test_hot_clients_give_the_same_events(spark):
    rows = [
        (f"c{i % 3 if i % 5 else 0}", float(i * 37 % 5000), f"/p{i % 7}", i, None if i % 4 else f"agent{i % 3}", ["bot", "human", None][i % 3])
        for i in range(400)
    ]
    requests = spark.createDataFrame(rows, "client_key string, timestamp double, path string, id long, user_agent string, label string")
    columns = ["id", "session_id", "seq", "n_events", "delta_t", "label", "prev_path", "prev2_path", "prev_category", "prev_user_agent", "referrer"]

    def run(hot_rows):
        events = sessionize(requests, timeout=40.0, min_length=1, tie_breaker="id", hot_rows=hot_rows)
        return sorted(map(tuple, events.select(*columns).collect()))

    plain = run(None)
    for hot_rows in (1, 2, 7, 50, 1000):
        assert run(hot_rows) == plain


def test_reload_checks(spark):
    schema = "session_id string, timestamp double, path string, delta_t double, label string"
    rows = spark.createDataFrame([("s", 2.0, "/b", 1.0, " Bot"), ("s", 1.0, "/a", 0.0, "bot")], schema)
    assert [(r["seq"], r["path"], r["label"]) for r in load_session_requests(rows).orderBy("seq").collect()] == [
        (1, "/a", "bot"), (2, "/b", "bot")]
    with pytest.raises(ValueError):
        load_session_requests(rows.drop("delta_t"))
    with pytest.raises(Exception, match="conflicting labels"):
        load_session_requests(spark.createDataFrame([("s", 1.0, "/a", 0.0, "bot"), ("s", 2.0, "/b", 0.0, "human")], schema)).collect()
    with pytest.raises(Exception, match="unsupported label"):
        load_session_requests(spark.createDataFrame([("s", 1.0, "/a", 0.0, "cat")], schema)).collect()


def test_request_columns_are_required(spark):
    with pytest.raises(ValueError):
        normalize_requests(spark.createDataFrame([("/a",)], "path string"))
    with pytest.raises(ValueError):
        normalize_requests(spark.createDataFrame([(1.0,)], "time double"))


def test_format_inference(spark, tmp_path):
    for name, text, expected in (
        ("a.CSV", "x", "csv"), ("a.ndjson", "x", "jsonl"), ("a.log", '\n  {"time": 1}\n', "jsonl"),
        ("b.log", line("1.1.1.1", "01/Jan/2024:10:00:00", "/", "x") + "\n", "combined"), ("c.log", "time,path\n", "csv"),
    ):
        path = tmp_path / name
        path.write_text(text)
        assert infer_log_format(spark, str(path)) == expected


def test_human_import(spark):
    lines = [
        line("10.0.0.1", "01/Jan/2024:10:00:00", "/", CHROME), line("10.0.0.1", "01/Jan/2024:10:00:10", "/a.css", CHROME),
        line("10.0.0.1", "01/Jan/2024:10:00:20", "/a", CHROME), line("10.0.0.1", "01/Jan/2024:11:10:00", "/", CHROME),
        line("10.0.0.1", "01/Jan/2024:11:10:30", "/b", CHROME), line("10.0.0.9", "01/Jan/2024:11:10:30", "/b", "WhatsApp/2"),
        line("10.0.0.9", "01/Jan/2024:11:10:31", "/", "WhatsApp/2"),
    ]
    unique = dedupe_lines(lines_df(spark, lines + lines[:3]))
    result = import_human_requests(parse_combined_log(unique), participant_prefix="p")
    manifest = result["manifest"].orderBy("participant_id").collect()
    assert [r["participant_id"] for r in manifest] == ["p_001", "p_002"]
    assert manifest[0]["path_signature"] == "/ > /a" and manifest[0]["start_time_utc"] == "2024-01-01T10:00:00+00:00"
    assert result["counts"].head().asDict() == {"num_requests": 5, "num_filtered": 2}
    assert result["labels"].count() == 2


def test_signatures_have_one_definition_at_every_length(spark):
    sessions = {"s": 7, "t": 2, "u": 3, "v": 120_000, "w": 5}
    rows = [(name, i, f"/{i}") for name, n in sessions.items() for i in range(1, n + 1)]
    events = spark.createDataFrame(rows, "session_id string, seq long, path string").repartition(5)
    got = {r["session_id"]: r for r in path_signatures(events).collect()}
    digest = lambda n: hashlib.sha1(" > ".join(f"/{i}" for i in range(1, n + 1)).encode()).hexdigest()[:12]
    for name, n in sessions.items():
        assert [got[name][k] for k in ("path_signature", "prefix3_signature", "prefix5_signature")] == [digest(n), digest(min(n, 3)), digest(min(n, 5))]
    assert session_paths(events).where("session_id = 'v'").head()["paths"].count(" | ") == 119_999


def test_large_and_unreadable_sizes(spark):
    good = line("10.0.0.1", "01/Jan/2024:10:00:00", "/", CHROME)
    large = good.replace('HTTP/1.1" 200 ', 'HTTP/1.1" 200 ').split(" ")
    at = next(i for i, word in enumerate(large) if word == "200") + 1
    large[at] = "3000000000"
    odd = [*large[:at], "12x", *large[at + 1:]]
    parsed = parse_combined_log(lines_df(spark, [" ".join(large), " ".join(odd)]), on_error="keep").collect()
    assert [r["body_bytes_sent"] for r in parsed if r["corrupt_line"] is None] == [3_000_000_000]
    assert sum(r["corrupt_line"] is not None for r in parsed) == 1


def test_label_upsert(spark):
    schema = "client_key string, session_id string, label string, notes string, n int"
    old = spark.createDataFrame([("a", "", "bot", "keep", 1), ("b", "", "bot", "", 2)], schema)
    new = spark.createDataFrame([("a", "", "human", "", 1), ("", "s1", "human", "x", 2), ("", " ", "bot", "", 3)], schema)
    rows = {(r["client_key"], r["session_id"]): (r["label"], r["notes"]) for r in upsert_labels(old, new, "n").collect()}
    assert rows == {("a", ""): ("human", "keep"), ("b", ""): ("bot", ""), ("", "s1"): ("human", "x")}


def test_annotation_template(spark):
    summary = spark.createDataFrame([("s2", "unknown", "bot"), ("s1", "human", "human")], "session_id string, proposed_label string, label string")
    sheet = annotation_template(summary)
    assert [r["session_id"] for r in sheet.collect()] == ["s1", "s2"] and {r["label"] for r in sheet.collect()} == {""}
    assert annotation_template(summary, only_unknown=True, keep_labels=True).head()["label"] == "bot"


def test_page_links(spark):
    html = """<a href="/b">x</a><!-- <a href="/hidden"> --><script>var s = '<a href="/no">';</script>
      <img src='pic.png'><link href=/style.css rel=x><a href="mailto:x@y">m</a><a href="https://other/z">o</a>"""
    pages = spark.createDataFrame([(1, "https://h/dir/a", html), (2, "https://h/b", "")], "page_id int, url string, html string")
    links = {r["ref"]: (r["kind"], r["local_target"], r["internal"]) for r in page_links(pages).collect()}
    assert links == {
        "/b": ("link", "/b", "https://h/b"), "pic.png": ("asset", "/dir/pic.png", "https://h/dir/pic.png"),
        "/style.css": ("asset", "/style.css", "https://h/style.css"), "mailto:x@y": ("link", None, None),
        "https://other/z": ("link", None, None),
    }
    assert {r["ref"] for r in broken_links(pages).collect()} == {"pic.png", "/style.css"}


def test_late_rows_are_counted_batch_by_batch(spark, tmp_path):
    from clickwarden.streaming.sessions import LateRows, closed_sessions

    counter = LateRows()
    spark.streams.addListener(counter)
    try:
        # files are read one by one, in the order of their times
        hours = [["2024-01-01 10:00:00"], ["2024-01-01 20:00:00"], ["2024-01-01 20:01:00"], ["2024-01-01 10:00:05", "2024-01-01 10:00:06", "2024-01-01 20:02:00"]]
        for at, times in enumerate(hours):
            frame = spark.createDataFrame([("c", t) for t in times], "client_key string, t string").selectExpr("client_key", "to_timestamp(t) AS event_time")
            frame.coalesce(1).write.parquet(f"{tmp_path}/part{at}")
            next((tmp_path / f"part{at}").glob("part-*.parquet")).rename(tmp_path / f"{at}.parquet")
        stream = spark.readStream.schema("client_key string, event_time timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*.parquet")
        started = closed_sessions(stream, 1800, "10 minutes").writeStream.format("noop").outputMode("append").option(
            "checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        started.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        assert counter.dropped[str(started.id)] == 2
    finally:
        spark.streams.removeListener(counter)
