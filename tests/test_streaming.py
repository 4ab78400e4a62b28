"""Live scoring: running sums against whole sessions, resets, expiry, late rows, models swapped between batches."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clickwarden.constants import FEATURE_COLUMNS
from clickwarden.operators.models import ModelBundle, fit_logistic_regression
from clickwarden.streaming import running
from clickwarden.streaming.late import start_late_split
from clickwarden.streaming.scorer import BundleScorer, active_sessions, start_scoring


def plog(symbols):
    return sum(c / len(symbols) * math.log2(c / len(symbols)) for c in Counter(symbols).values()) if symbols else 0.0


def whole_session(events):
    """The sums of a session from all its events: (time, path, category, agent, status, depth, degree, leaf, out, in)."""
    n, half = len(events), max(2, len(events) // 2)
    paths, kinds = [e[1] for e in events], [e[2] for e in events]
    degree = {e[1]: e[6] for e in reversed(events)}
    families = {
        "node": (paths, paths[:half]), "cat": (kinds, kinds[:half]),
        "trans": (list(zip(paths, paths[1:])), list(zip(paths, paths[1:]))[: half - 1]),
        "cattrans": (list(zip(kinds, kinds[1:])), list(zip(kinds, kinds[1:]))[: half - 1]),
    }
    deltas = [max(0.0, b[0] - a[0]) for a, b in zip(events, events[1:])]
    mean = sum(deltas) / len(deltas)
    agents = [e[3] for e in events if e[3] is not None]
    hops = []
    for a, b in zip(events, events[1:]):
        if a[1] == b[1]:
            hops.append(0)
        elif b[9] is None:
            hops.append(1)
        else:
            hops.append(min((d + b[9][h] for h, d in a[8].items() if h in b[9]), default=999))
    branching, pages = 0.0, {}
    for a, b in zip(paths, paths[1:]):
        pages.setdefault(a, []).append(b)
    for page, chosen in pages.items():
        support = degree[page] if degree[page] >= 2 else len(set(chosen))
        branching += 0.0 if len(set(chosen)) <= 1 else -plog(chosen) / math.log2(support)
    out = {
        "n": n, "backtracks": sum(a == b for a, b in zip(paths, paths[2:])), "self_loops": sum(a == b for a, b in zip(paths, paths[1:])),
        "depth_sum": sum(e[5] for e in events if e[5] >= 0), "depth_n": sum(e[5] >= 0 for e in events),
        "leaves": sum(e[7] for e in events), "out_degree_sum": sum(e[6] for e in events), "hop_sum": sum(hops),
        "far_jumps": sum(h >= 3 for h in hops), "fast": sum(d <= 1 for d in deltas), "statuses": sum(e[4] is not None for e in events),
        "errors": sum((e[4] or 0) >= 400 for e in events), "agents": len(agents),
        "agent_switches": sum(a != b for a, b in zip(agents, agents[1:])),
        "category_switches": sum(a != b for a, b in zip(kinds, kinds[1:])), "left_pages": len(pages),
        "delta_sum": sum(deltas), "delta_std": math.sqrt(sum((d - mean) ** 2 for d in deltas) / len(deltas)), "branching": branching,
    }
    for name, (all_of, early) in families.items():
        out |= {f"{name}_plogp": plog(all_of), f"{name}_early_plogp": plog(early), f"{name}_is_early": len(set(early)),
                f"{name}_p2": sum((c / len(all_of)) ** 2 for c in Counter(all_of).values()), f"{name}_distinct": len(set(all_of))}
    return out


@pytest.mark.parametrize("hubs", [False, True])
def test_running_sums_equal_whole_sessions(hubs):
    rng = random.Random(3)
    attributes = {f"/p{i}": (rng.randrange(-1, 4), rng.randrange(0, 5), rng.random() < 0.3,
                             {str(h): rng.randrange(3) for h in rng.sample(range(6), 2)}, {str(h): rng.randrange(3) for h in rng.sample(range(6), 2)})
                  for i in range(300)}
    pages, stored, events, time = running.MemoryPages(), None, [], 100.0
    for at in range(900):
        # few pages at first, many later: the symbols outgrow their first pages
        path = f"/p{rng.randrange(5 if at < 60 else 300)}"
        depth, degree, leaf, out, into = attributes[path]
        time += rng.choice([-1.0, 0.0, 0.5, 3.0])
        events.append((time, path, f"c{rng.randrange(4)}", rng.choice([None, "a", "b"]), rng.choice([None, 200, 404]),
                       depth, degree, leaf, out if hubs else None, into if hubs else None))
        # every request by a new object, as in a batch of its own
        session = running.RunningSession(pages, json.loads(json.dumps(stored)) if stored else None)
        session.observe(*events[-1])
        row = dict(zip(running._FIELDS, session.row("s", path)))
        stored = session.flush()
        if at and (at < 40 or at % 50 == 0):
            for name, value in whole_session(events).items():
                assert row[name] == pytest.approx(value, abs=1e-9), (at, name)
    assert stored["pages"] > 8
    waiting = sum(len(page) for name, page in pages.items() if name.startswith("q"))
    assert waiting <= 450 + running.PAGE_REQUESTS


NODES = "path string, category string, depth int, out_degree long, is_leaf boolean"
REQUESTS = "session_id string, path string, timestamp double, user_agent string, op string, place long"


def write_batches(spark, folder, batches, schema):
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_reset_at_its_place_and_arrival_order(spark, tmp_path):
    nodes = spark.createDataFrame([("/", "home", 0, 1, False), ("/a", None, 1, 0, True)], NODES)
    # rows of a batch come in any order; a reset has no time; place 5 is earlier in time than place 4
    batches = [
        [("s", "/", 103.0, None, "event", 3), ("s", "", None, None, "reset", 2), ("s", "/", 100.0, "curl/8", "event", 0), ("s", "/a", 101.0, "curl/8", None, 1)],
        [("s", "/a", 110.0, None, "event", 4), ("s", "/", 90.0, None, "event", 5), ("t", "/x", 1.0, None, "event", 6)],
        [("s", "", None, None, "reset", 7)],
    ]
    stream = write_batches(spark, str(tmp_path / "in"), batches, REQUESTS)
    output, checkpoint = str(tmp_path / "out"), str(tmp_path / "state")
    start_scoring(stream, nodes, output, checkpoint, sequence="place", availableNow=True).awaitTermination()
    rows = {(r["session_id"], r["visit"], r["prefix_len"]): r["timestamp"] for r in spark.read.parquet(output).collect()}
    assert rows == {("s", 0, 1): 100.0, ("s", 0, 2): 101.0, ("s", 1, 1): 103.0, ("s", 1, 2): 110.0, ("s", 1, 3): 90.0, ("t", 0, 1): 1.0}
    assert [r["session_id"] for r in active_sessions(spark, checkpoint).collect()] == ["t"]


def test_sessions_expire_by_event_time(spark, tmp_path):
    nodes = spark.createDataFrame([("/", "home", 0, 1, False)], NODES)
    at = lambda session, time: (session, "/", 1000.0 + time, None, "event", int(time))
    # s rests 300 s while t moves the watermark on; u keeps its timer away
    batches = [[at("s", 0), at("u", 0)], [at("t", 200), at("u", 90)], [at("t", 280), at("u", 170)], [at("s", 300), at("u", 230)]]
    stream = write_batches(spark, str(tmp_path / "in"), batches, REQUESTS)
    output = str(tmp_path / "out")
    start_scoring(stream, nodes, output, str(tmp_path / "state"), expire_seconds=100, lateness="60 seconds",
                  availableNow=True).awaitTermination()
    rows = sorted((r["session_id"], r["timestamp"], r["started"], r["prefix_len"]) for r in spark.read.parquet(output).collect())
    assert [r for r in rows if r[0] == "s"] == [("s", 1000.0, 1000.0, 1), ("s", 1300.0, 1300.0, 1)]
    assert [r[3] for r in rows if r[0] == "t"] == [1, 2]
    # no gap of u reaches 100 s
    assert [r[1:] for r in rows if r[0] == "u"] == [(1000.0, 1000.0, 1), (1090.0, 1000.0, 2), (1170.0, 1000.0, 3), (1230.0, 1000.0, 4)]


def test_late_rows_go_to_their_own_table(spark, tmp_path):
    schema = "id int, timestamp double"
    batches = [[(1, 100.0), (2, 500.0)], [(3, 300.0), (4, 450.0), (5, None)], [(6, 399.0), (7, 400.0), (8, 900.0)]]
    stream = write_batches(spark, str(tmp_path / "in"), batches, schema)
    on_time, late = str(tmp_path / "on"), str(tmp_path / "late")
    start_late_split(stream, on_time, late, str(tmp_path / "state"), 100.0, availableNow=True).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(on_time).collect()) == [1, 2, 4, 5, 7, 8]
    assert sorted((r["id"], r["watermark"]) for r in spark.read.parquet(late).collect()) == [(3, 400.0), (6, 400.0)]


def test_bundles_swap_between_batches(spark, tmp_path):
    def bundle(flip):
        rows = [(f"s{i}", 2, "bot" if (i % 2 == 0) != flip else "human", *[float(i % 2)] * len(FEATURE_COLUMNS)) for i in range(20)]
        frame = spark.createDataFrame(rows, ["session_id", "prefix_len", "label", *FEATURE_COLUMNS])
        return ModelBundle("logistic_regression", list(FEATURE_COLUMNS), fit_logistic_regression(frame, list(FEATURE_COLUMNS)))

    folder, nodes = str(tmp_path / "bundles"), spark.createDataFrame([("/", "home", 0, 1, False)], NODES)
    bundle(False).save(f"{folder}/v1")
    batches = [[("s", "/", 1.0, None, "event", 1), ("s", "/a", 2.0, None, "event", 2)]]
    stream = write_batches(spark, str(tmp_path / "in"), batches, REQUESTS)
    output, state = str(tmp_path / "out"), str(tmp_path / "state")
    scorer = BundleScorer(folder)
    start_scoring(stream, nodes, output, state, scorer=scorer, availableNow=True).awaitTermination()
    bundle(True).save(f"{folder}/v2")
    write_batches(spark, str(tmp_path / "in"), [[("s", "/b", 3.0, None, "event", 3)]], REQUESTS)
    start_scoring(stream, nodes, output, state, scorer=scorer, availableNow=True).awaitTermination()
    rows = {r["prefix_len"]: r for r in spark.read.parquet(output).collect()}
    assert [rows[k]["model_version"] for k in (1, 2, 3)] == [None, "v1", "v2"]
    assert rows[1]["bot_probability"] is None and 0 <= rows[2]["bot_probability"] <= 1 and rows[3]["ready"]
