"""Features and graph against direct computation on small sessions."""

import math
import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from clickwarden.constants import FEATURE_COLUMNS
from clickwarden.operators import features as feats
from clickwarden.operators.graph import (
    bfs_depths, graph_edges, graph_nodes, hop_distances, hub_labels, read_edges, transitions, with_hub_labels,
)
from clickwarden.operators.ranking import with_global_row_number
from clickwarden.operators.sessionize import sessionize


@pytest.fixture(scope="module")
def events(spark):
    random.seed(7)
    rows, time = [], 0.0
    for client in range(12):
        for _ in range(random.randint(2, 24)):
            time += random.choice([0.5, 2.0, 30.0])
            path = random.choice(["/", "/a/1", "/a/2", "/b/1", "/b/2", "/c"])
            rows.append((f"c{client}", time, path, random.choice([200, 404, None]), random.choice(["x", "y", None])))
        time += 10_000
    schema = "client_key string, timestamp double, path string, status_code int, user_agent string"
    return sessionize(spark.createDataFrame(rows, schema)).cache()


def entropy(items):
    total = len(items)
    return -sum(c / total * math.log2(c / total) for c in Counter(items).values()) + 0.0


def normalized(items):
    kinds = len(set(items))
    return entropy(items) / math.log2(kinds) if kinds > 1 else 0.0


def test_full_session_features_match_direct_computation(spark, events):
    nodes = graph_nodes(graph_edges(events)).cache()
    degree = {r["path"]: r["out_degree"] for r in nodes.collect()}
    got = {r["session_id"]: r for r in feats.full_session_features(events, nodes).collect()}
    sessions = {}
    for row in sorted(events.collect(), key=lambda r: (r["session_id"], r["seq"])):
        sessions.setdefault(row["session_id"], []).append(row)
    assert set(got) == set(sessions)
    for session, rows in sessions.items():
        paths = [r["path"] for r in rows]
        steps = list(zip(paths, paths[1:]))
        half = max(2, len(paths) // 2)
        feature = got[session]
        assert feature["unique_nodes"] == len(set(paths))
        assert feature["node_entropy"] == pytest.approx(entropy(paths))
        assert feature["normalized_transition_entropy"] == pytest.approx(normalized(steps))
        assert feature["transition_entropy_delta"] == pytest.approx(entropy(steps) - entropy(steps[: half - 1]))
        assert feature["backtrack_count"] == sum(a == b for a, b in zip(paths, paths[2:]))
        agents = [r["user_agent"] for r in rows if r["user_agent"]]
        switches = sum(a != b for a, b in zip(agents, agents[1:]))
        assert feature["user_agent_switch_rate"] == pytest.approx(switches / (len(agents) - 1) if len(agents) > 1 else 0.0)
        scores = []
        for source in dict.fromkeys(s for s, _ in steps):
            chosen = [t for s, t in steps if s == source]
            support = degree[source] if degree[source] >= 2 else len(set(chosen))
            scores.append(entropy(chosen) / math.log2(support) if support > 1 else 0.0)
        assert feature["local_branching_entropy"] == pytest.approx(sum(scores) / len(scores))
        assert 0 <= feature["navigation_entropy_score"] <= 1 and 0 <= feature["navigation_entropy_score_v2"] <= 1


def test_long_sessions_are_spread_without_change(spark, events, monkeypatch):
    nodes = graph_nodes(graph_edges(events)).cache()
    rows = lambda: {r["session_id"]: r for r in feats.full_session_features(events, nodes).collect()}
    plain = rows()
    monkeypatch.setattr(feats, "LONG_SESSION_EVENTS", 3)
    spread = rows()
    for session, row in plain.items():
        for name in FEATURE_COLUMNS:
            assert spread[session][name] == pytest.approx(row[name])


def test_prefix_equal_to_length_is_the_full_session(spark, events):
    nodes = graph_nodes(graph_edges(events)).cache()
    full = {(r["session_id"], r["prefix_len"]): r for r in feats.full_session_features(events, nodes).collect()}
    prefix = feats.prefix_features(events, nodes, [2, 3, 5, 10, 15, 20]).collect()
    both = [r for r in prefix if (r["session_id"], r["prefix_len"]) in full]
    assert both
    for row in both:
        for name in FEATURE_COLUMNS:
            assert row[name] == pytest.approx(full[row["session_id"], row["prefix_len"]][name])


def distances(edges, source):
    reached, queue = {source: 0}, deque([source])
    while queue:
        node = queue.popleft()
        for a, b in edges:
            if a == node and b not in reached:
                reached[b] = reached[node] + 1
                queue.append(b)
    return reached


def test_depths_and_hops_against_search(spark):
    random.seed(3)
    names = ["/"] + [f"/{i}" for i in range(14)]
    edges = sorted({(random.choice(names), random.choice(names)) for _ in range(22)})
    frame = read_edges(spark.createDataFrame(edges, "source string, target string"))
    assert {r["path"]: r["depth"] for r in bfs_depths(frame).collect()} == distances(edges, "/")
    pairs = [(a, b) for a in names + ["/gone"] for b in names]
    got = {(r["source"], r["target"]): r["hops"] for r in hop_distances(spark.createDataFrame(pairs, "source string, target string"), frame).collect()}
    known = {n for e in edges for n in e}
    expected = {(a, b): 0 if a == b else distances(edges, a).get(b, 999) if a in known else 999 for a, b in pairs}
    assert got == expected


def test_hub_labels_hold_all_distances_and_stay_small(spark):
    # a ring around which most ways are long, a hub page that some link to, and a page apart
    ring = [(f"/r{i}", f"/r{(i + 1) % 24}") for i in range(24)]
    edges = ring + [(f"/r{i}", "/hub") for i in range(0, 24, 3)] + [("/hub", f"/r{i}") for i in range(0, 24, 4)] + [("/x", "/y"), ("/y", "/y")]
    frame = spark.createDataFrame(edges, "source string, target string")
    rows = hub_labels(frame).collect()
    names = sorted({n for e in edges for n in e})
    out = {(r["node"], r["hub"]): r["hops"] for r in rows if r["side"] == 0}
    into = {(r["node"], r["hub"]): r["hops"] for r in rows if r["side"] == 1}
    for a in names:
        for b in names:
            ways = [out[a, h] + into[b, h] for h in names if (a, h) in out and (b, h) in into]
            assert min(ways, default=999) == (0 if a == b else distances(edges, a).get(b, 999)), (a, b)
    assert all(r["hops"] == (0 if r["node"] == r["hub"] else distances(edges, *((r["node"],) if r["side"] == 0 else (r["hub"],)))[
        r["hub"] if r["side"] == 0 else r["node"]]) for r in rows)
    # far fewer than the pairs of pages that reach each other
    assert len(rows) < 0.5 * sum(len(distances(edges, a)) for a in names)
    nodes = with_hub_labels(graph_nodes(frame), hub_labels(frame))
    hub = nodes.where("path = '/hub'").head()
    assert hub["hubs_out"]["/hub"] == 0 and hub["hubs_in"]["/hub"] == 0
    assert nodes.where("path = '/'").head()["hubs_out"] == {}


def test_steps_of_the_sessions_are_one_hop(spark, events):
    hops = hop_distances(transitions(events), graph_edges(events)).collect()
    assert {r["hops"] for r in hops} <= {0, 1}


def test_global_row_numbers(spark):
    df = spark.range(1000).withColumn("key", F.pmod(F.col("id") * 7919, F.lit(10)))
    rows = with_global_row_number(df, [F.col("key"), F.col("id")], "n").collect()
    assert [r["n"] for r in sorted(rows, key=lambda r: (r["key"], r["id"]))] == list(range(1, 1001))
