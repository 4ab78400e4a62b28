"""Tasks of the feature tables hold a bounded number of events, whatever pages the events visit."""

import random
import re

import pytest

from clickwarden.constants import FEATURE_COLUMNS
from clickwarden.operators import features as feats
from clickwarden.operators.graph import graph_edges, graph_nodes
from clickwarden.operators.sessionize import sessionize


@pytest.fixture(scope="module")
def events(spark):
    draw, rows = random.Random(5), []
    for client in range(40):
        for step in range(draw.randint(2, 30)):
            # the root is half of all visits
            path = "/" if draw.random() < 0.5 else f"/p/{draw.randint(0, 30)}"
            rows.append((f"c{client}", 10.0 * step, path, 200, "x"))
    return sessionize(spark.createDataFrame(rows, "client_key string, timestamp double, path string, status_code int, user_agent string")).cache()


def tables(events):
    nodes = graph_nodes(graph_edges(events))
    return feats.full_session_features(events, nodes), feats.prefix_features(events, nodes, [3, 5, 10])


def test_events_do_not_gather_by_page(events):
    for table in tables(events):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and not re.search(r"hashpartitioning\(path#\d+, \d+\)", plan)


def test_large_tables_and_sites_give_the_same_features(events, monkeypatch):
    rows = lambda: [{(r["session_id"], r["prefix_len"]): r for r in t.collect()} for t in tables(events)]
    plain = rows()
    # some pages are busy, some are not; more tasks than cores
    monkeypatch.setattr(feats, "MAX_BROADCAST_PAGES", 20)
    monkeypatch.setattr(feats, "EVENTS_PER_TASK", 20)
    for table in tables(events):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" in plan and re.search(r"RepartitionByExpression \[session_id#\d+\], \d\d", plan)
    dealt = rows()
    monkeypatch.setattr(feats, "LONG_SESSION_EVENTS", 8)
    for other in (dealt, rows()):
        for want, got in zip(plain, other):
            assert want.keys() == got.keys() and want
            for key, row in want.items():
                assert [got[key][c] for c in FEATURE_COLUMNS] == pytest.approx([row[c] for c in FEATURE_COLUMNS])
