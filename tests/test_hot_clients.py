"""Slices of hot clients at quantiles of the whole order."""

import pytest
from pyspark.sql import functions as F

from clickwarden.operators.sessionize import _hot_keys, _with_slices, sessionize

COLUMNS = "client_key string, timestamp double, path string, id int, label string, user_agent string"


def _requests(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def _burst(i):
    # nearly all rows within a second, one an age before and one an age after
    moment = {0: 0.0, 599: 1e9}.get(i, 5e8 + i % 7 * 0.1)
    return ("hot", moment, f"/p{i % 13}", i, ["bot", None, "human"][i // 250], f"agent {i % 3}")


def _equal_times(i):
    return ("hot", 100.0, f"/p{i % 3}", i, None, None)


def _long_paths(i):
    return ("hot", 100.0, "/" + "x" * (60 + i % 9) + str(i % 2), i, None, None)


@pytest.mark.parametrize("make, most", [(_burst, 100), (_equal_times, 100), (_long_paths, 600)])
def test_slices_are_even_and_keep_the_order(spark, make, most):
    cool = [("cool", float(i), "/", 1000 + i, None, None) for i in range(20)]
    requests = _requests(spark, [make(i) for i in range(600)] + cool)
    order = ["timestamp", "path", "id"]
    hot, slices = _hot_keys(requests, "client_key", 50)
    assert [r["client_key"] for r in hot.collect()] == ["hot"] and slices == 12
    rows = _with_slices(requests, "client_key", hot, slices, order).collect()
    assert len(rows) == 620
    assert {r["_slice"] for r in rows if r["client_key"] == "cool"} == {None}
    own = sorted((r for r in rows if r["client_key"] == "hot"), key=lambda r: tuple(r[c] for c in order))
    places = [r["_slice"] for r in own]
    assert places == sorted(places)
    assert max(places.count(p) for p in set(places)) <= most
    assert len(set(places)) > 1


@pytest.mark.parametrize("make", [_burst, _equal_times, _long_paths])
def test_events_do_not_depend_on_the_slices(spark, make):
    requests = _requests(spark, [make(i) for i in range(600)] + [("cool", float(i), "/", 1000 + i, None, None) for i in range(20)])

    def run(hot_rows):
        events = sessionize(requests, timeout=1800.0, min_length=1, tie_breaker="id", hot_rows=hot_rows)
        return sorted(map(str, events.collect()))

    plain = run(None)
    for hot_rows in (7, 50, 300):
        assert run(hot_rows) == plain


def test_no_hot_client_and_no_row(spark):
    requests = _requests(spark, [_burst(i) for i in range(10)])
    assert _hot_keys(requests, "client_key", 10) is None
    assert _hot_keys(requests.where(F.lit(False)), "client_key", 10) is None
