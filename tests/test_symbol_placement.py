"""Events of a prefix table travel once, before their symbols are made."""

from clickwarden.operators import features


def test_events_move_before_their_symbols(spark):
    rows = [("s", 2, 2, 1, "/a", "x", None, None, 3), ("s", 2, 2, 2, "/b", "x", "/a", "x", 0)]
    schema = ("session_id string, prefix_len int, n_events long, seq int, path string, page_category string, prev_path string, "
              "prev_category string, out_degree int")
    measures = features._symbol_measures(spark.createDataFrame(rows, schema), False, ["session_id"])
    plan = measures._jdf.queryExecution().optimizedPlan().toString()
    # parents come first in the text
    assert 0 <= plan.index("Generate explode") < plan.index("RepartitionByExpression")
    row = measures.head()
    assert (row["node_distinct"], row["trans_distinct"], row["cat_distinct"], row["cattrans_distinct"]) == (2, 1, 1, 1)
    assert row["node_plogp"] == -1.0 and row["left_pages"] == 1
