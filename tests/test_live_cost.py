"""What a short session costs the live scorer, and what its packed rows hold."""

from clickwarden.streaming.scorer import running_sums, start_scoring

REQUESTS = "session_id string, path string, timestamp double, user_agent string, status_code int"
NODES = "path string, category string, depth int, out_degree long, is_leaf boolean"


def test_short_sessions_cost_milliseconds(spark, tmp_path):
    sessions = 3_000
    rows = [(f"s{i}", f"/{i % 7}/{step}", 10.0 * step, 'a "quoted" agent', 200) for i in range(sessions) for step in range(3)]
    spark.createDataFrame(rows, REQUESTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    nodes = spark.createDataFrame([("/", "home", 0, 1, False)], NODES)
    stream = spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "in"))
    output = str(tmp_path / "out")
    query = start_scoring(stream, nodes, output, str(tmp_path / "state"), availableNow=True)
    query.awaitTermination()
    held = spark.read.parquet(output)
    assert held.count() == 3 * sessions and held.where("prefix_len = 3 and bot_probability is not null").count() == sessions
    # one Arrow batch and a few calls to the store a session, whatever the number of sums
    spent = sum(p["stateOperators"][0]["allUpdatesTimeMs"] for p in query.recentProgress if p["stateOperators"])
    assert spent / sessions < 8, spent


def test_packed_requests_keep_odd_values(spark, tmp_path):
    rows = [("s", "/a\"b\n,", 0.1 + 0.2, None, None), ("s", "", float("1e-7"), 'q"\\', 500)]
    spark.createDataFrame(rows, REQUESTS).write.parquet(str(tmp_path / "in"))
    nodes = spark.createDataFrame([("/", "home", 0, 1, False)], NODES)
    stream = spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "in"))
    seen = []
    from clickwarden.streaming import scorer
    before = spark.conf.get(scorer._STATE_PROVIDER, None)
    spark.conf.set(scorer._STATE_PROVIDER, scorer._ROCKSDB)
    try:
        running_sums(stream, nodes).writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option(
            "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(scorer._STATE_PROVIDER, before) if before else spark.conf.unset(scorer._STATE_PROVIDER)
    first, second = sorted(seen, key=lambda r: r["prefix_len"])
    assert (first["timestamp"], first["path"], first["first_agent"], first["errors"]) == (1e-7, "", 'q"\\', 1)
    assert (second["timestamp"], second["path"], second["delta_sum"]) == (0.1 + 0.2, "/a\"b\n,", 0.1 + 0.2 - 1e-7)
    assert first["delta_std"] is None and second["statuses"] == 1
