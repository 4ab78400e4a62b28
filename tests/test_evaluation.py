"""Metrics, thresholds, splits, audits, models and streaming on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from clickwarden.operators import audits, evaluation as ev, splits
from clickwarden.operators.models import ModelBundle, fit_logistic_regression, select_models
from clickwarden.operators.scoring import decide
from clickwarden.streaming.scorer import active_sessions, start_scoring

SCHEMA = "session_id string, prefix_len int, label string, bot_probability double"


def scored(spark, labels, scores):
    rows = [(f"s{i}", 3, "bot" if y else "human", s) for i, (y, s) in enumerate(zip(labels, scores))]
    return spark.createDataFrame(rows, SCHEMA)


def test_perfect_scores(spark):
    rows = decide(scored(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]), F.lit(0.5))
    metrics = ev.metrics_by_group(rows).head()
    assert metrics["f1"] == 1 and metrics["pr_auc"] == 1 and metrics["roc_auc"] == 1


def test_threshold_between_the_classes(spark):
    tuned = ev.tune_thresholds(scored(spark, [0, 0, 1, 1], [0.2, 0.4, 0.6, 0.9])).head()
    assert 0.4 <= tuned["threshold"] <= 0.6 and tuned["f1"] == 1


def test_small_and_one_class_groups_use_the_default(spark):
    assert ev.tune_thresholds(scored(spark, [0, 1, 1], [0.2, 0.4, 0.6]), default=0.7).head()["threshold"] == 0.7
    assert ev.tune_thresholds(scored(spark, [1, 1, 1, 1], [0.2, 0.4, 0.6, 0.7]), default=0.7).head()["threshold"] == 0.7
    assert ev.metrics_by_group(decide(scored(spark, [1, 1], [0.2, 0.9]), F.lit(0.5))).head()["roc_auc"] is None


def test_curves_against_all_pairs(spark):
    random.seed(1)
    labels = [random.random() < 0.4 for _ in range(300)]
    scores = [round(random.random() * (0.7 + 0.3 * y), 2) for y in labels]
    got = ev.curve_metrics(ev.score_counts(scored(spark, labels, scores), ["prefix_len"]), ["prefix_len"]).head()
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert got["roc_auc"] == pytest.approx(wins / len(pos) / len(neg))
    steps, last = 0.0, 0
    for t in sorted(set(scores), reverse=True):
        tp, fp = sum(s >= t for s in pos), sum(s >= t for s in neg)
        steps += (tp - last) / len(pos) * tp / (tp + fp)
        last = tp
    assert got["pr_auc"] == pytest.approx(steps)
    flipped = ev.roc_auc(scored(spark, labels, [-s for s in scores])).head()["roc_auc"]
    assert flipped == pytest.approx(1 - got["roc_auc"])


def test_bootstrap_interval(spark):
    rows = decide(scored(spark, [i % 2 for i in range(60)], [0.3 + 0.4 * (i % 2) * (i % 3 > 0) for i in range(60)]), F.lit(0.5))
    for row in ev.bootstrap_intervals(rows, n_bootstrap=40).collect():
        assert 0 <= row["ci_low"] <= row["point_estimate"] + 0.2 and row["ci_low"] <= row["ci_high"] <= 1
        assert row["n_bootstrap"] > 0


def test_bootstrap_equals_replicates_one_by_one(spark, monkeypatch):
    """Few rows a chunk and many partitions against plain weighted metrics of each replicate."""
    import numpy as np

    from clickwarden.operators import bootstrap

    monkeypatch.setattr(bootstrap, "PARTITION_ROWS", 20)
    monkeypatch.setattr(bootstrap, "CHUNK_ROWS", 7)
    rng = random.Random(4)
    rows = [(f"s{i % 90}", p, rng.choice(["bot", "human"]) if p < 9 else "bot", rng.choice([0.0, -0.0, 0.5, rng.random()]))
            for p in (3, 5, 9) for i in range(130)]
    frame = decide(spark.createDataFrame(rows, "session_id string, prefix_len int, label string, bot_probability double"), F.lit(0.4))
    got = {(r["prefix_len"], r["metric"]): r for r in ev.bootstrap_intervals(frame, n_bootstrap=30, metrics=list(bootstrap.METRICS)).collect()}
    values = {}
    for p in (3, 5, 9):
        mine = [r for r in rows if r[1] == p]
        weights = bootstrap.replicate_weights([r[0] for r in mine], 30)
        bot, score = np.array([r[2] == "bot" for r in mine]), np.array([r[3] for r in mine])
        for w in weights.T:
            pos, neg, hit, false = (float(w[m].sum()) for m in (bot, ~bot, bot & (score >= 0.4), ~bot & (score >= 0.4)))
            values.setdefault((p, "accuracy"), []).append((hit + neg - false) / (pos + neg))
            values.setdefault((p, "precision"), []).append(hit / (hit + false) if hit + false else 0.0)
            values.setdefault((p, "recall"), []).append(hit / pos if pos else 0.0)
            values.setdefault((p, "f1"), []).append(2 * hit / (hit + false + pos) if hit + false + pos else 0.0)
            if pos and neg:
                wins = sum(w[i] * w[~bot & (score < score[i])].sum() + 0.5 * w[i] * w[~bot & (score == score[i])].sum() for i in np.flatnonzero(bot))
                steps = sum(w[i] * w[bot & (score >= score[i])].sum() / max(1, w[score >= score[i]].sum()) for i in np.flatnonzero(bot))
                values.setdefault((p, "roc_auc"), []).append(wins / (pos * neg))
                values.setdefault((p, "pr_auc"), []).append(steps / pos)
    assert len(got) == 18
    for key, row in got.items():
        kept = values.get(key, [])
        assert row["n_bootstrap"] == len(kept)
        if kept:
            assert [row["ci_low"], row["ci_high"]] == pytest.approx(np.quantile(kept, [0.025, 0.975]).tolist(), abs=1e-9)
        else:
            assert row["ci_low"] is None and key[1] in ("roc_auc", "pr_auc")


def test_only_bots_are_detected(spark):
    delay = {r["label"]: r for r in ev.detection_delay(decide(scored(spark, [0, 1, 1], [0.9, 0.9, 0.1]), F.lit(0.5))).collect()}
    assert delay["human"]["detection_rate"] == 0 and delay["human"]["mean_first_detected_prefix"] is None
    assert delay["bot"]["detection_rate"] == 0.5 and delay["bot"]["mean_first_detected_prefix"] == 3


def greedy(sizes, shares):
    total = sum(sizes)
    counts = {n: 0 for n, _ in shares}
    desired = {n: total * s for n, s in shares}
    for size in sorted(sizes, reverse=True):
        name = max(desired, key=lambda n: (desired[n] - counts[n], -counts[n]))
        counts[name] += size
    return counts


@pytest.mark.parametrize("seed", range(6))
def test_greedy_split_in_bulk(seed):
    random.seed(seed)
    sizes = [random.choice([1, 1, 1, 2, 3, 7, 40]) for _ in range(random.randint(1, 900))] + [1] * random.randint(0, 2000)
    shares = splits.SPLIT_SHARES
    deficit, placed = {n: sum(sizes) * s for n, s in shares}, {n: 0 for n, _ in shares}
    for size in sorted(set(sizes), reverse=True):
        given = splits._greedy_counts(deficit, placed, size, sizes.count(size))
        assert sum(given.values()) == sizes.count(size)
    assert placed == greedy(sizes, shares)


@pytest.fixture(scope="module")
def metadata(spark):
    rows = [
        (f"s{i:03d}", "bot" if i % 3 else "human", f"g{i % 40}" if i % 5 else None, f"p{i % 7}" if not i % 3 else None,
         ["bfs", "dfs", "linear"][i % 4 % 3] if i % 3 else "human", float(i * 31 % 200), f"sess-{i}")
        for i in range(200)
    ]
    return spark.createDataFrame(
        rows, "session_id string, label string, path_signature string, participant_id string, bot_family string, start_timestamp double, client_key string").cache()


def test_splits_are_disjoint_and_complete(spark, metadata):
    for table in (
        splits.grouped_split(metadata), splits.stratified_split(metadata), splits.bucket_split(metadata),
        splits.time_split(metadata), splits.train_test_split(metadata),
        splits.holdout_split(splits.holdout_base(metadata, "bot_family"), "bfs"),
    ):
        assert table.count() == table.select("session_id").distinct().count() == 200


def test_groups_stay_together(spark, metadata):
    joined = metadata.join(splits.grouped_split(metadata), "session_id")
    assert joined.groupBy("label", "path_signature").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_holdout_moves_only_the_held_out(spark, metadata):
    base = splits.holdout_base(metadata, "participant_id")
    rows = metadata.join(splits.holdout_split(base, "p0"), "session_id").collect()
    held = [r for r in rows if r["participant_id"] == "p0"]
    assert held and {r["split"] for r in held} == {"test"}
    assert {r["split"] for r in rows if r["label"] == "human" and r["participant_id"] != "p0"} == {"train", "val"}
    sizes = splits.holdout_sizes(base, splits.participant_holdouts(metadata))
    for row in sizes.where("held_out = 'p0'").collect():
        assert row["num_sessions"] == sum(r["split"] == row["split"] for r in rows)


def test_leakage_audit_finds_shared_values(spark, metadata):
    audit = audits.leakage_audit(metadata, splits.train_test_split(metadata)).collect()
    found = {(r["split_pair"], r["key"]): r for r in audit}
    assert found["train_vs_test", "session_id"]["shared_count"] == 0
    assert found["train_vs_test", "path_signature"]["shared_count"] > 0
    assert len(found["train_vs_test", "path_signature"]["examples"].split("; ")) <= 5


def test_model_bundle_roundtrip(spark, tmp_path):
    random.seed(5)
    rows = [(f"s{i}", 3, "bot" if i % 2 else "human", (i % 2) + random.gauss(0, 0.3), random.random()) for i in range(200)]
    frame = spark.createDataFrame(rows, "session_id string, prefix_len int, label string, a double, b double")
    bundle = ModelBundle("lr", ["a", "b"], fit_logistic_regression(frame, ["a", "b"]), 0.5)
    bundle.save(str(tmp_path / "bundle"))
    loaded = ModelBundle.load(spark, str(tmp_path / "bundle"))
    predicted = {r["session_id"]: r for r in loaded.predict(frame).collect()}
    before = {r["session_id"]: r for r in bundle.predict(frame).collect()}
    assert predicted == before
    right = sum(predicted[r[0]]["predicted_label"] == r[2] for r in rows)
    assert right > 180
    with pytest.raises(ValueError):
        select_models(["nothing"])


def test_online_scorer_and_reset(spark, tmp_path):
    nodes = spark.createDataFrame([("/", 0, 1, False), ("/a", 1, 0, True)], "path string, depth int, out_degree long, is_leaf boolean")
    schema = "session_id string, path string, timestamp double, user_agent string, op string"
    folder = str(tmp_path / "in")
    batches = [
        [("s", "/", 100.0, "curl/8", "event"), ("t", "/", 100.0, None, "event")],
        [("s", "/a", 101.0, "curl/8", "event")],
        [("s", "", 102.0, None, "reset"), ("s", "/", 103.0, None, "event")],
        [("t", "", 104.0, None, "reset")],
    ]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    output, checkpoint = str(tmp_path / "out"), str(tmp_path / "state")
    start_scoring(stream, nodes, output, checkpoint, availableNow=True).awaitTermination()
    rows = {(r["session_id"], r["visit"], r["prefix_len"]): r for r in spark.read.parquet(output).collect()}
    assert set(rows) == {("s", 0, 1), ("t", 0, 1), ("s", 0, 2), ("s", 1, 1)}
    assert not rows["s", 0, 1]["ready"] and rows["s", 0, 1]["bot_probability"] is None
    assert rows["s", 0, 2]["ready"] and 0 <= rows["s", 0, 2]["bot_probability"] <= 1
    assert [r["session_id"] for r in active_sessions(spark, checkpoint).collect()] == ["s"]


def test_few_families_are_folds_of_their_own_and_many_are_dealt_by_size(spark):
    from clickwarden.operators.splits import balanced_folds, in_folds

    sizes = {"a": 9, "b": 7, "c": 5, "d": 4, "e": 1}
    rows = [(f"{f}{i}", "bot", f) for f, n in sizes.items() for i in range(n)] + [("h", "human", "human"), ("x", "bot", None), ("y", "bot", " ")]
    meta = spark.createDataFrame(rows, "session_id string, label string, bot_family string")
    alone = {r.value: (r.sessions, r.fold) for r in balanced_folds(meta, "bot_family", 5).collect()}
    assert alone == {f: (n, f) for f, n in sizes.items()}
    dealt = {r.value: r.fold for r in balanced_folds(meta, "bot_family", 2).collect()}
    assert dealt == {"a": "fold_00", "b": "fold_01", "c": "fold_01", "d": "fold_00", "e": "fold_00"}
    placed = {r.session_id: r.bot_family for r in in_folds(meta, "bot_family", 2).collect()}
    assert len(placed) == len(rows) and placed["c3"] == "fold_01"
    assert (placed["h"], placed["x"], placed["y"]) == ("human", None, " ")
    assert balanced_folds(meta.limit(0), "bot_family", 3).count() == 0


def test_running_counts_over_ranges_of_scores(spark):
    rows = [("a", i * 11 % 301 / 301.0, 1 + i % 2, i % 3) for i in range(301)] + [("b", 0.5, 2, 1), ("c", -1.0, 0, 4), ("c", 2.0, 3, 0)]
    counts = spark.createDataFrame(rows, "g string, score double, pos long, neg long")
    want = {
        (g, score): (
            sum(p for h, s, p, _ in rows if h == g and s < score), sum(n for h, s, _, n in rows if h == g and s < score),
            sum(p for h, _, p, _ in rows if h == g), sum(n for h, _, _, n in rows if h == g))
        for g, score, _, _ in rows
    }
    for range_scores in (1, 10, 100, 10_000):
        found = ev.running_counts(counts, ["g"], range_scores).collect()
        assert len(found) == len(rows)
        got = {(r["g"], r["score"]): (r["pos_below"], r["neg_below"], r["pos_total"], r["neg_total"]) for r in found}
        assert got == want
    assert ev.running_counts(counts.limit(0), ["g"]).isEmpty()
