"""The forest query: rows keep their tree nodes between levels, and only the tables it reads are made."""

import random

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier

from catalog import modelling
from clickwarden.operators.models import _assembler, fit_random_forest, weighted_training_rows


def test_rows_keep_their_nodes_and_the_forest_stays(spark):
    draw = random.Random(2)
    columns = [f"x{i}" for i in range(6)]
    rows = spark.createDataFrame(
        [("bot" if draw.random() < 0.4 else "human", *[draw.gauss(0, 1) for _ in columns]) for _ in range(400)], ["label", *columns]
    ).coalesce(1).cache()
    forest = fit_random_forest(rows, columns, trees=4).pipeline.stages[-1]
    assert forest.getOrDefault("cacheNodeIds")
    plain = RandomForestClassifier(
        labelCol="target", weightCol="weight", numTrees=4, minInstancesPerNode=2, maxDepth=30, minWeightFractionPerNode=0.0, seed=42)
    other = Pipeline(stages=[_assembler(columns), plain]).fit(weighted_training_rows(rows)[0]).stages[-1]
    trees = lambda model: model.toDebugString.split("\n")[1:]
    assert trees(forest) == trees(other) and forest.totalNumNodes > 100


def test_models_make_no_whole_metadata(spark, monkeypatch):
    written, write = [], modelling.materialized
    monkeypatch.setattr(modelling, "materialized", lambda df: written.append(df.columns) or write(df))
    data = modelling.split_data(spark, "/root/testdata/sf0.001")
    assert not any("ua_family" in columns for columns in written)
    whole = modelling.split_data(spark, "/root/testdata/sf0.001", with_metadata=True)
    for part in ("prefix", "full", "metadata"):
        key = lambda d: sorted((r["session_id"], r["split"], r["label"]) for r in getattr(d, part).collect())
        assert key(data) == key(whole) and key(data)
