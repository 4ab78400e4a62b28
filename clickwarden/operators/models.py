"""Classifiers on feature rows, built from Spark ML."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, OneHotEncoder, PCAModel, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.storagelevel import StorageLevel

from ..constants import BOT, HUMAN, STATIC_CATEGORICAL, STATIC_NUMERIC
from ..functions.values import double_or_zero
from ..session import ensure_checkpoint_dir
from .splits import hash_share

CALIBRATION_FOLDS = 3
# relative gain of a step at which a convex fit ends
FIT_TOLERANCE = 1e-12
# share of the largest variance below which a direction is rounding noise
NO_VARIANCE = 1e-13


@dataclass
class FittedModel:
    """A fitted pipeline; the bot probability is the mean of its probability columns."""

    pipeline: PipelineModel
    probability_columns: list[str] = field(default_factory=lambda: ["probability"])

    def score(self, rows: DataFrame, keep: Sequence[str] = ("session_id", "prefix_len", "label")) -> DataFrame:
        scored = self.pipeline.transform(rows)
        chances = [F.element_at(vector_to_array(F.col(c)), 2) for c in self.probability_columns]
        mean = sum(chances[1:], chances[0]) / float(len(chances))
        return scored.select(*keep, mean.alias("bot_probability"))


def weighted_training_rows(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows with the target and balanced class weights, and their number."""
    target = rows.withColumn("target", (F.col("label") == BOT).cast("double"))
    total, bots = target.agg(F.count("*"), F.sum("target")).head()
    bots = bots or 0.0
    if not 0 < bots < total:
        raise ValueError("training rows need both classes")
    weight = F.when(F.col("target") == 1.0, F.lit(total / (2.0 * bots))).otherwise(F.lit(total / (2.0 * (total - bots))))
    return target.withColumn("weight", weight), total


def _assembler(columns: Sequence[str], output: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid="error")


def _scaler() -> StandardScaler:
    return StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)


def _prepare(rows: DataFrame, columns: Sequence[str]) -> PipelineModel:
    """Scaled ``features`` and the same turned to their principal directions, ``rotated``.

    A turn leaves the penalty and so the optimum as they are. The directions are uncorrelated, and as the
    linear fits scale their columns inside, they need a tenth of the passes. Directions without variance hold no weight.
    """
    scaler = Pipeline(stages=[_assembler(columns, "raw_features"), _scaler()]).fit(rows)
    scaled = scaler.transform(rows)
    turn = lambda k: PCA(k=k, inputCol="features", outputCol="rotated").fit(scaled)
    rotation = turn(len(columns))
    shares = rotation.explainedVariance.toArray()
    kept = max(1, int((shares > NO_VARIANCE * shares.max(initial=0.0)).sum()))
    return PipelineModel([*scaler.stages, rotation if kept == len(columns) else turn(kept)])


def feature_coefficients(fitted: FittedModel, model) -> list[float]:
    """Weights of a linear stage on the scaled features before their turn."""
    rotation = next((s for s in fitted.pipeline.stages if isinstance(s, PCAModel)), None)
    weights = model.coefficients.toArray()
    return [float(w) for w in (weights if rotation is None else rotation.pc.toArray() @ weights)]


def _logistic(rows: int, **options) -> LogisticRegression:
    # the penalty of one unit per weight, over the mean loss
    return LogisticRegression(
        labelCol="target", weightCol="weight", maxIter=1000, tol=FIT_TOLERANCE, regParam=1.0 / rows, standardization=False, **options
    )


def fit_logistic_regression(rows: DataFrame, columns: Sequence[str], **_) -> FittedModel:
    training, total = weighted_training_rows(rows)
    prepare = _prepare(training, columns)
    ready = prepare.transform(training).select("rotated", "target", "weight")
    return FittedModel(PipelineModel([*prepare.stages, _logistic(total, featuresCol="rotated").fit(ready)]))


def fit_random_forest(rows: DataFrame, columns: Sequence[str], trees: int = 300, seed: int = 42, **_) -> FittedModel:
    training, _total = weighted_training_rows(rows)
    forest = RandomForestClassifier(
        labelCol="target", weightCol="weight", numTrees=trees, minInstancesPerNode=2, maxDepth=30,
        minWeightFractionPerNode=0.0, seed=seed, cacheNodeIds=True,  # rows keep their node: no walk down 30 levels at each level
    )
    ensure_checkpoint_dir(rows.sparkSession)
    return FittedModel(Pipeline(stages=[_assembler(columns), forest]).fit(training))


def fit_gradient_boosting(rows: DataFrame, columns: Sequence[str], rounds: int = 300, seed: int = 42, **_) -> FittedModel:
    training = rows.withColumn("target", (F.col("label") == BOT).cast("double"))
    boosting = GBTClassifier(labelCol="target", maxDepth=6, stepSize=0.06, maxIter=rounds, seed=seed)
    return FittedModel(Pipeline(stages=[_assembler(columns), boosting]).fit(training))


def calibration_fold() -> Column:
    """The fold of a session, whose sigmoid is fitted on it."""
    return F.floor(hash_share(F.col("session_id"), "fold") * CALIBRATION_FOLDS)


def fit_calibrated_svm(rows: DataFrame, columns: Sequence[str], iterations: int = 1000, **_) -> FittedModel:
    """Linear SVMs on two of three folds, each with a sigmoid fitted on the third."""
    training, total = weighted_training_rows(rows)
    training = training.withColumn("fold", calibration_fold())
    prepare = _prepare(training, columns)
    per_fold = {row["fold"]: row["n"] for row in training.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    ready = prepare.transform(training).select("rotated", "target", "weight", "fold").persist(StorageLevel.MEMORY_AND_DISK)

    def calibrated(index: int) -> list:
        machine = LinearSVC(
            labelCol="target", featuresCol="rotated", weightCol="weight", maxIter=iterations,
            regParam=1.0 / max(1, total - per_fold.get(index, 0)), standardization=False,
            rawPredictionCol=f"margin_{index}", predictionCol=f"side_{index}",
        ).fit(ready.where(F.col("fold") != index))
        held = machine.transform(ready.where(F.col("fold") == index))
        sigmoid = LogisticRegression(
            labelCol="target", featuresCol=f"margin_{index}", rawPredictionCol=f"logit_{index}",
            probabilityCol=f"probability_{index}", predictionCol=f"call_{index}", maxIter=iterations,
        ).fit(held)
        return [machine, sigmoid]

    # the passes of a fit are short jobs one after the other; the folds' jobs run side by side
    try:
        with ThreadPoolExecutor(CALIBRATION_FOLDS) as pool:
            fits = list(pool.map(calibrated, range(CALIBRATION_FOLDS)))
    finally:
        ready.unpersist()
    stages = [*prepare.stages, *(stage for fit in fits for stage in fit)]
    chances = [f"probability_{index}" for index in range(CALIBRATION_FOLDS)]
    return FittedModel(PipelineModel(stages), chances)


MODELS: dict[str, Callable[..., FittedModel]] = {
    "logistic_regression": fit_logistic_regression,
    "random_forest": fit_random_forest,
    "hist_gradient_boosting": fit_gradient_boosting,
    "calibrated_svm": fit_calibrated_svm,
}


def select_models(names: Iterable[str] | None = None) -> dict[str, Callable[..., FittedModel]]:
    chosen = [n.strip() for n in names] if names else list(MODELS)
    missing = [n for n in chosen if n not in MODELS]
    if missing:
        raise ValueError(f"unknown models {missing}; available: {sorted(MODELS)}")
    return {name: MODELS[name] for name in chosen}


def static_feature_rows(metadata: DataFrame) -> DataFrame:
    """First-request and header cues of each session."""
    numeric = [
        (double_or_zero(F.col(c)) if c in metadata.columns else F.lit(0.0)).alias(c) for c in STATIC_NUMERIC
    ]
    text = [
        (F.coalesce(F.col(c).cast("string"), F.lit("unknown")) if c in metadata.columns else F.lit("unknown")).alias(c)
        for c in STATIC_CATEGORICAL
    ]
    return metadata.select("session_id", "label", *numeric, *text)


def fit_static_baseline(metadata: DataFrame) -> FittedModel:
    """Logistic regression on static cues; values unseen in training encode to zeros."""
    training, total = weighted_training_rows(static_feature_rows(metadata))
    indexed = [f"{c}_index" for c in STATIC_CATEGORICAL]
    encoded = [f"{c}_vector" for c in STATIC_CATEGORICAL]
    stages = [
        StringIndexer(inputCols=STATIC_CATEGORICAL, outputCols=indexed, handleInvalid="keep"),
        OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
        _assembler([*STATIC_NUMERIC, *encoded]),
        _logistic(total),
    ]
    return FittedModel(Pipeline(stages=stages).fit(training))


@dataclass
class ModelBundle:
    """A fitted model with what is needed to use it."""

    model_name: str
    feature_columns: list[str]
    model: FittedModel
    threshold: float = 0.5
    positive_label: str = BOT
    negative_label: str = HUMAN

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        self.model.pipeline.write().overwrite().save(f"{path}/pipeline")
        described = {
            "model_name": self.model_name, "feature_columns": self.feature_columns, "threshold": self.threshold,
            "positive_label": self.positive_label, "negative_label": self.negative_label,
            "probability_columns": self.model.probability_columns,
        }
        spark.createDataFrame([(json.dumps(described),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/bundle")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ModelBundle":
        described = json.loads(spark.read.text(f"{path}/bundle").head()["value"])
        chances = described.pop("probability_columns")
        return cls(model=FittedModel(PipelineModel.load(f"{path}/pipeline"), chances), **described)

    def predict(self, rows: DataFrame, keep: Sequence[str] = ("session_id", "prefix_len")) -> DataFrame:
        label = F.when(F.col("bot_probability") >= self.threshold, self.positive_label).otherwise(self.negative_label)
        return self.model.score(rows, keep).withColumn("predicted_label", label)
