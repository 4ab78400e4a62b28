"""Certificates of a fit: facts about rows and stored parameters that hold at the optimum alone.

A fitted model has no counterpart in SQL, but the conditions of its optimum have: they equate a sum
over the model's answers with a sum over the training rows. Each certificate is one aggregation
of the rows, by vectors where there are many features.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, LinearSVCModel, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..constants import BOT
from .models import CALIBRATION_FOLDS, FittedModel, calibration_fold, feature_coefficients, weighted_training_rows

INTERCEPT = "intercept"


def _weighted_sums(column: str, weight: Column) -> Column:
    """Sum of ``weight * vector`` as an array; NULL where all weights are zero."""
    mean = vector_to_array(Summarizer.mean(F.col(column), weight))
    return F.transform(mean, lambda x: x * F.sum(weight))


def logistic_moments(fitted: FittedModel, training: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both sides of the optimality condition of a penalised logistic regression, per coefficient.

    ``target_moment`` is the weighted mean of target times feature, ``model_moment`` that of
    probability times feature plus penalty times coefficient. Their difference, ``gradient``, is the
    partial derivative of the loss; the loss is strictly convex, so it is zero at the optimum only.
    Features are those after scaling, before their turn. Empty training rows raise, as in a fit.
    """
    model = next(s for s in fitted.pipeline.stages if isinstance(s, LogisticRegressionModel))
    rows, _ = weighted_training_rows(training)
    scored = fitted.pipeline.transform(rows).select(
        "features", "weight", (F.col("weight") * F.col("target")).alias("on_target"),
        (F.col("weight") * F.element_at(vector_to_array(F.col(model.getProbabilityCol())), 2)).alias("on_model"))
    sums = scored.agg(
        F.sum("weight").alias("w"), F.sum("on_target").alias("target_sum"), F.sum("on_model").alias("model_sum"),
        _weighted_sums("features", F.col("on_target")).alias("targets"),
        _weighted_sums("features", F.col("on_model")).alias("answers"))
    parameters = F.array(*[
        F.struct(F.lit(name).alias("feature"), F.lit(float(value)).alias("coefficient"))
        for name, value in zip(columns, feature_coefficients(fitted, model), strict=True)])
    penalty = F.lit(float(model.getRegParam()))
    per_feature = F.transform(parameters, lambda p, i: F.struct(
        p["feature"].alias("feature"), p["coefficient"].alias("coefficient"),
        (F.get("targets", i) / F.col("w")).alias("target_moment"),
        (F.get("answers", i) / F.col("w") + penalty * p["coefficient"]).alias("model_moment")))
    own = F.array(F.struct(
        F.lit(INTERCEPT).alias("feature"), F.lit(float(model.intercept)).alias("coefficient"),
        (F.col("target_sum") / F.col("w")).alias("target_moment"), (F.col("model_sum") / F.col("w")).alias("model_moment")))
    moments = sums.select(F.explode(F.concat(own, per_feature)).alias("m")).select("m.*")
    return moments.withColumn("gradient", F.col("model_moment") - F.col("target_moment"))


def sigmoid_moments(fitted: FittedModel, training: DataFrame) -> DataFrame:
    """Per calibration fold of an SVM: rows, bots and what its sigmoid expects.

    A sigmoid without penalty fitted on a fold expects as many bots as the fold has, and the same
    sum of margins over them.
    """
    rows = training.withColumns({"fold": calibration_fold(), "target": (F.col("label") == BOT).cast("double")})
    scored = fitted.pipeline.transform(rows)
    pick = lambda names: F.element_at(F.array(*names), (F.col("fold") + 1).cast("int"))
    chance = pick([F.element_at(vector_to_array(F.col(c)), 2) for c in fitted.probability_columns])
    margin = pick([F.element_at(vector_to_array(F.col(f"margin_{i}")), 2) for i in range(CALIBRATION_FOLDS)])
    own = scored.select("fold", "target", chance.alias("chance"), margin.alias("margin"))
    return own.groupBy("fold").agg(
        F.count("*").alias("num_rows"), F.sum("target").alias("bots"), F.sum("chance").alias("expected_bots"),
        F.sum(F.col("target") * F.col("margin")).alias("margins"),
        F.sum(F.col("chance") * F.col("margin")).alias("expected_margins"))


def svm_gaps(fitted: FittedModel, training: DataFrame, softness: float = 0.05) -> DataFrame:
    """Per calibration fold: the penalised hinge loss of its SVM and a lower bound of the least one.

    The bound is the dual value of one multiplier per row: its share of the weights where the margin
    is below one, nothing above, a linear passage ``softness`` to either side. Multipliers of the
    heavier class are scaled down until both classes balance, then all by the best common factor, so
    the bound is below every primal value whatever the model.
    """
    machines = [s for s in fitted.pipeline.stages if isinstance(s, LinearSVCModel)]
    rows, _ = weighted_training_rows(training)
    scored = fitted.pipeline.transform(rows.withColumn("fold", calibration_fold()))
    gaps = []
    for index, machine in enumerate(machines):
        side = F.lit(2.0) * F.col("target") - 1.0
        margin = side * F.element_at(vector_to_array(F.col(f"margin_{index}")), 2)
        share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1.0 + softness - margin) / (2.0 * softness)))
        held_in = scored.where(F.col("fold") != index).select(
            "features", "weight", F.greatest(F.lit(0.0), 1.0 - margin).alias("hinge"),
            F.when(side > 0, F.col("weight") * share).otherwise(0.0).alias("up"),
            F.when(side < 0, F.col("weight") * share).otherwise(0.0).alias("down"))
        sums = held_in.agg(
            F.count("*").alias("num_rows"), F.sum("weight").alias("w"),
            F.sum(F.col("weight") * F.col("hinge")).alias("hinges"), F.sum("up").alias("up_sum"), F.sum("down").alias("down_sum"),
            _weighted_sums("features", F.col("up")).alias("ups"), _weighted_sums("features", F.col("down")).alias("downs"))
        penalty = float(machine.getRegParam())
        norm = float(machine.coefficients.dot(machine.coefficients))
        lighter = F.least("up_sum", "down_sum")
        scaled = lambda name, total: F.transform(F.col(name), lambda x: x * lighter / F.col(total) / F.col("w"))
        pull = F.zip_with(scaled("ups", "up_sum"), scaled("downs", "down_sum"), lambda a, b: (a - b) * (a - b))
        square = F.coalesce(F.aggregate(pull, F.lit(0.0), lambda total, x: total + x), F.lit(0.0))
        mass = 2.0 * lighter / F.col("w")
        factor = F.when(square > 0, F.least(F.lit(1.0), penalty * mass / square)).otherwise(1.0)
        dual = factor * mass - factor * factor * square / (2.0 * penalty)
        gaps.append(sums.select(
            F.lit(index).alias("fold"), "num_rows",
            (F.col("hinges") / F.col("w") + 0.5 * penalty * norm).alias("primal"), dual.alias("dual")))
    return gaps[0].unionByName(gaps[1]).unionByName(gaps[2])


def first_tree_leaves(fitted: FittedModel, training: DataFrame) -> DataFrame:
    """Leaves of the first boosted tree with the training rows that fall into them.

    The first tree is fitted to the classes as -1 and 1 over all rows, so a leaf's stored answer is
    the mean class of its rows (``gradient`` is their difference).
    """
    model = next(s for s in fitted.pipeline.stages if isinstance(s, GBTClassificationModel))
    tree = model.trees[0].setLeafCol("leaf").setPredictionCol("answer")
    rows = training.withColumn("side", F.when(F.col("label") == BOT, 1.0).otherwise(-1.0))
    ready = rows
    for stage in fitted.pipeline.stages:
        if stage is not model:
            ready = stage.transform(ready)
    routed = tree.transform(ready).select(F.col("leaf").cast("int").alias("leaf"), "answer", "side")
    leaves = routed.groupBy("leaf").agg(
        F.count("*").alias("num_rows"), F.sum("side").alias("side_sum"), F.max("answer").alias("answer"))
    return leaves.withColumn("gradient", F.col("answer") - F.col("side_sum") / F.col("num_rows"))


def tree_balance(leaves: DataFrame) -> DataFrame:
    """The leaves in one row: rows, the sum of stored answers, and squares within and between leaves.

    Where every answer is the mean of its leaf, ``answer_sum`` is the sum of the classes and
    ``squares`` their total squared deviation.
    """
    n, answer = F.col("num_rows"), F.col("answer")
    sums = leaves.agg(
        F.sum(n).alias("num_rows"), F.sum(n * answer).alias("answer_sum"),
        F.sum(n - 2.0 * answer * F.col("side_sum") + n * answer * answer).alias("within"),
        F.sum(n * answer * answer).alias("answer_squares"))
    between = F.col("answer_squares") - F.col("answer_sum") * F.col("answer_sum") / F.col("num_rows")
    return sums.select("num_rows", "answer_sum", (F.col("within") + between).alias("squares"))
