"""Applying a fitted model to a table, and validating it on held-out rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descria.columns import quoted, require_columns
from descria.errors import DescriaError
from descria.operators import metrics

PREDICTION = "prediction_value"
CLASSIFICATION, REGRESSION = "classification", "regression"


def has_probability(model: PipelineModel) -> bool:
    return any(s.hasParam("probabilityCol") for s in model.stages)


def check_task(task: str) -> str:
    if task not in (CLASSIFICATION, REGRESSION):
        raise DescriaError(f"task must be {CLASSIFICATION!r} or {REGRESSION!r}, got {task!r}")
    return task


def score(model: PipelineModel, df: DataFrame, task: str) -> DataFrame:
    """``df`` plus ``prediction`` and ``prediction_value``.

    ``prediction_value`` is the probability of class 1 when the model has one, else
    the predicted label or value. A stateless row plan, so ``df`` may be a stream.
    """
    check_task(task)
    columns = list(df.columns)
    scored = model.transform(df)
    if task == CLASSIFICATION and has_probability(model):
        value = vector_to_array("probability")[1]
    else:
        value = F.col("prediction").cast("double")
    return scored.select(*[quoted(c) for c in columns], F.col("prediction"), value.alias(PREDICTION))


def threshold_condition(task: str, threshold: float, probabilities: bool = True, value: str = PREDICTION) -> Column:
    """Selection rule of a screening run.

    Class probabilities: ``>= threshold``. Class labels: ``== int(threshold)``.
    Values: ``<= threshold`` (lower is better).
    """
    if check_task(task) == REGRESSION:
        return F.col(value) <= F.lit(float(threshold))
    if probabilities:
        return F.col(value) >= F.lit(float(threshold))
    return F.col(value).cast("int") == F.lit(int(threshold))


def threshold_select(
    scored: DataFrame, task: str, threshold: float = 10.0, probabilities: bool = True, value: str = PREDICTION
) -> DataFrame:
    return scored.filter(threshold_condition(task, threshold, probabilities, value))


@dataclass(frozen=True)
class Validation:
    predictions: DataFrame
    metrics: DataFrame


def validate_cls(model: PipelineModel, held_out: DataFrame, features: Sequence[str], target: str) -> Validation:
    """Predictions and metrics of a classifier on held-out rows."""
    require_columns(held_out, [*features, target])
    scored = score(model, held_out.select(*[quoted(c) for c in [*features, target]]), CLASSIFICATION)
    probability = PREDICTION if has_probability(model) else None
    return Validation(
        metrics.predictions_cls(scored, target, "prediction", probability),
        metrics.metrics_cls(scored, target, "prediction", probability),
    )


def validate_reg(
    model: PipelineModel, held_out: DataFrame, features: Sequence[str], target: str | Sequence[str]
) -> Validation:
    """Predictions and metrics of a regressor; exactly one target column is allowed."""
    targets = [target] if isinstance(target, str) else list(target)
    if len(targets) != 1:
        raise DescriaError(f"expected exactly one target column, got {targets}")
    require_columns(held_out, [*features, *targets])
    scored = score(model, held_out.select(*[quoted(c) for c in [*features, *targets]]), REGRESSION)
    return Validation(
        metrics.predictions_reg(scored, targets[0], "prediction"),
        metrics.metrics_reg(scored, targets[0], "prediction"),
    )
