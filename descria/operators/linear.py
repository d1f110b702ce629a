"""Linear and logistic fits whose penalties mean what the usual textbook objectives say.

Objectives (n rows, s_y the label's standard deviation):

* least squares:   1/(2n) |y - Xw|^2 + L1 |w|_1 + L2/2 |w|^2
* logistic:        C * sum(log-loss) + penalty(w)

Spark scales the label internally, which leaves an L1 strength unchanged and
divides an L2 strength by s_y; :func:`elastic_net_params` undoes that. With
``scaled=True`` the penalty acts on coefficients of standardised columns
(population standard deviation), without a scaling stage in the data path.

Up to 4096 features the normal-equation solver needs a single pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descria.columns import quoted

# Largest feature count the single-pass solver accepts (fixed by Spark).
NORMAL_MAX = 4096
VECTOR = "features_vec"


def assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=VECTOR, handleInvalid="error")


def row_count(df: DataFrame) -> int:
    return df.select(F.count(F.lit(1))).first()[0]


def label_std(df: DataFrame, target: str, solver: str) -> float:
    """Label scale as the chosen solver computes it."""
    spread = F.stddev_pop if solver == "normal" else F.stddev_samp
    return df.select(spread(quoted(target).cast("double"))).first()[0] or 0.0


def elastic_net_params(l1: float, l2: float, s_y: float) -> tuple[float, float]:
    """``(regParam, elasticNetParam)`` that realise the strengths ``l1`` and ``l2``."""
    total = l1 + l2 * s_y
    return (total, l1 / total) if total > 0 else (0.0, 0.0)


def least_squares(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    l1: float = 0.0,
    l2: float = 0.0,
    scaled: bool = False,
    max_iter: int = 1000,
    tol: float = 1e-9,
) -> LinearRegression:
    """Configured estimator for the objective above (not fitted)."""
    solver = "normal" if len(features) <= NORMAL_MAX else "l-bfgs"
    s_y = label_std(df, target, solver) if l2 > 0 else 1.0
    if solver == "l-bfgs" and scaled and (l1 > 0 or l2 > 0) and (n := row_count(df)) > 1:
        # This solver standardises by the sample deviation.
        l1, l2 = l1 * math.sqrt((n - 1) / n), l2 * (n - 1) / n
    reg, mix = elastic_net_params(l1, l2, s_y)
    return LinearRegression(
        featuresCol=VECTOR,
        labelCol=target,
        solver=solver,
        regParam=reg,
        elasticNetParam=mix,
        standardization=scaled,
        maxIter=max_iter,
        tol=tol,
    )


def fit_least_squares(df: DataFrame, features: Sequence[str], target: str, **params) -> PipelineModel:
    """Assembler plus fitted least-squares model, ready to save and to score."""
    data = df.select(*[quoted(c) for c in features], quoted(target).cast("double").alias(target))
    return Pipeline(stages=[assembler(features), least_squares(data, features, target, **params)]).fit(data)


def logistic(
    n: int,
    target: str,
    c: float = 1.0,
    penalty: str = "l2",
    scaled: bool = False,
    max_iter: int = 1000,
    tol: float = 1e-8,
) -> LogisticRegression:
    """Logistic regression with inverse strength ``c`` over ``n`` rows (not fitted).

    Spark standardises by the sample deviation; the factor ``(n - 1) / n`` turns the
    penalty into one on population-scaled coefficients.
    """
    reg = 1.0 / (c * n)
    if scaled and n > 1:
        reg *= (n - 1) / n if penalty == "l2" else math.sqrt((n - 1) / n)
    return LogisticRegression(
        featuresCol=VECTOR,
        labelCol=target,
        regParam=reg,
        elasticNetParam=1.0 if penalty == "l1" else 0.0,
        standardization=scaled,
        maxIter=max_iter,
        tol=tol,
    )


def linear_svm(n: int, target: str, c: float = 1.0, scaled: bool = True) -> LinearSVC:
    """Linear-kernel support vector classifier with inverse strength ``c``."""
    reg = 1.0 / (c * n) * ((n - 1) / n if scaled and n > 1 else 1.0)
    return LinearSVC(featuresCol=VECTOR, labelCol=target, regParam=reg, standardization=scaled, maxIter=200, tol=1e-7)
