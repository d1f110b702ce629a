"""Feature scores from fitted models, as a ``(pos, feature, importance)`` table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    RandomForestClassifier,
)
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame

from descria.columns import quoted
from descria.errors import DescriaError, NotConvergedError
from descria.operators import forest, gram, logit
from descria.operators.linear import VECTOR, assembler
from descria.operators.normal import column_std, penalised_from_moments
from descria.storage import shared_dir

SEED = 42
# Spark's depth limit; stands for "unlimited".
UNLIMITED_DEPTH = 30
BOOSTED = ("XGBoost", "LightGBM", "GBT")
MODELS = ("Lasso", "RandomForest", "DecisionTree", *BOOSTED)


def depth(max_depth: int | None) -> int:
    """Spark's deepest tree for None and -1; a stated depth beyond it is refused, not cut."""
    if max_depth is not None and max_depth > UNLIMITED_DEPTH:
        raise DescriaError(f"trees are at most {UNLIMITED_DEPTH} deep, {max_depth} was asked for")
    return UNLIMITED_DEPTH if max_depth is None or max_depth < 0 else max_depth


def tree_estimator(
    kind: str,
    task: str,
    target: str,
    n_estimators: int = 100,
    max_depth: int | None = None,
    min_samples_leaf: int = 1,
    criterion: str = "gini",
    learning_rate: float = 0.1,
    subsample: float = 1.0,
    seed: int = SEED,
):
    """Spark tree estimator for the given kind; boosted kinds share one implementation."""
    common = {
        "featuresCol": VECTOR,
        "labelCol": target,
        "maxDepth": depth(max_depth),
        "minInstancesPerNode": min_samples_leaf,
        "seed": seed,
        # Rows keep the number of their node, so the trees grown so far don't travel with every group of nodes.
        "cacheNodeIds": True,
        "checkpointInterval": 5,
        "maxMemoryInMB": 1024,
    }
    classify = task == "classification"
    if classify and kind in ("RandomForest", "DecisionTree"):
        common["impurity"] = criterion
    if kind == "DecisionTree":
        return (DecisionTreeClassifier if classify else DecisionTreeRegressor)(**common)
    if kind == "RandomForest":
        forest = RandomForestClassifier if classify else RandomForestRegressor
        return forest(
            numTrees=n_estimators,
            featureSubsetStrategy="sqrt" if classify else "all",
            subsamplingRate=subsample,
            **common,
        )
    if kind in BOOSTED:
        boosted = GBTClassifier if classify else GBTRegressor
        return boosted(maxIter=n_estimators, stepSize=learning_rate, subsamplingRate=subsample, **common)
    raise ValueError(f"unknown model {kind!r}; choose from {MODELS}")


def training_view(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Assembled features and a double target, nothing else."""
    narrow = df.select(*[quoted(c) for c in features], quoted(target).cast("double").alias(target))
    return assembler(features).transform(narrow).select(VECTOR, target)


def grown_here(df: DataFrame, target: str, kind: str, task: str, params: Mapping) -> bool:
    """Whether :mod:`descria.operators.forest` grows such trees: single trees and forests on values or 0/1 classes."""
    if kind not in ("RandomForest", "DecisionTree") or params.get("subsample", 1.0) != 1.0 or params.get("criterion", "gini") != "gini":
        return False
    if task == "regression":
        return True
    label = quoted(target).cast("double")
    return df.where(label.isNull() | ~label.isin(0.0, 1.0)).isEmpty()


def tree_scores(df: DataFrame, features: Sequence[str], target: str, kind: str, task: str, **params) -> dict[str, float]:
    """Share of each feature in the impurity that the trees take away.

    Single trees and forests on values or 0/1 classes are grown by :mod:`descria.operators.forest`, where no depth (None
    or -1) is refused or cut; boosted trees, other criteria and more classes by Spark's estimators.
    """
    if grown_here(df, target, kind, task, params):
        max_depth = params.get("max_depth")
        single = kind == "DecisionTree"
        grown = forest.grow_forests(
            df, features, target, trees=1 if single else params.get("n_estimators", 100),
            max_depth=forest.DEEPEST if max_depth is None or max_depth < 0 else max_depth,
            min_leaf=params.get("min_samples_leaf", 1), sample_columns=task == "classification" and not single,
            bootstrap=not single, seed=params.get("seed", SEED),
        )
        return forest.importances(grown, features)
    shared_dir(df.sparkSession)
    model = tree_estimator(kind, task, target, **params).fit(training_view(df, features, target))
    values = model.featureImportances.toArray()
    return dict(zip(features, (float(v) for v in values), strict=True))


def lasso_scores(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    alpha: float,
    scaled: bool,
    max_iter: int = 1000,
    tol: float = 1e-9,
) -> dict[str, float]:
    """Absolute least-squares coefficients under an L1 penalty.

    With ``scaled`` the scores refer to standardised columns, so they are
    comparable across columns of different units. ``max_iter`` and ``tol`` are
    accepted for compatibility: the solver runs until it converges, at any width.
    """
    m = gram.collect_moments(df, [*features, target])[0]
    return lasso_from_moments(m, features, alpha, scaled)


def lasso_from_moments(m: gram.Moments, features: Sequence[str], alpha: float, scaled: bool) -> dict[str, float]:
    """The same scores from moments of the features and, last, the target."""
    d = len(features)
    beta, _ = penalised_from_moments(m, d, alpha, 0.0, scaled)
    size = np.abs(beta) * (column_std(m)[:d] if scaled else 1.0)
    return {f: float(v) for f, v in zip(features, size, strict=True)}


def logistic_lasso_scores(
    df: DataFrame, features: Sequence[str], target: str, alpha: float, max_iter: int = 1000
) -> dict[str, float]:
    """Absolute coefficients of an L1 logistic model with inverse strength ``1 / alpha``.

    ``max_iter`` limits the Newton rounds, each one scan; a fit that needs more is an error.
    """
    c = 1.0 / alpha if alpha > 0 else 1e9
    rows = logit.training_rows(df, features, target, None)
    fitted = logit.fit_together(rows, len(features), [logit.Spec(c, "l1")], scaled=False, max_iter=max_iter)[0]
    return dict(zip(features, fitted.size.tolist(), strict=True))


def importance_lasso(df: DataFrame, features: Sequence[str], target: str, task: str = "classification",
                     alpha: float | None = None, max_iter: int = 1000) -> dict[str, float]:
    """Scores used to break correlation ties: raw columns and 0.01 for classes, scaled and 1.0 for values."""
    if task == "classification":
        return lasso_scores(df, features, target, 0.01 if alpha is None else alpha, scaled=False, max_iter=max_iter)
    try:
        return lasso_scores(df, features, target, 1.0 if alpha is None else alpha, scaled=True, max_iter=max_iter)
    except NotConvergedError:  # anything else is a fault of the input and is raised
        return lasso_scores(df, features, target, 0.01, scaled=True, max_iter=2000)


def importance_rf(df: DataFrame, features: Sequence[str], target: str, task: str = "classification",
                  n_estimators: int | None = None) -> dict[str, float]:
    """Impurity scores of a forest: 200 trees on classes, 100 on values."""
    trees = n_estimators or (200 if task == "classification" else 100)
    return tree_scores(df, features, target, "RandomForest", task, n_estimators=trees)


def score_table(spark_df: DataFrame, scores: Mapping[str, float]) -> DataFrame:
    rows = [(k, f, float(v)) for k, (f, v) in enumerate(scores.items())]
    return spark_df.sparkSession.createDataFrame(rows, "pos int, feature string, importance double")
