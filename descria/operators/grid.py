"""Hyper-parameter search with cross-validation and several metrics.

Linear regressors need no fit per candidate and fold: the moments of every fold
come from one scan, a training set is the total minus one fold, and all
candidates are solved and scored from those matrices. Logistic models of all candidates
and folds are fitted in the same scans, one a Newton round. Other estimators are
fitted by Spark jobs, a few at a time, on a table that is assembled once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import partial
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descria.columns import feature_columns, quoted, require_columns
from descria.operators import forest, gram, linear, logit, metrics, score, split
from descria.operators.normal import penalised_from_moments, score_from_moments
from descria.operators.impute import median_impute_global
from descria.operators.importance import depth, tree_estimator
from descria.storage import materialise, ship_package

# Default candidate lists per task and algorithm.
CLASS_GRIDS: dict[str, dict[str, list]] = {
    "decision_tree": {
        "criterion": ["gini", "entropy"],
        "max_depth": [3, 5, 7],
        "min_samples_leaf": [1, 2, 4],
    },
    "random_forest": {
        "criterion": ["gini", "entropy"],
        "max_depth": [3, 5, 7],
        "min_samples_leaf": [1, 2, 4],
        "n_estimators": [100, 200, 300],
    },
    "xgboost": {"learning_rate": [0.01, 0.05, 0.1], "max_depth": [3, 5, 7], "n_estimators": [100, 200, 300]},
    "lightgbm": {
        "learning_rate": [0.01, 0.05, 0.1],
        "max_depth": [3, 5, 7],
        "n_estimators": [100, 200, 300],
        "subsample": [0.6, 0.8, 1.0],
    },
    "logistic": {"C": [0.01, 0.1, 1, 10, 100]},
    "lasso": {"C": [0.01, 0.1, 1, 10, 100]},
    "svm": {"C": [0.01, 0.1, 1, 10, 100]},
}
VALUE_GRIDS: dict[str, dict[str, list]] = {
    "decision_tree": {"max_depth": [-1, 5, 10, 20], "min_samples_leaf": [1, 3, 5]},
    "random_forest": {
        "max_depth": [-1, 5, 10, 20],
        "min_samples_leaf": [1, 3, 5],
        "n_estimators": [100, 200, 300],
    },
    "xgboost": {
        "learning_rate": [0.01, 0.1, 0.2],
        "max_depth": [-1, 5, 10, 20],
        "n_estimators": [100, 200, 300],
        "subsample": [0.8, 1.0],
    },
    "lightgbm": {
        "learning_rate": [0.01, 0.1, 0.2],
        "max_depth": [-1, 5, 10, 20],
        "n_estimators": [100, 200, 300],
        "subsample": [0.8, 1.0],
    },
    "ridge": {"alpha": [0, 1.0, 10.0]},
    "lasso": {"alpha": [0, 0.1, 1.0]},
    "elasticnet": {"alpha": [0, 0.1, 1.0], "l1_ratio": [0.1, 0.5, 0.9]},
    "linear_regression": {},
}
_TREES = {
    "decision_tree": "DecisionTree",
    "random_forest": "RandomForest",
    "xgboost": "XGBoost",
    "lightgbm": "LightGBM",
}
BOOSTED_ALGORITHMS = ("xgboost", "lightgbm")
LINEAR_REGRESSORS = ("ridge", "lasso", "elasticnet", "linear_regression")
CLASS_METRICS = ("accuracy", "f1", "roc_auc", "precision", "recall")
VALUE_METRICS = ("R2", "Neg_MSE")
# Sums by node that a task holds while the best tree of many rows is fitted again.
REFIT_MB = 256
CV_SCHEMA = "param_id int, fold int, split string, metric string, value double"


@dataclass(frozen=True)
class GridResult:
    """Outcome of a search. ``cv_results`` is ``(param_id, fold, split, metric, value)``."""

    model: PipelineModel
    features: list[str]
    best_params: Mapping[str, object]
    candidates: list[dict]
    cv_results: DataFrame
    held_out: DataFrame
    metrics: DataFrame
    best_score: float


def param_grid(algorithm: str, task: str, overrides: Mapping[str, Sequence] | None = None) -> list[dict]:
    """Cartesian product of the value lists; names in order, the last one varying fastest."""
    grids = CLASS_GRIDS if task == "classification" else VALUE_GRIDS
    if algorithm not in grids:
        raise ValueError(f"unknown algorithm {algorithm!r}; choose from {sorted(grids)}")
    lists = {k: list(v) for k, v in grids[algorithm].items()}
    for name, values in (overrides or {}).items():
        if name not in lists:
            raise ValueError(f"{algorithm} has no parameter {name!r}; choose from {sorted(lists)}")
        lists[name] = list(values)
    names = sorted(lists)
    return [dict(zip(names, combo, strict=True)) for combo in product(*[lists[n] for n in names])]


def param_table(spark: SparkSession, candidates: Sequence[Mapping]) -> DataFrame:
    """``(param_id, params)`` with the values as text."""
    rows = [(k, {n: str(v) for n, v in c.items()}) for k, c in enumerate(candidates)]
    return spark.createDataFrame(rows, "param_id int, params map<string,string>")


def mean_scores(cv_results: DataFrame) -> DataFrame:
    """Mean over folds per candidate, split and metric."""
    return cv_results.groupBy("param_id", "split", "metric").agg(F.avg("value").alias("mean_value"))


def best_candidate(cv_results: DataFrame, metric: str) -> tuple[int, float]:
    """Candidate with the best mean held-out score; the first one wins ties."""
    means = mean_scores(cv_results.filter((F.col("metric") == metric) & (F.col("split") == "test")))
    row = means.orderBy(F.round("mean_value", 12).desc_nulls_last(), "param_id").first()
    return row["param_id"], row["mean_value"]


def in_threads(spark: SparkSession, run: Callable, jobs: Sequence, parallelism: int) -> list:
    """Results of ``run`` for each job, in order, a few jobs at a time.

    Each job has its own copy of the caller's local properties: Spark keeps the number of the running query there, so
    threads that share one copy take it from each other.
    """
    calls = [inheritable_thread_target(spark)(partial(run, job)) for job in jobs]
    pool = ThreadPool(processes=max(1, min(parallelism, len(calls))))
    try:
        return list(pool.imap(lambda call: call(), calls))
    finally:
        pool.close()
        pool.join()


# --- linear regressors from fold moments ------------------------------------


def penalties(algorithm: str, params: Mapping, n: float) -> tuple[float, float]:
    """(L1, L2) strengths per row for standardised columns."""
    alpha = float(params.get("alpha", 0.0))
    if algorithm == "ridge":
        return 0.0, alpha / n
    if algorithm == "lasso":
        return alpha, 0.0
    if algorithm == "elasticnet":
        ratio = float(params["l1_ratio"])
        return alpha * ratio, alpha * (1.0 - ratio)
    return 0.0, 0.0


def cv_linear(
    train: DataFrame, features: Sequence[str], target: str, algorithm: str, candidates: Sequence[Mapping], folds: int
) -> DataFrame:
    """CV table of all candidates from one scan of ``train`` (which carries ``fold``)."""
    spark = train.sparkSession
    d = len(features)
    parts = gram.collect_moments(train, [*features, target], F.col("fold"))
    total = parts[0]
    for k in range(1, folds):
        total = total + parts[k]
    # (folds + 1) matrices of (d + 1)^2 numbers, independent of the number of rows.
    state = spark.sparkContext.broadcast((parts, total, list(candidates)))
    ship_package(spark)
    # One row per model to solve, spread so that solves run on all slots.
    jobs = spark.range(len(candidates) * folds).repartition(min(len(candidates) * folds, 64))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_fold, everything, options = state.value
        for batch in batches:
            rows = []
            for job in batch["id"]:
                pid, fold = divmod(int(job), folds)
                fit = everything - by_fold[fold]
                beta, b0 = penalised_from_moments(fit, d, *penalties(algorithm, options[pid], fit.n))
                for name, part in (("train", fit), ("test", by_fold[fold])):
                    r2, mse = score_from_moments(part, np.arange(d), d, beta, b0)
                    rows += [(pid, fold, name, "R2", r2), (pid, fold, name, "Neg_MSE", -mse)]
            yield pd.DataFrame(rows, columns=["param_id", "fold", "split", "metric", "value"])

    return jobs.mapInPandas(solve, CV_SCHEMA)


# --- logistic models of all candidates and folds together ----------------------


def cv_logistic(
    train: DataFrame, features: Sequence[str], target: str, algorithm: str, candidates: Sequence[Mapping], folds: int, parallelism: int
) -> DataFrame:
    """CV table of L2 (``logistic``) or L1 (``lasso``) models: every candidate and fold is fitted in the same scans."""
    spark = train.sparkSession
    penalty = "l2" if algorithm == "logistic" else "l1"
    jobs = [(p, f) for p in range(len(candidates)) for f in range(folds)]
    specs = [logit.Spec(float(candidates[p]["C"]), penalty, f) for p, f in jobs]
    rows = logit.training_rows(train, features, target, "fold")
    names = [f"x{k}" for k in range(len(features))]
    models = logit.fit_together(rows, len(features), specs)
    # One scan scores all models; the metrics below read two columns each.
    margins = materialise(rows.select("y", "fold", *[m.margin(names).alias(f"m{k}") for k, m in enumerate(models)]), "margins")

    def measure(k: int) -> list[tuple]:
        own = margins.select("y", "fold", F.col(f"m{k}").alias("rawPrediction"), (F.col(f"m{k}") > 0).cast("double").alias("prediction"))
        return [(*jobs[k], *m) for m in _class_fold(own, "y", jobs[k][1])]

    found = [r for part in in_threads(spark, measure, range(len(jobs)), parallelism) for r in part]
    return spark.createDataFrame(found, CV_SCHEMA)


# --- estimators fitted by Spark jobs ----------------------------------------


def estimator_for(algorithm: str, task: str, target: str, params: Mapping, n: int, seed: int):
    """Spark estimator of one candidate for a training set of ``n`` rows."""
    if algorithm in _TREES:
        return tree_estimator(_TREES[algorithm], task, target, seed=seed, **params)
    c = float(params.get("C", 1.0))
    if algorithm == "logistic":
        return linear.logistic(n, target, c, "l2", scaled=True, max_iter=2000)
    if algorithm == "lasso":
        return linear.logistic(n, target, c, "l1", scaled=True, max_iter=2000)
    if algorithm == "svm":
        return linear.linear_svm(n, target, c)
    raise ValueError(f"unknown algorithm {algorithm!r}")


def _class_fold(scored: DataFrame, target: str, fold: int) -> list[tuple[str, str, float]]:
    """Metrics of both sides of one fold: a single aggregate for the counts, Spark's exact AUC."""
    test = F.col("fold") == fold
    names = {"f1_score": "f1"}
    out: list[tuple[str, str, float]] = []
    auc = BinaryClassificationEvaluator(labelCol=target, rawPredictionCol="rawPrediction", numBins=0)
    for side, rows in (("train", scored.filter(~test)), ("test", scored.filter(test))):
        for r in metrics.metrics_cls(rows, target, "prediction").collect():
            if r["metric"] not in ("specificity", "roc_auc"):
                out.append((side, names.get(r["metric"], r["metric"]), r["value"]))
        out.append((side, "roc_auc", float(auc.evaluate(rows))))
    return out


def _value_fold(scored: DataFrame, target: str, fold: int) -> list[tuple[str, str, float]]:
    test = F.col("fold") == fold
    out: list[tuple[str, str, float]] = []
    for side, rows in (("train", scored.filter(~test)), ("test", scored.filter(test))):
        values = {r["metric"]: r["value"] for r in metrics.metrics_reg(rows, target, "prediction").collect()}
        out += [(side, "R2", values["r2_score"]), (side, "Neg_MSE", -values["mse"])]
    return out


def sharing_fits(algorithm: str, candidates: Sequence[Mapping]) -> list[list[int]]:
    """Candidates that one fit serves: boosted ones that differ in the number of rounds only, all others each alone."""
    if algorithm not in BOOSTED_ALGORITHMS:
        return [[p] for p in range(len(candidates))]
    groups: dict[tuple, list[int]] = {}
    for p, own in enumerate(candidates):
        groups.setdefault(tuple(sorted((k, str(v)) for k, v in own.items() if k != "n_estimators")), []).append(p)
    return list(groups.values())


def first_rounds(model, rounds: int):
    """The boosted model as it was after ``rounds`` rounds: round by round fitting makes it a prefix of the larger one."""
    if rounds >= model.getNumTrees:
        return model
    context = SparkContext._active_spark_context  # there is one for all threads, unlike the active session
    java, jvm_of, gateway = model._java_obj, context._jvm, context._gateway
    trees = gateway.new_array(jvm_of.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(jvm_of.double, rounds)
    for k in range(rounds):
        trees[k], weights[k] = java.trees()[k], java.treeWeights()[k]
    kind = type(model)
    package = jvm_of.org.apache.spark.ml.classification if kind is GBTClassificationModel else jvm_of.org.apache.spark.ml.regression
    made = getattr(package, kind.__name__)(java.uid() + f"_{rounds}", trees, weights)
    return kind(java.copyValues(made, java.extractParamMap()))


def cv_trees(
    train: DataFrame, features: Sequence[str], target: str, candidates: Sequence[Mapping], folds: int
) -> DataFrame:
    """CV table of single regression trees, all grown together by :mod:`descria.operators.forest`; no tree comes to the driver."""
    options = [(int(c.get("min_samples_leaf", 1)), depth(c.get("max_depth"))) for c in candidates]
    leaves, depths = (sorted({o[k] for o in options}) for k in range(2))
    errors = forest.fold_errors(train, features, target, "fold", folds, leaves, depths, local_rows=min(forest.FOLD_ROWS, forest.LOCAL_ROWS))
    rows = []
    for pid, option in enumerate(options):
        for fold in range(folds):
            for side, seen in (("train", True), ("test", False)):
                error, spread, n = errors[*option, fold, seen]
                r2 = 1.0 - error / spread if spread > 0 else float(error <= forest.LEAST_GAIN * n)
                rows += [(pid, fold, side, "R2", r2), (pid, fold, side, "Neg_MSE", -error / n)]
    return train.sparkSession.createDataFrame(rows, CV_SCHEMA)


def cv_fitted(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    algorithm: str,
    task: str,
    candidates: Sequence[Mapping],
    folds: int,
    seed: int,
    parallelism: int,
) -> DataFrame:
    """CV table of estimators fitted by Spark, one fit per fold and group of :func:`sharing_fits`.

    Spark sends all nodes of a tree to the driver and holds sums by node in each task. Single trees on values over more than
    ``forest.LOCAL_ROWS`` rows, which may have as many nodes as rows, are therefore grown by :func:`cv_trees`.
    """
    spark = train.sparkSession
    if algorithm == "decision_tree" and task == "regression" and linear.row_count(train) > forest.LOCAL_ROWS:
        return cv_trees(train, features, target, candidates, folds)
    narrow = train.select(*[quoted(c) for c in features], quoted(target).cast("double").alias(target), "fold")
    ready = materialise(
        linear.assembler(features).transform(narrow).select(linear.VECTOR, target, "fold"), "assembled"
    )
    sizes = {r["fold"]: r["count"] for r in ready.groupBy("fold").count().collect()}
    measure = _class_fold if task == "classification" else _value_fold

    def run(job: tuple[list[int], int]) -> list[tuple]:
        pids, fold = job
        n = sum(sizes.values()) - sizes[fold]
        largest = max(pids, key=lambda p: candidates[p].get("n_estimators", 0))
        model = estimator_for(algorithm, task, target, candidates[largest], n, seed).fit(ready.filter(F.col("fold") != fold))
        out = []
        for pid in pids:
            own = model if pid == largest else first_rounds(model, candidates[pid]["n_estimators"])
            out += [(pid, fold, *m) for m in measure(own.transform(ready), target, fold)]
        return out

    jobs = [(p, f) for p in sharing_fits(algorithm, candidates) for f in range(folds)]
    rows = [r for part in in_threads(spark, run, jobs, parallelism) for r in part]
    return spark.createDataFrame(rows, CV_SCHEMA)


def refit(
    train: DataFrame, features: Sequence[str], target: str, algorithm: str, task: str, params: Mapping, seed: int
) -> PipelineModel:
    """Best candidate fitted on all training rows, with its assembler."""
    if task == "regression" and algorithm in LINEAR_REGRESSORS:
        l1, l2 = penalties(algorithm, params, float(linear.row_count(train)))
        return linear.fit_least_squares(train, features, target, l1=l1, l2=l2, scaled=True)
    data = train.select(*[quoted(c) for c in features], quoted(target).cast("double").alias(target))
    n = linear.row_count(data)
    estimator = estimator_for(algorithm, task, target, params, n, seed)
    if algorithm == "decision_tree" and n > forest.LOCAL_ROWS:
        estimator = estimator.setMaxMemoryInMB(REFIT_MB)  # same tree, more passes
    return Pipeline(stages=[linear.assembler(features), estimator]).fit(data)


def _search(
    df: DataFrame,
    features: list[str],
    target: str,
    key: str,
    algorithm: str,
    task: str,
    grid: Mapping[str, Sequence] | None,
    test_size: float,
    cv_splits: int,
    seed: int,
    parallelism: int,
) -> GridResult:
    label = target if task == "classification" else None
    marked = split.mark_split_and_folds(df, key, test_size, cv_splits, seed, label)
    # Every fit and score below reads these columns again: store them once.
    marked = materialise(marked, "search")
    train = marked.filter(F.col("fold") >= 0)
    held_out = marked.filter(F.col("fold") < 0).drop("fold")
    candidates = param_grid(algorithm, task, grid)
    if task == "regression" and algorithm in LINEAR_REGRESSORS:
        cv = cv_linear(train, features, target, algorithm, candidates, cv_splits)
    elif task == "classification" and algorithm in ("logistic", "lasso"):
        cv = cv_logistic(train, features, target, algorithm, candidates, cv_splits, parallelism)
    else:
        cv = cv_fitted(train, features, target, algorithm, task, candidates, cv_splits, seed, parallelism)
    cv = materialise(cv, "cv")
    best, best_score = best_candidate(cv, "accuracy" if task == "classification" else "R2")
    model = refit(train, features, target, algorithm, task, candidates[best], seed)
    check = score.validate_cls if task == "classification" else score.validate_reg
    result = check(model, held_out, features, target)
    return GridResult(model, features, candidates[best], candidates, cv, held_out, result.metrics, best_score)


def grid_search_cls(
    df: DataFrame,
    key: str,
    target: str = "Label",
    algorithm: str = "random_forest",
    grid: Mapping[str, Sequence] | None = None,
    test_size: float = 0.2,
    cv_splits: int = 5,
    seed: int = 42,
    protected: Sequence[str] = (),
    parallelism: int = 4,
) -> GridResult:
    """Stratified split, stratified K-fold search on five metrics, refit on best mean accuracy."""
    require_columns(df, [key, target])
    features = feature_columns(df, {key, target, "SMILES", "Name", *protected})
    return _search(df, features, target, key, algorithm, "classification", grid, test_size, cv_splits, seed, parallelism)


def grid_search_reg(
    df: DataFrame,
    key: str,
    target: str = "value",
    algorithm: str = "random_forest",
    grid: Mapping[str, Sequence] | None = None,
    test_size: float = 0.2,
    cv_splits: int = 5,
    seed: int = 42,
    protected: Sequence[str] = (),
    parallelism: int = 4,
) -> GridResult:
    """Random split, K-fold search on R2 and negative MSE, refit on best mean R2.

    Missing and infinite cells are median-filled over the whole table first.
    """
    require_columns(df, [key, target])
    filled = median_impute_global(df, feature_columns(df, {key, target, "SMILES", *protected}))
    features = feature_columns(filled.table, {key, target, "SMILES", *protected})
    return _search(
        filled.table, features, target, key, algorithm, "regression", grid, test_size, cv_splits, seed, parallelism
    )
