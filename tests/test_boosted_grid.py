"""Boosted candidates that differ in rounds only share a fit and score as if fitted apart."""

from __future__ import annotations

import threading

import numpy as np
import pytest

from descria.operators import grid, importance


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (240, 3))
    v = x[:, 0] * 2 + x[:, 1] ** 2 + rng.normal(0, 0.3, 240)
    rows = [(*map(float, r), float(t), float(t > 1), k % 2) for k, (r, t) in enumerate(zip(x, v, strict=True))]
    return spark.createDataFrame(rows, "a double, b double, c double, value double, label double, fold int").coalesce(1)


@pytest.mark.parametrize("task, target", [("regression", "value"), ("classification", "label")])
def test_prefix_equals_a_fit_of_its_own(table, task, target):
    ready = importance.training_view(table, ["a", "b", "c"], target)
    large, small = (importance.tree_estimator("XGBoost", task, target, n_estimators=n, max_depth=2).fit(ready) for n in (6, 2))
    cut = grid.first_rounds(large, 2)
    assert cut.getNumTrees == 2 and grid.first_rounds(small, 2) is small
    want, got = (sorted(r.prediction for r in m.transform(ready).collect()) for m in (small, cut))
    assert got == pytest.approx(want)


def test_grid_shares_fits_and_keeps_scores(table, monkeypatch):
    candidates = grid.param_grid("xgboost", "regression", {"learning_rate": [0.1], "max_depth": [2], "n_estimators": [1, 3], "subsample": [1.0]})
    assert grid.sharing_fits("xgboost", candidates) == [[0, 1]] and grid.sharing_fits("random_forest", candidates) == [[0], [1]]
    assert len(grid.sharing_fits("xgboost", grid.param_grid("xgboost", "classification"))) == 9
    args = (table, ["a", "b", "c"], "value", "xgboost", "regression", candidates, 2, 1, 2)
    together = grid.cv_fitted(*args).toPandas()
    monkeypatch.setattr(grid, "sharing_fits", lambda _, c: [[p] for p in range(len(c))])
    apart = grid.cv_fitted(*args).toPandas()
    key = ["param_id", "fold", "split", "metric"]
    a, b = (x.sort_values(key).reset_index(drop=True) for x in (together, apart))
    assert len(a) == 16 and (a[key] == b[key]).all().all() and a.value.to_numpy() == pytest.approx(b.value.to_numpy())


def test_jobs_side_by_side_keep_their_own_local_properties(spark):
    """With shared ones a query ended in 'Cannot parse null string': another thread had removed its number."""
    context, meet = spark.sparkContext, threading.Barrier(3)

    def job(k):
        context.setLocalProperty("tests.own", str(k))
        meet.wait(60)
        return context.getLocalProperty("tests.own"), context.getLocalProperty("tests.callers")

    context.setLocalProperty("tests.callers", "kept")
    try:
        assert grid.in_threads(spark, job, range(6), 3) == [(str(k), "kept") for k in range(6)]
    finally:
        context.setLocalProperty("tests.callers", None)
