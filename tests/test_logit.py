"""Logistic models fitted together: closed forms, Spark's own fits, penalties and folds."""

from __future__ import annotations

import numpy as np
import pytest

from descria.errors import NotConvergedError
from descria.operators import grid, importance, linear, logit

NAMES = ["a", "b", "c", "k"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (600, 3)) * [1.0, 20.0, 0.1] + [0.0, 100.0, 5.0]
    y = (rng.random(600) < 1 / (1 + np.exp(-(x[:, 0] * 1.5 + (x[:, 1] - 100) * 0.03)))).astype(float)
    rows = [(*map(float, r), 7.0, float(v), k % 3) for k, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "a double, b double, c double, k double, label double, fold int").repartition(4)


def logit_of(p):
    return np.log(p / (1 - p))


@pytest.mark.parametrize("alpha", [0.01, 2.0, 500.0])
def test_lasso_on_a_binary_column_has_a_closed_form(spark, alpha):
    rows = [(1.0, 1.0)] * 40 + [(1.0, 0.0)] * 20 + [(0.0, 1.0)] * 15 + [(0.0, 0.0)] * 45
    df = spark.createDataFrame(rows, "x double, y double")
    got = importance.logistic_lasso_scores(df, ["x"], "y", alpha)["x"]
    p1, p0 = 40 / 60 - alpha / 60, 15 / 60 + alpha / 60
    assert got == pytest.approx(logit_of(p1) - logit_of(p0) if p1 > p0 else 0.0, abs=1e-6)


@pytest.mark.parametrize("penalty", ["l1", "l2"])
def test_all_candidates_and_folds_equal_single_fits_of_spark(table, penalty):
    specs = [logit.Spec(c, penalty, f) for c in (0.02, 1.0, 50.0) for f in range(3)]
    rows = logit.training_rows(table, NAMES, "label", "fold")
    for spec, got in zip(specs, logit.fit_together(rows, 4, specs), strict=True):
        train = table.where(table.fold != spec.left_out)
        ready = importance.training_view(train, NAMES, "label")
        want = linear.logistic(train.count(), "label", spec.c, penalty, scaled=True, max_iter=2000, tol=1e-12).fit(ready)
        assert got.coefficients == pytest.approx(want.coefficients.toArray(), abs=2e-4)
        assert got.intercept == pytest.approx(want.intercept, abs=5e-3)
        assert got.coefficients[3] == 0.0


def test_margins_and_several_scans_a_round(table, monkeypatch):
    rows = logit.training_rows(table, NAMES, "label", "fold")
    specs = [logit.Spec(c, "l1") for c in (0.05, 1.0)]
    one = logit.fit_together(rows, 4, specs)
    monkeypatch.setattr(logit, "SCAN_NUMBERS", 1)
    two = logit.fit_together(rows, 4, specs)
    assert [m.intercept for m in one] == pytest.approx([m.intercept for m in two])
    data = table.toPandas()
    got = table.select(one[1].margin(NAMES).alias("m"), "a").toPandas().sort_values("a").m.to_numpy()
    x = data.sort_values("a")[NAMES].to_numpy()
    assert got == pytest.approx(x @ one[1].coefficients + one[1].intercept, abs=1e-9)
    assert (one[0].coefficients != 0).sum() < 3  # the strong penalty leaves columns out


def test_one_scan_a_round(table, monkeypatch):
    calls = []
    real = logit._sums
    monkeypatch.setattr(logit, "_sums", lambda *a: calls.append(len(a[4])) or real(*a))
    rows = logit.training_rows(table, NAMES, "label", "fold")
    logit.fit_together(rows, 4, [logit.Spec(c, "l2", f) for c in (0.01, 0.1, 1, 10, 100) for f in range(3)])
    assert calls[0] == 15 and len(calls) < 15


def test_rounds_are_limited(table):
    rows = logit.training_rows(table, NAMES, "label", None)
    with pytest.raises(NotConvergedError):
        logit.fit_together(rows, 4, [logit.Spec(1.0)], max_iter=1)


@pytest.mark.parametrize("algorithm", ["logistic", "lasso"])
def test_grid_scores_equal_spark_fits(table, algorithm):
    candidates = [{"C": 0.05}, {"C": 5.0}]
    together = grid.cv_logistic(table, NAMES, "label", algorithm, candidates, 3, 2)
    apart = grid.cv_fitted(table, NAMES, "label", algorithm, "classification", candidates, 3, 1, 2)
    key = ["param_id", "fold", "split", "metric"]
    a, b = (x.toPandas().sort_values(key).reset_index(drop=True) for x in (together, apart))
    assert (a[key] == b[key]).all().all()
    assert a.value.to_numpy() == pytest.approx(b.value.to_numpy(), abs=6e-3)
