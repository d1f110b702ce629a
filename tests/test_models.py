"""Fits against closed forms and brute force, splits, metrics, searches."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from descria.errors import DescriaError, EmptySelectionError, SearchTooLargeError
from descria.operators import combos, gram, grid, importance, linear, metrics, score, select, split


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 240
    x = rng.normal(size=(n, 4)) * [1, 3, 0.5, 2] + [0, 5, -2, 1]
    y = x @ [1, -2, 0.5, 0] + rng.normal(size=n)
    label = (x[:, 0] - 0.4 * x[:, 1] + 2 + rng.normal(size=n) > 0).astype(int)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(value=y, Label=label, key=np.arange(n))
    return pdf, spark.createDataFrame(pdf).repartition(3)


def descend(x, y, l1, l2, rounds=3000):
    """Coordinate descent for 1/(2n)|y-Xw|^2 + l1|w| + l2/2 |w|^2 on centred data."""
    xc, yc, w, n = x - x.mean(0), y - y.mean(), np.zeros(x.shape[1]), len(y)
    for _ in range(rounds):
        for j in range(len(w)):
            rho = xc[:, j] @ (yc - xc @ w + xc[:, j] * w[j]) / n
            w[j] = np.sign(rho) * max(abs(rho) - l1, 0) / ((xc[:, j] ** 2).mean() + l2)
    return w


@pytest.mark.parametrize("l1,l2", [(0, 0), (0.7, 0), (0, 0.5), (0.4, 0.3)])
@pytest.mark.parametrize("scaled", [False, True])
def test_penalties_mean_what_they_say(data, l1, l2, scaled):
    pdf, df = data
    x, y = pdf[list("abcd")].to_numpy(), pdf["value"].to_numpy()
    std = x.std(0) if scaled else np.ones(4)
    want = descend((x - x.mean(0)) / std, y, l1, l2) / std
    model = linear.fit_least_squares(df, list("abcd"), "value", l1=l1, l2=l2, scaled=scaled).stages[-1]
    assert np.allclose(model.coefficients.toArray(), want, atol=1e-5)
    if scaled:
        m = gram.collect_moments(df, [*"abcd", "value"])[0]
        beta, b0 = grid.penalised_from_moments(m, 4, l1, l2)
        assert np.allclose(beta, want, atol=1e-7)


def newton(z, y, c):
    x = np.column_stack([np.ones(len(z)), z])
    w, ridge = np.zeros(x.shape[1]), np.diag([0] + [1 / c] * z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return w


@pytest.mark.parametrize("c", [0.1, 1.0, 10.0])
def test_logistic_strength(data, c):
    pdf, df = data
    x, y = pdf[list("abcd")].to_numpy(), pdf["Label"].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    want = newton(z, y, c)[1:] / x.std(0)
    ready = importance.training_view(df, list("abcd"), "Label")
    model = linear.logistic(len(y), "Label", c, scaled=True, tol=1e-12).fit(ready)
    assert np.allclose(model.coefficients.toArray(), want, rtol=1e-4)


def test_split_sizes_and_determinism(data):
    _, df = data
    a = split.mark_held_out(df, "key", 0.2, 42, "Label")
    b = split.mark_held_out(df.repartition(11), "key", 0.2, 42, "Label")
    held = {r["key"] for r in a.filter("is_test").collect()}
    assert held == {r["key"] for r in b.filter("is_test").collect()}
    assert len(held) == 48
    total = {r["Label"]: r["count"] for r in df.groupBy("Label").count().collect()}
    part = {r["Label"]: r["count"] for r in a.filter("is_test").groupBy("Label").count().collect()}
    assert all(abs(part[g] - 0.2 * total[g]) <= 1 for g in total)
    folds = split.mark_folds(df, "key", 7)
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1
    with pytest.raises(DescriaError):
        split.mark_held_out(df, "key", 0.2, 42, "value")


def rank_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])


def test_auc_with_ties_and_a_hot_score(spark):
    rng = np.random.default_rng(5)
    s = np.where(rng.random(3000) < 0.4, 0.5, np.round(rng.random(3000), 2))
    y = (rng.random(3000) < 0.3 + 0.4 * s).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s})).repartition(5)
    got = metrics.roc_auc(df, "y", "s").first()[0]
    assert abs(got - rank_auc(y, s)) < 1e-12


def test_metric_edge_cases(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    got = {r["metric"]: r["value"] for r in metrics.metrics_cls(df, "y", "p").collect()}
    assert got["precision"] == got["recall"] == got["f1_score"] == 0.0
    assert got["accuracy"] == 1.0 and got["roc_auc"] is None and got["specificity"] is None
    flat = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0)], "y double, p double")
    reg = {r["metric"]: r["value"] for r in metrics.metrics_reg(flat, "y", "p").collect()}
    assert reg["mape"] == float("inf") and reg["mae"] == 1.5


def test_threshold_rules(spark):
    scores = importance.score_table(spark.range(1), {"a": 0.0, "b": 0.2, "c": 0.4, "d": 0.6})
    value = lambda e, task: select.threshold_expr(scores, e, task).first()[0]
    assert value("percentile(50)", "classification") == pytest.approx(0.3)
    assert value("median", "regression") == pytest.approx(0.4)
    assert value("mean", "regression") == pytest.approx(0.4)
    assert value("0.25", "regression") == 0.25
    assert select.at_or_above(scores, 0.4, False) == ["c", "d"]
    assert select.apply_empty_policy([], ["a", "b"], "classification") == (["a", "b"], True)
    with pytest.raises(EmptySelectionError):
        select.apply_empty_policy([], ["a"], "regression")


def test_selection_methods(data):
    _, df = data
    reg = df.drop("Label")
    lasso = select.select_by_model(reg, "Lasso", "value", "regression", alpha=0.5, protected=["key"])
    assert "b" in lasso.features and lasso.table.columns == ["key", *lasso.features, "value"]
    rfe = select.select_by_model(reg, "RFE", "value", "regression", "Lasso", n_features=2, protected=["key"])
    assert rfe.features == ["a", "b"]
    many = select.select_by_model(reg, "RFE", "value", "regression", "Lasso", n_features=99, protected=["key"])
    assert many.features == list("abcd")
    tree = select.select_by_model(
        df.drop("value"), "RandomForest", "Label", threshold=0.9, n_estimators=5, protected=["key"]
    )
    assert tree.fallback and tree.features == list("abcd")
    assert abs(sum(tree.scores.values()) - 1) < 1e-9
    cls = select.select_by_model(df.drop("value"), "Lasso", "Label", alpha=5.0, protected=["key"])
    assert set(cls.features) <= set("abcd") and cls.table.columns[:2] == ["key", "Label"]


def test_subset_least_squares_equals_brute_force(data):
    pdf, df = data
    marked = split.mark_held_out(df, "key")
    test = {r["key"] for r in marked.filter("is_test").collect()}
    held = pdf["key"].isin(test).to_numpy()
    got = {
        tuple(r["combo"]): (r["r2"], r["mse"])
        for r in combos.combo_eval_lr(marked, list("abcd"), "value", F.col("is_test"), 4).collect()
    }
    x, y = pdf[list("abcd")].to_numpy(), pdf["value"].to_numpy()
    width = y.max() - y.min()
    assert len(got) == 15
    for k in range(1, 5):
        for c in combinations(range(4), k):
            a = np.column_stack([np.ones(len(y)), x[:, c]])
            w = np.linalg.lstsq(a[~held], y[~held], rcond=None)[0]
            res = y[held] - a[held] @ w
            r2 = 1 - (res**2).sum() / ((y[held] - y[held].mean()) ** 2).sum()
            assert got[c] == pytest.approx((r2, (res**2).mean() / width**2), rel=1e-8)


def test_subset_logistic_equals_brute_force(data):
    pdf, df = data
    marked = split.mark_held_out(df, "key", 0.2, 42, "Label")
    test = {r["key"] for r in marked.filter("is_test").collect()}
    held = pdf["key"].isin(test).to_numpy()
    got = {
        tuple(r["combo"]): r["accuracy"]
        for r in combos.combo_eval_logit(marked, list("abcd"), "Label", F.col("is_test"), 2).collect()
    }
    x, y = pdf[list("abcd")].to_numpy(), pdf["Label"].to_numpy()
    assert len(got) == 10
    for c in got:
        sub = x[:, c]
        z = (sub - sub[~held].mean(0)) / sub[~held].std(0)
        w = newton(z[~held], y[~held], 1.0)
        acc = ((w[0] + z[held] @ w[1:] > 0) == (y[held] == 1)).mean()
        assert got[c] == pytest.approx(acc)


def test_subset_ranking_and_guard(spark):
    scored = spark.createDataFrame(
        [(1, [0], 0.5), (1, [1], 0.7), (2, [0, 1], 0.7), (2, [0, 2], 0.7)], "num_features int, combo array<int>, s double"
    )
    assert [r["combo"] for r in combos.combo_topn(scored, "s", 3).orderBy("rank").collect()] == [[1], [0, 1], [0, 2]]
    assert [r["combo"] for r in combos.best_per_size(scored, "s").collect()] == [[1], [0, 1]]
    with pytest.raises(SearchTooLargeError):
        combos.combo_enumerate(spark, 60, 5, max_combos=1000)
    assert combos.combo_enumerate(spark, 6, 3).count() == 6 + 15 + 20


def test_linear_grid_equals_direct_fits(data):
    pdf, df = data
    out = grid.grid_search_reg(df.drop("Label"), "key", algorithm="elasticnet", cv_splits=3)
    assert len(out.candidates) == 9
    held = {r["key"] for r in out.held_out.collect()}
    train = df.filter(~F.col("key").isin(held))
    folded = split.mark_folds(train, "key", 3).toPandas()
    rows = {(r["param_id"], r["fold"], r["split"], r["metric"]): r["value"] for r in out.cv_results.collect()}
    assert len(rows) == 9 * 3 * 4
    for pid, params in enumerate(out.candidates):
        part = folded["fold"] != 0
        x, y = folded[list("abcd")].to_numpy(), folded["value"].to_numpy()
        m, s = x[part].mean(0), x[part].std(0)
        z = (x - m) / s
        w = descend(z[part], y[part], params["alpha"] * params["l1_ratio"], params["alpha"] * (1 - params["l1_ratio"]), 500)
        pred = y[part].mean() + z[~part] @ w
        mse = ((y[~part] - pred) ** 2).mean()
        assert rows[pid, 0, "test", "Neg_MSE"] == pytest.approx(-mse, rel=1e-5)
    ridge = grid.grid_search_reg(df.drop("Label"), "key", algorithm="ridge", cv_splits=3)
    assert set(ridge.best_params) == {"alpha"}


def test_class_grid_invariants(data):
    _, df = data
    out = grid.grid_search_cls(
        df.drop("value"), "key", algorithm="decision_tree",
        grid={"max_depth": [2, 3], "min_samples_leaf": [1], "criterion": ["gini"]}, cv_splits=3,
    )
    rows = out.cv_results.collect()
    assert len(rows) == 2 * 3 * 2 * 5 and all(0 <= r["value"] <= 1 for r in rows)
    assert out.held_out.count() == 48 and out.best_params["max_depth"] in (2, 3)
    assert {r["metric"] for r in out.metrics.collect()} >= {"accuracy", "roc_auc", "specificity"}
    svm = grid.grid_search_cls(df.drop("value"), "key", algorithm="svm", grid={"C": [1]}, cv_splits=3)
    assert svm.best_score > 0.6


def test_default_grid_sizes():
    sizes = {a: len(grid.param_grid(a, "classification")) for a in grid.CLASS_GRIDS}
    assert sizes["xgboost"] == 27 and sizes["logistic"] == sizes["lasso"] == 5
    assert len(grid.param_grid("elasticnet", "regression")) == 9
    assert grid.param_grid("linear_regression", "regression") == [{}]
    with pytest.raises(ValueError):
        grid.param_grid("logistic", "classification", {"gamma": [1]})


def test_validation_checks_columns(data):
    _, df = data
    model = linear.fit_least_squares(df, ["a"], "value")
    with pytest.raises(DescriaError):
        score.validate_reg(model, df, ["a"], ["value", "b"])
    with pytest.raises(DescriaError):
        score.validate_reg(model, df.drop("a"), ["a"], "value")


def test_splits_of_many_classes_and_equal_keys(spark):
    df = spark.range(3000).selectExpr("id AS key", "id % 150 AS Label")
    marked = split.mark_held_out(df, "key", 0.25, 42, "Label")
    assert {tuple(r) for r in marked.groupBy("Label").agg(F.sum(F.col("is_test").cast("int"))).select("sum(CAST(is_test AS INT))").collect()} == {(5,)}
    folds = split.mark_split_and_folds(df, "key", 0.25, 5, 42, "Label").groupBy("Label", "fold").count()
    assert {(r["fold"], r["count"]) for r in folds.collect()} == {(-1, 5), (0, 3), (1, 3), (2, 3), (3, 3), (4, 3)}
    with pytest.raises(DescriaError):
        split.mark_held_out(spark.range(1000).selectExpr("id % 2 AS key"), "key", 0.25)
    empty = df.limit(0)
    assert split.mark_split_and_folds(empty, "key", label="Label").isEmpty()


def test_searches_are_refused_only_on_request():
    combos.check_size(62, 5, None)
    assert combos.combo_count(62, 5) > 5_000_000
    with pytest.raises(DescriaError):
        importance.depth(31)
    assert importance.depth(-1) == importance.depth(None) == importance.depth(30) == 30
