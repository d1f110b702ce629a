"""Forests grown together: against Spark's own trees, one phase against both, subsets against single fits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from descria.errors import DescriaError
from descria.operators import combos, forest, grid, importance
from descria.operators.linear import VECTOR

NAMES = ["a", "b", "c", "d e"]


@pytest.fixture(scope="module")
def table(spark):
    """Few distinct values, so that bins are exact and both implementations see the same cuts."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (900, 4))
    y = 3.0 * x[:, 0] + np.where(x[:, 1] > 5, 20.0, 0.0) * (x[:, 2] % 3) + rng.normal(0, 2, 900)
    rows = [(*map(float, r), float(v), float(v > 30), bool(h)) for r, v, h in zip(x, y, rng.random(900) < 0.2, strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, c double, `d e` double, y double, label double, held boolean")
    return df.repartition(3)


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_single_tree_equals_sparks(table, depth):
    train = importance.training_view(table, NAMES, "y")
    want = DecisionTreeRegressor(featuresCol=VECTOR, labelCol="y", maxDepth=depth).fit(train).featureImportances.toArray()
    got = importance.tree_scores(table, NAMES, "y", "DecisionTree", "regression", max_depth=depth)
    assert list(got.values()) == pytest.approx(want.tolist(), abs=1e-6)
    train = importance.training_view(table, NAMES, "label")
    # Gini splits of 0/1 labels are variance splits; Spark's classifier would also merge leaves of one class afterwards.
    want = DecisionTreeRegressor(featuresCol=VECTOR, labelCol="label", maxDepth=depth).fit(train).featureImportances.toArray()
    got = importance.tree_scores(table, NAMES, "label", "DecisionTree", "classification", max_depth=depth)
    assert list(got.values()) == pytest.approx(want.tolist(), abs=1e-6)


def test_held_rows_get_sparks_predictions(table):
    train = importance.training_view(table.where("not held"), NAMES, "y")
    model = DecisionTreeRegressor(featuresCol=VECTOR, labelCol="y", maxDepth=4).fit(train)
    want = sorted(r.prediction for r in model.transform(importance.training_view(table.where("held"), NAMES, "y")).collect())
    grown = forest.grow_forests(table, NAMES, "y", trees=1, max_depth=4, bootstrap=False, held=F.col("held"))
    assert sorted(r.prediction for r in forest.held_predictions(grown).collect()) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("local_rows", [40, 300])
@pytest.mark.parametrize("sample", [True, False])
def test_levels_then_subtrees_equal_subtrees_alone(table, local_rows, sample, monkeypatch):
    params = {"trees": 4, "sample_columns": sample, "held": F.col("held"), "min_leaf": 2}
    # The same stored rows have the same numbers in both runs, so the same samples are drawn.
    one = forest.grow_forests(table, NAMES, "y", **params)
    monkeypatch.setattr(forest, "SCAN_CELLS", 200)  # several scans a level
    two = forest.grow_forests(table, NAMES, "y", local_rows=local_rows, **params)
    assert forest.importances(two, NAMES) == pytest.approx(forest.importances(one, NAMES), abs=1e-5)
    scores = [forest.held_scores(g).first() for g in (one, two)]
    assert scores[0].r2 == pytest.approx(scores[1].r2, abs=1e-4) and scores[0].r2 > 0.5


def test_subsets_grown_together_equal_single_forests(table, monkeypatch):
    subsets = [[0], [1, 2], [0, 1, 2, 3]]
    monkeypatch.setattr(forest, "FORESTS_AT_ONCE", 2)
    got = {tuple(r.combo): (r.r2, r.mse) for r in combos.combo_eval_rf(table, NAMES, "y", F.col("held"), subsets, n_estimators=6).collect()}
    for own in subsets:
        grown = forest.grow_forests(table, NAMES, "y", [own], held=F.col("held"), trees=6, max_depth=10, seed=101)
        want = forest.held_scores(grown).first()
        assert got[tuple(own)] == pytest.approx((want.r2, want.mse), abs=1e-9)


def test_unlimited_trees_separate_all_rows(spark):
    rows = [(float(k), float(k % 2)) for k in range(30)]
    df = spark.createDataFrame(rows, "x double, y double")
    grown = forest.grow_forests(df, ["x"], "y", trees=1, bootstrap=False)
    gain = grown.where("kind = 'gain'").agg(F.sum("value")).first()[0]
    assert gain == pytest.approx(30 * 0.25)  # all of the label's sum of squares


def test_constant_labels_and_empty_tables(spark):
    for rows in ([(1.0, 2.0, 5.0)] * 8, [(float(k), 1.0, 5.0) for k in range(8)], []):
        df = spark.createDataFrame(rows, "a double, b double, y double")
        assert importance.tree_scores(df, ["a", "b"], "y", "RandomForest", "regression", n_estimators=3) == {"a": 0.0, "b": 0.0}


def test_equal_rows_move_as_one_cell(spark):
    """4,000 rows of 6 kinds, 5 trees, levels off: rows used to move once for each tree."""
    rows = [(float(k % 3), float(k % 2), float(k % 6) + 0.25 * (k % 5)) for k in range(4000)]
    df = spark.createDataFrame(rows, "a double, b double, y double").repartition(2)
    edges = forest.bin_edges(df, ["a", "b"], 32)
    stored = forest.clustered(forest.binned_table(df, ["a", "b"], "y", None, edges), 4000)
    plan = forest.Plan([[0, 1]], 5, 60, 1, [2], True, 1)
    tops = {t: forest.Top() for t in range(5)}
    packed = forest._packed_cells(stored, plan, tops, [(t, t + 1, 0) for t in range(5)], 2, 0.0)
    moved = packed.agg(F.sum(F.length("cells")), F.sum(F.length("cell_bins"))).first()
    blocks = packed.select("first").distinct().count()
    assert moved[0] <= 5 * 24 * (6 + blocks) and moved[1] <= 5 * 2 * (6 + blocks)
    one = forest.grow_forests(df.coalesce(1), ["a", "b"], "y", trees=5)
    two = forest.grow_forests(df.coalesce(1), ["a", "b"], "y", trees=5, local_rows=1000)
    assert forest.importances(two, ["a", "b"]) == pytest.approx(forest.importances(one, ["a", "b"]), abs=1e-2)


def test_small_nodes_split_alike_from_cells_and_from_bins():
    rng = np.random.default_rng(11)
    own = np.sort(rng.integers(0, 400, 1500))
    bins = rng.integers(0, 32, (1500, 3)).astype(np.uint8)
    w, s = rng.integers(1, 4, 1500).astype(float), rng.normal(0, 5, 1500)
    count, allowed = np.bincount(own, minlength=400), np.ones((400, 3), bool)
    for width in (4, 8, 16):
        nodes = np.flatnonzero((count > 1) & (count <= width))
        use = np.isin(own, nodes)
        number = np.searchsorted(nodes, own[use])
        args = (bins[use], [0, 1, 2], number, w[use], s[use])
        got = forest.best_splits(forest._sorted_sums(*args, count[nodes], width), 3, allowed[nodes], 2)
        want = forest.best_splits(forest._dense_sums(*args, len(nodes), 32), 3, allowed[nodes], 2)
        assert (got[2] == pytest.approx(want[2], abs=1e-9)) and (want[2] > 1e-9).sum() > 10
        # Splits of equal gain may differ by rounding: each choice must have the best gain.
        for k, (column, bin_, gain) in enumerate(zip(*got, strict=True)):
            mine = number == k
            left = mine & (bins[use][:, column] <= bin_)
            if gain > 1e-9:
                wl, sl, wa, sa = w[use][left].sum(), s[use][left].sum(), w[use][mine].sum(), s[use][mine].sum()
                assert sl * sl / wl + (sa - sl) ** 2 / (wa - wl) - sa * sa / wa == pytest.approx(want[2][k], abs=1e-9)


@pytest.mark.parametrize("local_rows", [60, 800])
def test_trees_of_a_search_grown_together_equal_sparks(table, local_rows, monkeypatch):
    """Spark's fits sent all nodes to the driver and held the sums of many nodes in each task."""
    candidates = grid.param_grid("decision_tree", "regression", {"max_depth": [2, 4, 0], "min_samples_leaf": [1, 6]})
    train = table.drop("held", "label").withColumn("fold", F.pmod(F.hash(*NAMES), F.lit(3)))
    args = (train, NAMES, "y", "decision_tree", "regression", candidates, 3, 42, 4)
    want = {tuple(r)[:4]: r.value for r in grid.cv_fitted(*args).collect()}
    monkeypatch.setattr(forest, "LOCAL_ROWS", local_rows)

    def refused(*_, **__):
        raise AssertionError("fitted by Spark")

    monkeypatch.setattr(grid, "estimator_for", refused)
    got = {tuple(r)[:4]: r.value for r in grid.cv_fitted(*args).collect()}
    assert len(want) == 6 * 3 * 2 * 2 and got == pytest.approx(want, rel=1e-6, abs=1e-9)
    with pytest.raises(DescriaError):
        grid.cv_fitted(train.withColumn("y", F.when(F.col("a") > 1, F.col("y"))), *args[1:])


def test_unlimited_trees_of_a_search(spark, monkeypatch):
    """Levels end above some of the depths; every row is parted, so what a tree learnt from has no error left."""
    rows = [(float(k), float(k * k), k % 2) for k in range(400)]
    df = spark.createDataFrame(rows, "x double, y double, fold int")
    for local_rows in (50, 1000):
        got = forest.fold_errors(df, ["x"], "y", "fold", 2, [1], [1, 30], max_bins=250, local_rows=local_rows)
        assert got[1, 30, 0, True][0] < 1e-9 * got[1, 30, 0, True][1] and got[1, 30, 0, False][0] > 1
        assert got[1, 1, 1, True][:2] == pytest.approx(forest.fold_errors(df, ["x"], "y", "fold", 2, [1], [1], max_bins=250)[1, 1, 1, True][:2])
        assert {n for _, _, n in got.values()} == {200}


def test_many_forests_send_errors_and_no_predictions(table):
    """Above ``local_rows`` each of many forests used to move its cells tree by tree, and to send back a row for each held row."""
    subsets = [[a, b] for a in range(4) for b in range(4) if a != b]
    params = {"trees": 5, "max_depth": 4, "held": F.col("held"), "seed": 7}
    few = forest.grow_forests(table, NAMES, "y", subsets, local_rows=40, scores_only=True, **params)
    assert few.where("kind = 'held'").isEmpty() and few.where("kind = 'score'").count() == len(subsets)
    got = {r.forest: (r.r2, r.mse) for r in forest.held_scores(few).collect()}
    want = {r.forest: (r.r2, r.mse) for r in forest.held_scores(forest.grow_forests(table, NAMES, "y", subsets, **params)).collect()}
    assert set(got) == set(want) == set(range(12))
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_trees_are_dealt_by_work():
    plan = forest.Plan([[0], [1], [2], [0, 1], [0, 1, 2]], 10, 10, 1, [1, 1, 1, 2, 3], True, 1)
    whole = forest._dealt(plan, 100_000, 32, 3, True)
    assert [a for a, _, _ in whole[1:]] == [b for _, b, _ in whole[:-1]] and (whole[0][0], whole[-1][1]) == (0, 50)
    assert whole[-1] == (40, 50, 0) and all(a % 10 == b % 10 == 0 for a, b, _ in whole)
    single = forest._dealt(plan, 100_000, 32, 1000, False)
    assert single == [(t, t + 1, 0) for t in range(50)]


def test_tables_of_few_cells_need_no_levels(spark, monkeypatch):
    """4,000 rows of 6 kinds: nodes were split level by level, with a scan of all rows each, as long as they had many rows."""
    rows = [(float(k % 3), float(k % 2), float(k % 6) + 0.25 * (k % 5)) for k in range(4000)]
    df = spark.createDataFrame(rows, "a double, b double, y double").coalesce(1)

    def refused(*_):
        raise AssertionError("levels")

    monkeypatch.setattr(forest, "_grow_levels", refused)
    one = forest.grow_forests(df, ["a", "b"], "y", trees=5)
    two = forest.grow_forests(df, ["a", "b"], "y", trees=5, local_rows=1000)
    assert forest.importances(two, ["a", "b"]) == pytest.approx(forest.importances(one, ["a", "b"]), abs=1e-2)
    with pytest.raises(AssertionError):
        forest.grow_forests(df.withColumn("b", F.monotonically_increasing_id().cast("double")), ["a", "b"], "y", trees=1, local_rows=50)


def test_draws_by_table_are_those_by_search():
    rows = np.concatenate([np.arange(200_000), np.arange(50_000) + (3 << 33)])
    plan = forest.Plan([[0]], 5, 9, 1, [1], True, 42)
    for tree in (0, 3):
        salt = forest._mixed(np.array([42 * 1_000_003 + tree], np.uint64))[0]
        drawn = forest._mixed(rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt) >> np.uint64(11)
        want = np.searchsorted(forest._POISSON, drawn / float(1 << 53), "right")
        assert (forest.weights(rows, tree, plan) == want).all() and abs(want.mean() - 1) < 0.01
