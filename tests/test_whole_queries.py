"""Registered searches try all that their operators try by default."""

from __future__ import annotations

import math

import numpy as np
import pytest

import __spark_entry__ as entry_points
from descria.operators import grid, split
from descria.workload.fixtures import CUST_FEATURES, d_cust

SF = "/root/testdata/sf0.001"
SUBSETS = sum(math.comb(len(CUST_FEATURES), k) for k in range(1, 6))


def rows(spark, name):
    return entry_points.queries()[name](spark, SF).collect()


@pytest.mark.parametrize("name", ["combo_eval_lr_all", "combo_eval_logit", "combo_eval_rf"])
def test_all_subsets_up_to_five(spark, name):
    got = rows(spark, name)
    assert len({r.combo for r in got}) == len(got) == SUBSETS == 119


def test_subsets_equal_plain_least_squares(spark):
    data = split.mark_held_out(d_cust(spark, SF), "c_custkey", 0.2, 42).toPandas()
    held = data.is_test.to_numpy(bool)
    x, y = data[CUST_FEATURES].to_numpy(float), data.value.to_numpy(float)
    want = {}
    for combo in [r.combo for r in rows(spark, "combo_eval_lr_all")]:
        cols = x[:, [int(k) for k in combo.split(",")]]
        cols = np.column_stack([np.ones(len(cols)), (cols - cols.mean(axis=0)) / cols.std(axis=0)])
        p = cols[held] @ np.linalg.lstsq(cols[~held], y[~held], rcond=None)[0]
        want[combo] = 1 - ((y[held] - p) ** 2).sum() / ((y[held] - y[held].mean()) ** 2).sum()
    got = {r.combo: r.r2 for r in rows(spark, "combo_eval_lr_all")}
    assert got == pytest.approx(want, abs=2e-6)
    best = rows(spark, "best_per_size_all")
    assert [r.num_features for r in best] == [1, 2, 3, 4, 5]
    assert [r.r2 for r in best] == pytest.approx([max(v for c, v in want.items() if c.count(",") == k) for k in range(5)], abs=2e-6)
    assert [r.r2 for r in rows(spark, "combo_topn_all")] == pytest.approx(sorted(want.values())[:-4:-1], abs=2e-6)


@pytest.mark.parametrize(
    "name, algorithm, task", [("grid_search_cls", "logistic", "classification"), ("grid_search_tree", "decision_tree", "regression"), ("grid_search_reg_all", "elasticnet", "regression")]
)
def test_all_candidates(spark, name, algorithm, task):
    assert {r.param_id for r in rows(spark, name)} == set(range(len(grid.param_grid(algorithm, task))))


def test_every_document_has_its_path_judged(spark, tmp_path):
    rows = [(0, "web"), (1, "a.txt/b"), (2, "web"), (3, "x.smi/y"), (6, None), (None, "web")]
    spark.createDataFrame(rows, "doc_id long, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.path, r.supported) for r in entry_points.queries()["validate_format"](spark, str(tmp_path)).collect()}
    assert got == {
        0: ("lib/web/0.smi", True), 1: ("lib/a.txt/b/1.CSV", True), 2: ("lib/web/2.sdf", True),
        3: ("lib/x.smi/y/3.txt", False), 6: (None, None), None: (None, None),
    }


def test_screening_that_selects_nothing_extracts_nothing(spark, tmp_path):
    """All predictions lie above the cutoff; the query failed on the missing extraction."""
    orders = [(k, k % 7, 1e6 + k, "F") for k in range(60)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string").write.parquet(
        str(tmp_path / "orders.parquet")
    )
    lines = [(k, 1.0, 0.1, 0.1, 100.0 * (k % 13)) for k in range(60)]
    spark.createDataFrame(
        lines, "l_orderkey long, l_quantity double, l_discount double, l_tax double, l_extendedprice double"
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = entry_points.queries()["screen_and_extract"](spark, str(tmp_path))
    assert got.columns == ["row_idx", "title"] and got.collect() == []
