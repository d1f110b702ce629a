"""Linear operators beyond two strips of columns, and both least-squares solvers around their switch."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from descria.operators import combos, gram, importance, linear, select

ROWS = 40


def wide(spark, d):
    cells = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda k: F.sin((k + 1) * (F.col("id") + 1) * 0.37))
    rows = spark.range(ROWS).select("id", cells.alias("c"))
    names = [f"f{k}" for k in range(d)]
    return rows.select("id", *[F.col("c")[k].alias(n) for k, n in enumerate(names)], (3 * F.col("c")[1] + F.col("id") * 0.01).alias("value")), names


def test_strips_equal_one_block(spark):
    data, names = wide(spark, 7)
    one, strips = (gram.collect_moments(data, [*names, "value"], F.col("id") % 3, strip=s) for s in (100, 2))
    assert set(one) == set(strips) == {0, 1, 2}
    for p in one:
        assert strips[p].n == one[p].n
        np.testing.assert_allclose(strips[p].g, one[p].g, atol=1e-9)
        np.testing.assert_allclose(strips[p].s, one[p].s, atol=1e-9)
    with pytest.raises(ValueError):
        gram.collect_moments(data.withColumn("f6", F.when(F.col("id") > 3, F.col("f6"))), names, strip=2)


def test_scores_and_subsets_beyond_two_strips(spark, monkeypatch):
    data, names = wide(spark, 9)
    narrow = importance.lasso_scores(data, names, "value", 0.01, True)
    kept = select.recursive_elimination(data, names, "value", "Lasso", "regression", 3, alpha=0.01)
    tried = {tuple(r.combo): r.r2 for r in combos.combo_eval_lr(data, names, "value", F.col("id") % 4 == 0, 2).collect()}
    monkeypatch.setattr(gram, "STRIP", 2)
    monkeypatch.setattr(gram.collect_moments, "__defaults__", (None, 2))
    assert importance.lasso_scores(data, names, "value", 0.01, True) == pytest.approx(narrow, abs=1e-9)
    assert select.recursive_elimination(data, names, "value", "Lasso", "regression", 3, alpha=0.01) == kept
    again = {tuple(r.combo): r.r2 for r in combos.combo_eval_lr(data, names, "value", F.col("id") % 4 == 0, 2).collect()}
    assert again == pytest.approx(tried, abs=1e-9) and len(tried) == 45


@pytest.mark.parametrize("l1, l2", [(0.0, 0.0), (0.05, 0.0), (0.0, 0.5), (0.05, 0.2)])
@pytest.mark.parametrize("scaled", [True, False])
def test_both_solvers_agree(spark, monkeypatch, l1, l2, scaled):
    data, names = wide(spark, 4)
    normal = linear.fit_least_squares(data, names, "value", l1=l1, l2=l2, scaled=scaled).stages[-1]
    monkeypatch.setattr(linear, "NORMAL_MAX", 3)
    other = linear.fit_least_squares(data, names, "value", l1=l1, l2=l2, scaled=scaled).stages[-1]
    assert (normal.getSolver(), other.getSolver()) == ("normal", "l-bfgs")
    np.testing.assert_allclose(other.coefficients.toArray(), normal.coefficients.toArray(), atol=1e-4)
    assert other.intercept == pytest.approx(normal.intercept, abs=1e-4)
