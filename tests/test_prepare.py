"""Cleaning, imputation and pruning on small hand-made frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from descria.errors import EmptySelectionError, MissingColumnError, NonNumericColumnError
from descria.columns import feature_columns, select_features
from descria.operators import clean, gram, impute, moments, prune
from descria.plans.preparation import optimize_all, preprocess_all

INF = float("inf")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_replace_inf_keeps_other_cells(spark):
    df = frame(spark, [(1, 1.0, "a"), (2, INF, "b"), (3, -INF, None), (4, float("nan"), "c")], "k int, x double, s string")
    out = clean.replace_inf(df).orderBy("k")
    assert values(out, "x") == [1.0, None, None, None]
    assert values(out, "s") == ["a", "b", None, "c"]


def test_inf_report_lists_only_columns_with_hits(spark):
    df = frame(spark, [(1.0, INF, 2), (2.0, -INF, 3), (3.0, 0.0, 4)], "a double, b double, c int")
    assert [tuple(r) for r in clean.inf_report(df, "Inf_Count").collect()] == [("b", 2)]


@pytest.mark.parametrize("threshold,n", [(0.5, 68), (0.3, 10), (0.1, 10), (0.7, 10), (1 / 3, 3), (0.0, 5), (1.0, 7)])
def test_max_missing_is_the_float_rule(threshold, n):
    limit = clean.max_missing(threshold, n)
    assert [m for m in range(n + 1) if m / n <= threshold] == list(range(limit + 1))


def test_row_threshold_is_inclusive_and_counts_all_columns(spark):
    df = frame(spark, [(1, None, 1.0, "x"), (2, None, None, "x"), (3, None, None, None)], "k int, a double, b double, s string")
    assert sorted(values(clean.drop_high_nan_rows(df, 0.5), "k")) == [1, 2]
    kept = df.filter(clean.row_is_kept(df, 0.5))
    assert sorted(values(kept, "k")) == [1, 2]


def test_sparse_protected_columns_move_to_the_end(spark):
    df = frame(spark, [(None, 1.0, None), (None, 2.0, 1.0)], "Name string, a double, b double")
    assert clean.drop_high_nan_cols(df, 0.4).columns == ["a", "Name"]
    reg = frame(spark, [(1.0, 2.0, None)], "value double, a double, SMILES string")
    assert clean.drop_high_nan_cols(reg, 0.5, ("SMILES", "value"), "regression").columns == ["SMILES", "a", "value"]


def test_median_mode_mean_rules(spark):
    rows = [(1.0, 5.0, None), (2.0, 5.0, None), (3.0, 2.0, None), (4.0, 2.0, None), (None, 9.0, None), (INF, None, None)]
    df = frame(spark, rows, "a double, b double, c double")
    assert moments.exact_medians(df, ["a", "b", "c"]) == {"a": 2.5, "b": 5.0, "c": None}
    assert moments.exact_modes(df, ["a", "b"]) == {"a": 1.0, "b": 2.0}
    assert moments.exact_means(df, ["a"]) == {"a": 2.5}


def test_exact_median_against_numpy_with_a_hot_value(spark):
    rng = np.random.default_rng(3)
    x = rng.lognormal(0, 6, 30_001)
    y = np.where(rng.random(30_001) < 0.4, 0.0, rng.normal(size=30_001))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).repartition(7)
    got = moments.exact_medians(df, ["x", "y"])
    assert got == {"x": float(np.median(x)), "y": float(np.median(y))}


def test_impute_orders_and_drops(spark):
    df = frame(spark, [("n", 1, 1.0, None), ("m", 0, None, None)], "Name string, Label int, a double, b double")
    out = impute.impute(df, "mean")
    assert out.table.columns == ["a", "Label"] and out.dropped == ("b",)
    reg = frame(spark, [(1.0, 2.0, "C"), (2.0, None, "N")], "value double, a double, SMILES string")
    assert impute.impute(reg, "median", "regression").table.columns == ["SMILES", "a", "value"]
    with pytest.raises(MissingColumnError):
        impute.impute(reg, "mean")


def test_preprocess_equals_its_parts(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 6))
    x[rng.random(x.shape) < 0.25] = np.nan
    x[:, 4] = np.nan
    x[5, 0] = INF
    pdf = pd.DataFrame(x, columns=list("abcdef")).assign(Label=np.arange(60) % 2)
    pdf = pdf.astype(object).where(pdf.notna(), None)
    df = spark.createDataFrame(pdf, "a double, b double, c double, d double, e double, f double, Label int")
    whole = preprocess_all(df, 0.5, 0.5, "median")
    step = clean.drop_high_nan_rows(clean.replace_inf(df), 0.5)
    step = clean.drop_high_nan_cols(step, 0.5)
    parts = impute.impute(step, "median").table
    assert whole.table.columns == parts.columns
    assert sorted(map(tuple, whole.table.collect())) == sorted(map(tuple, parts.collect()))
    assert "e" not in whole.table.columns


def test_low_variance_is_strict_and_population(spark):
    df = frame(spark, [(0.0, 0.0, 1.0), (1.0, 2.0, 1.0)], "a double, b double, c double")
    assert prune.low_variance(df, ["a", "b", "c"], 0.25).kept == ["b"]
    with pytest.raises(EmptySelectionError):
        prune.low_variance(df, ["a", "c"], 0.25)


def test_pair_sums_match_pandas_with_gaps_and_any_partitioning(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5)) * [1, 10, 1e-3, 1, 1] + [0, 1e6, 0, 5, 0]
    x[:, 3] = x[:, 0] * 2 + 1
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 4] = 7.0
    pdf = pd.DataFrame(x, columns=list("abcde"))
    want = pdf.corr()
    clean_pdf = pdf.astype(object).where(pdf.notna(), None)
    df = spark.createDataFrame(clean_pdf, "a double, b double, c double, d double, e double")
    for parts, strip in ((1, 1024), (5, 1024), (3, 2)):
        table = gram.gram_table(df.repartition(parts), list("abcde"), strip=strip)
        for r in gram.correlations(table).collect():
            expected = want.iloc[r["i"], r["j"]]
            if np.isnan(expected):
                assert r["r"] is None
            else:
                assert abs(r["r"] - expected) < 1e-9
        assert gram.variances(table).count() == 5


def corr_frame(spark):
    """b repeats a, c is close to a, d is independent; target follows a with c best."""
    rng = np.random.default_rng(7)
    a = rng.normal(size=300)
    c = a + 0.05 * rng.normal(size=300)
    d = rng.normal(size=300)
    pdf = pd.DataFrame({"a": a, "b": 2 * a + 1, "c": c, "d": d, "value": c + 0.01 * rng.normal(size=300)})
    return spark.createDataFrame(pdf)


def test_correlation_modes(spark):
    df = corr_frame(spark)
    f = list("abcd")
    run = lambda mode, task, imp=None: prune.high_correlation(df, f, "value", 0.95, mode, task, imp).kept
    assert run("upper", "classification") == ["a", "d"] == run("lower", "classification") == run("upper", "regression")
    assert run("lower", "regression") == ["c", "d"]
    assert run("target_based", "classification") == ["c", "d"]
    assert run("target_based", "regression") == ["c", "d"]


def test_tie_rules_differ_by_task(spark):
    df = corr_frame(spark).select("a", "b", "value")
    run = lambda task, imp: prune.high_correlation(df, ["a", "b"], "value", 0.95, "target_based", task, imp).kept
    equal, first, second = (lambda s: (lambda names: s))({"a": 1.0, "b": 1.0}), lambda n: {"a": 2.0}, lambda n: {"b": 2.0}
    assert run("classification", equal) == ["b"] and run("regression", equal) == ["a"]
    assert run("classification", first) == ["a"] == run("regression", first)
    assert run("classification", second) == ["b"] == run("regression", second)

    def broken(names):
        raise RuntimeError("no fit")

    out = prune.high_correlation(df, ["a", "b"], "value", 0.95, "target_based", "regression", broken)
    assert out.kept == ["a"] and "no fit" in out.notes[0]


def test_greedy_skips_settled_edges(spark):
    # 0-1 and 1-2 are edges; greedy removes 1 first and then leaves 2 alone.
    scored = spark.createDataFrame(
        [(0, 1, 0.9, 0.5, 0.0, 0.0), (1, 2, 0.5, 0.4, 0.0, 0.0)], "i int, j int, ti double, tj double, mi double, mj double"
    )
    assert prune.greedy_removals(scored) == {1}
    every = {r["w"] for r in scored.select(prune.weaker_side(True).alias("w")).collect()}
    assert every == {1, 2}


def test_optimize_all_puts_ids_first_for_values(spark):
    df = corr_frame(spark).withColumn("k", F.lit(1.0)).withColumn("SMILES", F.lit("C"))
    out = optimize_all(df, 0.05, 0.95, task="regression")
    assert out.table.columns == ["SMILES", "c", "d", "value"]
    assert set(out.kept) | set(out.removed) == {"a", "b", "c", "d", "k"}


def test_schema_checks(spark):
    df = frame(spark, [(1, "x")], "a int, s string")
    with pytest.raises(NonNumericColumnError, match="s"):
        feature_columns(df)
    with pytest.raises(MissingColumnError, match="zz"):
        select_features(df, ["a", "zz"])


def test_stages_chain_save_and_stream_free(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel

    from descria.operators import stages

    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 4))
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(Label=np.arange(80) % 2, k=1.0)
    pdf["d"] = pdf["a"] * 3
    df = spark.createDataFrame(pdf).withColumn("b", F.when(F.rand(1) > 0.2, F.col("b")))
    chain = Pipeline(
        stages=[
            stages.ReplaceInfinite(),
            stages.DropSparseRows(threshold=0.5),
            stages.DropSparseColumns(threshold=0.5),
            stages.FillMissing(strategy="median"),
            stages.DropLowVariance(threshold=0.05),
            stages.DropCorrelated(threshold=0.95, mode="upper"),
        ]
    ).fit(df)
    assert chain.transform(df).columns == ["a", "b", "c", "Label"]
    chain.write().save(str(tmp_path / "chain"))
    again = PipelineModel.load(str(tmp_path / "chain"))
    assert sorted(map(tuple, again.transform(df).collect())) == sorted(map(tuple, chain.transform(df).collect()))
    with pytest.raises((TypeError, ValueError)):
        stages.DropSparseRows(threshold=1.5)


def test_offsets_after_missing_cells_keep_their_variance(spark):
    df = spark.range(400).selectExpr(
        "IF(id < 100, NULL, 1e8 + 4 * (id % 2)) AS a", "CAST(id % 7 AS DOUBLE) AS b", "1e8 + id % 2 + 0.1 * (id % 7) AS value"
    ).coalesce(1)
    table = gram.gram_table(df, ["a", "b", "value"])
    spread = {r["i"]: r["variance"] for r in gram.variances(table).collect()}
    assert spread[0] == pytest.approx(4.0)
    want = df.toPandas().corr()
    got = {(r["f1"], r["f2"]): r["r"] for r in gram.corr_matrix(df, ["a", "b", "value"]).collect()}
    for pair, r in got.items():
        assert r == pytest.approx(want.loc[pair], abs=1e-6)
    kept = prune.optimize_columns(df, ["a", "b"], "value", 0.05, 0.95, task="regression", centres={"a": 1e8 + 2, "b": 3.0})
    assert kept.kept == ["a", "b"]


def test_constant_columns_have_no_variance(spark):
    df = spark.range(1000).selectExpr("0.1 AS a", "1e8 + 0.3 AS b", "CAST(id AS DOUBLE) AS c").repartition(7)
    got = {r["i"]: r["variance"] for r in gram.variances(gram.gram_table(df, ["a", "b", "c"])).collect()}
    assert got[0] == 0.0 and got[1] == 0.0 and got[2] > 0
