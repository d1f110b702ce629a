"""Shape of the physical plans that have to hold at scale."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from descria.operators import clean, gram, impute, metrics, moments, prune, split
from descria.operators.structures import standardize_filter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def test_row_operators_do_not_shuffle(lineitem):
    out = clean.drop_high_nan_rows(clean.replace_inf(lineitem), 0.5)
    out = impute.apply_fills(out, {"l_tax": 0.0})
    assert "Exchange" not in plan(out)


def test_statistics_shuffle_partials_only_and_prune_columns(lineitem):
    text = plan(moments.column_profile(lineitem, NUMERIC))
    assert text.count("Exchange") == 1 and "partial_" in text
    assert "l_shipdate" not in text and "l_partkey" not in text


def test_pair_sums_have_one_shuffle_of_partials(lineitem):
    text = plan(gram.gram_table(lineitem, NUMERIC))
    assert text.count("Exchange") == 1 and "MapInArrow" in text and "partial_sum" in text


def test_pruned_projection_reaches_the_scan(lineitem):
    kept = prune.low_variance(lineitem, NUMERIC, 0.01)
    text = plan(kept.table.select("l_quantity"))
    assert "ReadSchema: struct<l_quantity:double>" in text


def test_split_is_a_row_predicate(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    train, held = split.split_stratified(orders, "o_orderkey", "o_orderstatus")
    folded = split.mark_folds(orders, "o_orderkey", 5)
    for df in (train, held, folded):
        assert "Exchange" not in plan(df) and "Window" not in plan(df)


def test_structure_filter_is_narrow(spark):
    df = spark.range(10).select(F.lit("CCO").alias("SMILES"))
    assert "Exchange" not in plan(standardize_filter(df))


def test_class_metrics_need_one_pass(lineitem):
    flags = lineitem.select((F.col("l_tax") > 0.04).cast("int").alias("y"), (F.col("l_discount") > 0.05).cast("int").alias("p"))
    assert plan(metrics.confusion(flags, "y", "p")).count("FileScan") == 1


def test_row_filter_then_column_filter_plans_in_linear_time(spark):
    def seconds(n):
        df = spark.range(20).selectExpr(*[f"cast(id + {i} as double) as f{i}" for i in range(n)])
        start = time.perf_counter()
        kept = clean.drop_high_nan_cols(clean.drop_high_nan_rows(clean.replace_inf(df), 0.5), 0.5)
        assert len(kept.columns) == n
        return time.perf_counter() - start

    seconds(16)
    assert seconds(64) < 4 * seconds(32) + 5
