"""Classification and regression metrics as aggregates over a prediction table."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from descria.columns import quoted
from descria.functions.numeric import safe_ratio, zero_if_null
from descria.storage import materialise

# Actual values at or below this size are left out of the percentage error.
MAPE_FLOOR = 1e-8
# Score ranges of the running count: at least so many, and more when a range would hold more distinct scores.
_AUC_RANGES = 256
_AUC_RANGE_SCORES = 1_000_000


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row ``(tn, fp, fn, tp)`` for 0/1 columns."""
    a, p = quoted(actual) == 1, quoted(predicted) == 1
    return df.agg(
        F.count_if(~a & ~p).alias("tn"),
        F.count_if(~a & p).alias("fp"),
        F.count_if(a & ~p).alias("fn"),
        F.count_if(a & p).alias("tp"),
    )


def _class_scores() -> dict[str, Column]:
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    two_by_two = (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp") > 0) & (
        (F.col("tp") + F.col("fn") + F.col("fp") > 0) & (F.col("tn") + F.col("fp") + F.col("fn") > 0)
    )
    return {
        "accuracy": safe_ratio(tp + tn, tn + fp + fn + tp),
        "f1_score": zero_if_null(safe_ratio(2 * tp, 2 * tp + fp + fn)),
        "precision": zero_if_null(safe_ratio(tp, tp + fp)),
        "recall": zero_if_null(safe_ratio(tp, tp + fn)),
        "specificity": F.when(two_by_two, zero_if_null(safe_ratio(tn, tn + fp))),
    }


def _long(wide: DataFrame, columns: list[str]) -> DataFrame:
    """One-row wide table to ``(metric, value)`` rows."""
    return wide.unpivot([], [quoted(c) for c in columns], "metric", "value")


def metrics_cls(df: DataFrame, actual: str, predicted: str, score: str | None = None) -> DataFrame:
    """``(metric, value)``: accuracy, F1, precision, recall of class 1, specificity, ROC-AUC.

    Ratios without a denominator are 0; specificity is missing unless both classes
    occur; ROC-AUC is missing without a score column or with one class only.
    """
    table = confusion(df, actual, predicted)
    scores = _class_scores()
    out = _long(table.select(*[c.alias(n) for n, c in scores.items()]), list(scores))
    if score is None:
        auc = table.select(F.lit("roc_auc").alias("metric"), F.lit(None).cast("double").alias("value"))
    else:
        auc = roc_auc(df, actual, score).select(F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value"))
    return out.unionByName(auc)


def roc_auc(df: DataFrame, actual: str, score: str) -> DataFrame:
    """Exact tie-aware area under the ROC curve as a one-row table.

    Rows collapse to one group per distinct score first, so a score shared by many
    rows is a single row. The running count of negatives is built in two levels:
    totals per score range, then a running sum inside each range, so no task has
    to order all scores.
    """
    pos, neg = F.count_if(quoted(actual) == 1), F.count_if(quoted(actual) == 0)
    clean = df.filter(quoted(score).isNotNull() & quoted(actual).isNotNull())
    groups = materialise(
        clean.groupBy(quoted(score).cast("double").alias("s")).agg(pos.alias("p"), neg.alias("n")), "scores"
    )
    ranges = max(_AUC_RANGES, -(-groups.count() // _AUC_RANGE_SCORES))
    cuts = groups.approxQuantile("s", [k / ranges for k in range(1, ranges)], 1.0 / (4 * ranges))
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    binned = Bucketizer(splits=splits, inputCol="s", outputCol="b").transform(groups)
    totals = binned.groupBy("b").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    # One row per range from here on.
    upto = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("b", F.coalesce(F.sum("bn").over(upto), F.lit(0)).alias("before"))
    inside = Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    parts = binned.join(F.broadcast(offsets), "b").select("p", "n", below.alias("below"))
    area = F.sum(F.col("p").cast("double") * (F.col("below").cast("double") + F.col("n").cast("double") / 2))
    return parts.agg(
        safe_ratio(area, F.sum("p").cast("double") * F.sum("n").cast("double")).alias("roc_auc")
    )


def metrics_reg(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """``(metric, value)``: R2, MSE, RMSE, MAE and MAPE in percent from one aggregate.

    MAPE runs over rows whose actual value is away from zero and is infinite when
    there are none.
    """
    y, p = quoted(actual).cast("double"), quoted(predicted).cast("double")
    error = y - p
    usable = F.abs(y) > F.lit(MAPE_FLOOR)
    sums = df.agg(
        F.count(error).alias("n"),
        F.sum(error * error).alias("sse"),
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop(y).alias("var_y"),
        (F.avg(F.when(usable, F.abs(error) / F.abs(y))) * 100.0).alias("mape"),
    )
    sst = F.col("var_y") * F.col("n")
    r2 = F.when(sst > 0, 1.0 - F.try_divide(F.col("sse"), sst)).when(F.col("sse") == 0, 1.0).otherwise(0.0)
    wide = sums.select(
        r2.alias("r2_score"),
        F.col("mse"),
        F.sqrt("mse").alias("rmse"),
        F.col("mae"),
        F.coalesce("mape", F.lit(float("inf"))).alias("mape"),
    )
    return _long(wide, wide.columns)


def predictions_cls(df: DataFrame, actual: str, predicted: str, probability: str | None = None) -> DataFrame:
    """``Actual, Predicted`` and, when there are probabilities, ``Probability_Class1``."""
    columns = [quoted(actual).alias("Actual"), quoted(predicted).cast("int").alias("Predicted")]
    if probability is not None:
        columns.append(quoted(probability).alias("Probability_Class1"))
    return df.select(*columns)


def predictions_reg(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """``Actual_<target>, Predicted``."""
    return df.select(quoted(actual).alias(f"Actual_{actual}"), quoted(predicted).alias("Predicted"))


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
