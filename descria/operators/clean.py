"""Turning infinities into missing cells and dropping sparse rows and columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descria.columns import (
    CLASS_PROTECTED,
    array_sql,
    gap_sql,
    ident,
    is_fractional,
    name_at,
    numeric_columns,
    replace_columns,
)
from descria.functions.numeric import is_infinite
from descria.operators.moments import cells, missing_counts


def replace_inf(df: DataFrame) -> DataFrame:
    """Every infinity (and NaN) in a floating-point column becomes NULL; one projection."""
    # NaN sorts above infinity, so one comparison rejects all three.
    keep = "CASE WHEN abs({c}) < CAST('Infinity' AS DOUBLE) THEN {c} END"
    return replace_columns(
        df, {f.name: keep.format(c=ident(f.name)) for f in df.schema.fields if is_fractional(f)}
    )


def inf_report(df: DataFrame, count_name: str = "Original_Inf_Count") -> DataFrame:
    """``(Feature, count)`` of the columns that hold at least one infinity."""
    columns = numeric_columns(df)
    hits = cells(df, columns, raw=True).filter(is_infinite(F.col("v")))
    return (
        hits.groupBy("pos")
        .agg(F.count(F.lit(1)).alias(count_name))
        .select(name_at(F.col("pos"), columns).alias("Feature"), count_name)
    )


def max_missing(threshold: float, n_columns: int) -> int:
    """Largest number of missing cells whose share of ``n_columns`` is within the threshold."""
    if n_columns == 0:
        return 0
    allowed = min(n_columns, max(0, math.floor(threshold * n_columns)))
    while allowed < n_columns and (allowed + 1) / n_columns <= threshold:
        allowed += 1
    while allowed > 0 and allowed / n_columns > threshold:
        allowed -= 1
    return allowed


def drop_high_nan_rows(
    df: DataFrame, threshold: float = 0.5, counted: Sequence[str] | None = None
) -> DataFrame:
    """Keep rows whose share of missing cells over ``counted`` (default: all columns) is ``<= threshold``.

    A stateless row filter, so it also runs on streams and fuses with the scan. It isn't moved below the projection
    that made the columns: there it would hold the expression of every output column, and the constraints that are inferred
    from it double with each column.
    """
    columns = list(counted or df.columns)
    fields = {f.name: f for f in df.schema.fields}
    gaps = array_sql(gap_sql(fields[c]) for c in columns)
    # floor(rand()) is always 0; only as a non-deterministic term does it keep the filter in its place.
    return df.filter(f"size(filter({gaps}, g -> g)) + floor(rand()) <= {max_missing(threshold, len(columns))}")


def row_is_kept(df: DataFrame, threshold: float, counted: Sequence[str] | None = None) -> Column:
    """The predicate of :func:`drop_high_nan_rows` as a boolean column."""
    columns = list(counted or df.columns)
    fields = {f.name: f for f in df.schema.fields}
    gaps = array_sql(gap_sql(fields[c]) for c in columns)
    return F.expr(f"size(filter({gaps}, g -> g)) <= {max_missing(threshold, len(columns))}")


def sparse_columns(counts: DataFrame, threshold: float) -> list[str]:
    """Names whose missing share exceeds the threshold, from :func:`missing_counts`."""
    over = counts.filter(F.try_divide(F.col("n_missing").cast("double"), F.col("n_rows")) > F.lit(threshold))
    return [r["feature"] for r in over.select("feature").collect()]


def retained_order(
    columns: Sequence[str], sparse: Sequence[str], protected: Sequence[str], task: str
) -> list[str]:
    """Column order after the sparse columns went.

    Protected columns that failed the test come back at the end; regression tables
    then put ``SMILES`` first and ``value`` last.
    """
    failed = set(sparse)
    kept = [c for c in columns if c not in failed]
    kept += [c for c in protected if c in set(columns) and c in failed]
    if task == "regression":
        kept = (
            [c for c in kept if c == "SMILES"]
            + [c for c in kept if c not in ("SMILES", "value")]
            + [c for c in kept if c == "value"]
        )
    return kept


def drop_high_nan_cols(
    df: DataFrame,
    threshold: float = 0.5,
    protected: Sequence[str] = CLASS_PROTECTED,
    task: str = "classification",
) -> DataFrame:
    """Keep columns whose share of missing cells is ``<= threshold``; protected ones always stay."""
    sparse = sparse_columns(missing_counts(df, df.columns), threshold)
    return df.selectExpr(*[ident(c) for c in retained_order(df.columns, sparse, protected, task)])
