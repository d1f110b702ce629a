"""Column fills. Statistics are exact; the fill itself is a lazy projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from descria.columns import double_sql, finite_sql, ident, replace_columns, require_columns
from descria.operators import moments

STRATEGIES = {
    "mean": moments.exact_means,
    "median": moments.exact_medians,
    "most_frequent": moments.exact_modes,
    "mode": moments.exact_modes,
}


@dataclass(frozen=True)
class Imputed:
    """Filled table, the fill per column, and columns dropped for having no value at all."""

    table: DataFrame
    fills: Mapping[str, float]
    dropped: tuple[str, ...]


def fill_values(df: DataFrame, columns: Sequence[str], strategy: str) -> dict[str, float | None]:
    """Fill value per column from its non-missing rows; None when there are none."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; choose from {sorted(STRATEGIES)}")
    return STRATEGIES[strategy](df, list(columns))


def apply_fills(df: DataFrame, fills: Mapping[str, float]) -> DataFrame:
    """Replace missing and infinite cells by known constants; runs on streams too."""
    return replace_columns(df, {c: f"coalesce({finite_sql(c)}, {double_sql(v)})" for c, v in fills.items()})


def impute(
    df: DataFrame,
    strategy: str = "mean",
    task: str = "classification",
    protected: Sequence[str] = (),
) -> Imputed:
    """Fill every descriptor column with its mean, median or most frequent value.

    Classification: ``Name`` is dropped, ``Label`` must exist, order is protected
    columns, features, ``Label``. Regression: ``SMILES`` first, features, ``value``
    last. ``protected`` names further key columns that pass through untouched.
    """
    df = df.drop("Name")
    target = "Label" if task == "classification" else "value"
    if task == "classification":
        require_columns(df, ["Label"])
    ids = [c for c in df.columns if c == "SMILES" or c in set(protected) - {target}]
    features = [c for c in df.columns if c not in ids and c != target]
    fills = fill_values(df, features, strategy)
    dropped = tuple(c for c in features if fills[c] is None)
    known = {c: v for c, v in fills.items() if v is not None}
    order = [*ids, *known, *([target] if target in df.columns else [])]
    return Imputed(apply_fills(df, known).selectExpr(*[ident(c) for c in order]), known, dropped)


def median_fill_prep(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, dict[str, float]]:
    """Median fill used before variance and correlation; an empty column becomes 0.

    Returns the filled table and the fills.
    """
    medians = fill_values(df, features, "median")
    fills = {c: 0.0 if m is None else m for c, m in medians.items()}
    return apply_fills(df, fills), fills


def median_impute_global(df: DataFrame, features: Sequence[str]) -> Imputed:
    """Median fill used before modelling and screening; empty columns are dropped and listed."""
    medians = fill_values(df, features, "median")
    known = {c: m for c, m in medians.items() if m is not None}
    dropped = tuple(c for c in features if medians[c] is None)
    return Imputed(apply_fills(df, known).drop(*dropped), known, dropped)
