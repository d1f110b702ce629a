"""Composed preparation steps with a per-step report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descria.columns import CLASS_PROTECTED, VALUE_PROTECTED, ident, is_numeric
from descria.operators import clean, prune
from descria.operators.impute import apply_fills, fill_values, median_fill_prep
from descria.operators.importance import importance_lasso, importance_rf
from descria.operators.moments import missing_counts
from descria.operators.structures import standardize_filter, standardize_report

REPORT_SCHEMA = "step string, rows_in bigint, rows_out bigint, cols_in int, cols_out int, detail string"


@dataclass(frozen=True)
class Prepared:
    """Prepared table, one report row per step, and the fill values used."""

    table: DataFrame
    report: DataFrame
    fills: Mapping[str, float]


def preprocess_all(
    df: DataFrame,
    compounds_nan_threshold: float = 0.5,
    descriptors_nan_threshold: float = 0.5,
    imputation_method: str = "mean",
    task: str = "classification",
    protected: Sequence[str] = (),
    counted: Sequence[str] | None = None,
) -> Prepared:
    """Infinities to missing, sparse rows out, sparse columns out, fill the rest.

    Column shares are taken after the row filter, in the same pass that counts the
    rows for the report and takes the means; medians and modes need further passes.
    Nothing is filled when nothing is missing. The target never leaves its row. ``counted`` restricts
    the row rule to some columns (default: all).
    """
    spark = df.sparkSession
    target = "Label" if task == "classification" else "value"
    always = [*protected, *(CLASS_PROTECTED if task == "classification" else VALUE_PROTECTED)]
    finite = clean.replace_inf(df)
    columns = list(finite.columns)

    keep = clean.row_is_kept(finite, compounds_nan_threshold, counted)
    counts = missing_counts(finite, columns, keep)
    seen = {r["feature"]: r for r in counts.collect()}
    rows_in = next(iter(seen.values()))["n_rows_in"] if seen else 0
    rows_out = next(iter(seen.values()))["n_rows"] if seen else 0
    share = {c: seen[c]["n_missing"] / rows_out if seen and rows_out else 0.0 for c in columns}
    sparse = [c for c in columns if share[c] > descriptors_nan_threshold]
    order = clean.retained_order(columns, sparse, always, "classification")
    kept = clean.drop_high_nan_rows(finite, compounds_nan_threshold, counted).selectExpr(*[ident(c) for c in order])

    numeric = {f.name for f in df.schema.fields if is_numeric(f)}
    features = [c for c in order if c not in set(always) and c != target and c in numeric]
    gaps = sum(seen[c]["n_missing"] for c in features) if seen else 0
    fills: dict[str, float] = {}
    dropped: list[str] = []
    if gaps:
        if imputation_method == "mean":
            found = {c: seen[c]["mean"] for c in features}
        else:
            found = fill_values(kept, features, imputation_method)
        dropped = [c for c in features if found[c] is None]
        fills = {c: v for c, v in found.items() if v is not None}
    table = apply_fills(kept, fills) if fills else kept
    final = _final_order([c for c in order if c not in dropped], features, target, task, protected)
    table = table.selectExpr(*[ident(c) for c in final])

    n = len(columns)
    steps = [
        ("replace_inf", rows_in, rows_in, n, n, ""),
        ("drop_high_nan_rows", rows_in, rows_out, n, n, f"threshold={compounds_nan_threshold}"),
        ("drop_high_nan_cols", rows_out, rows_out, n, len(order), ",".join(c for c in columns if c not in order)),
        (f"impute_{imputation_method}", rows_out, rows_out, len(order), len(final), f"filled={gaps}"),
    ]
    return Prepared(table, spark.createDataFrame(steps, REPORT_SCHEMA), fills)


def _final_order(
    order: Sequence[str], features: Sequence[str], target: str, task: str, protected: Sequence[str]
) -> list[str]:
    """Classification loses ``Name`` and ends with the label; regression is SMILES, Name, features, value."""
    wanted = set(features)
    body = [c for c in order if c in wanted]
    last = [c for c in order if c == target]
    ids = [c for c in order if c in set(protected) - {target}]
    front = ["SMILES"] if task == "classification" else ["SMILES", "Name"]
    named = [c for c in front if c in order and c not in ids]
    rest = [c for c in order if c not in wanted and c not in {*last, *ids, *named, "Name"}]
    return [*ids, *named, *rest, *body, *last]


def optimize_all(
    df: DataFrame,
    variance_threshold: float = 0.05,
    correlation_threshold: float = 0.95,
    mode: str = "target_based",
    importance_model: str = "lasso",
    task: str = "classification",
    protected: Sequence[str] = (),
    target: str | None = None,
) -> prune.Pruned:
    """Variance filter then correlation filter, both from one scan.

    Regression fills missing cells with medians first (0 for an empty column) and
    puts ``SMILES`` first and the target last.
    """


    target = target or ("Label" if task == "classification" else "value")
    skip = {*protected, target, "SMILES", "Name"}
    features = [f.name for f in df.schema.fields if f.name not in skip and is_numeric(f)]
    data, fills = median_fill_prep(df, features) if task == "regression" else (df, None)

    def scores(names: Sequence[str]) -> Mapping[str, float]:
        fit = importance_lasso if importance_model == "lasso" else importance_rf
        return fit(data, list(names), target, task)

    result = prune.optimize_columns(
        data, features, target, variance_threshold, correlation_threshold, mode, task, scores, fills
    )
    if task == "regression":
        return prune.Pruned(
            prune.regression_order(result.table, target), result.kept, result.removed, result.notes
        )
    return result


def load_and_standardize(compounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Filtered compounds and the kept / removed counts."""
    return standardize_filter(compounds), standardize_report(compounds)


def step_report(steps: Sequence[tuple], spark) -> DataFrame:
    return spark.createDataFrame(list(steps), REPORT_SCHEMA)


def summarise(report: DataFrame) -> DataFrame:
    """Rows and columns removed per step."""
    return report.select(
        "step",
        "rows_in",
        "rows_out",
        (F.col("rows_in") - F.col("rows_out")).alias("rows_removed"),
        "cols_in",
        "cols_out",
        (F.col("cols_in") - F.col("cols_out")).alias("cols_removed"),
    )
