"""Column scaling as plain projections from two statistics per column."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from descria.columns import double_sql, ident, replace_columns
from descria.operators.moments import column_profile


@dataclass(frozen=True)
class Scaling:
    """Per column: value to subtract and positive number to divide by."""

    offset: Mapping[str, float]
    width: Mapping[str, float]

    def apply(self, df: DataFrame) -> DataFrame:
        return replace_columns(
            df,
            {
                c: f"(CAST({ident(c)} AS DOUBLE) - {double_sql(self.offset[c])}) / {double_sql(self.width[c])}"
                for c in self.offset
            },
        )


def _nonzero(w: float | None) -> float:
    return w if w else 1.0


def fit_standard(df: DataFrame, features: Sequence[str]) -> Scaling:
    """Mean and population deviation; a constant column is only centred."""
    rows = {r["feature"]: r for r in column_profile(df, features).collect()}
    return Scaling(
        {c: rows[c]["mean"] or 0.0 for c in features},
        {c: _nonzero(math.sqrt(rows[c]["variance"] or 0.0)) for c in features},
    )


def fit_minmax(df: DataFrame, features: Sequence[str]) -> Scaling:
    """Minimum and range; a constant column maps to 0."""
    rows = {r["feature"]: r for r in column_profile(df, features).collect()}
    return Scaling(
        {c: rows[c]["min"] or 0.0 for c in features},
        {c: _nonzero((rows[c]["max"] or 0.0) - (rows[c]["min"] or 0.0)) for c in features},
    )


def scale_standard(df: DataFrame, features: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Z-scores; statistics come from ``fit_on`` (the training rows) when given."""
    return fit_standard(df if fit_on is None else fit_on, features).apply(df)


def scale_minmax(df: DataFrame, features: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Map to [0, 1] by the observed range."""
    return fit_minmax(df if fit_on is None else fit_on, features).apply(df)
