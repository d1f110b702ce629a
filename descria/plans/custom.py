"""User compounds from raw structures to selected records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from descria.columns import require_columns
from descria.operators import align, screen, structures
from descria.operators.clean import drop_high_nan_rows, replace_inf
from descria.operators.impute import apply_fills
from descria.operators.score import has_probability, score, threshold_select
from descria.storage import materialise


@dataclass(frozen=True)
class CustomRun:
    predictions: DataFrame
    selected: DataFrame


def standardise_describe_screen(
    model: PipelineModel,
    compounds: DataFrame,
    features: Sequence[str],
    task: str,
    threshold: float,
    nan_threshold: float = 0.5,
    medians: str | Mapping[str, float] = screen.SCREENED,
) -> CustomRun:
    """Structure filter, descriptors, row filter and fill, prediction, threshold.

    ``predictions`` has every surviving compound, ``selected`` the original rows
    (with their structure text) that meet the threshold. Compounds carry
    ``row_idx``, so selected structures are joined back by ordinal.
    """
    require_columns(compounds, [align.ROW])
    kept = structures.standardize_filter(compounds)
    described = structures.constitutional_descriptors(kept)
    # Descriptors are costly and read several times below: compute them once.
    narrow = materialise(described.select(align.ROW, *features), "described")
    table = drop_high_nan_rows(replace_inf(narrow), nan_threshold, features)
    filled = apply_fills(table, screen.library_fills(table, features, medians))
    scored = materialise(score(model, filled, task).select(align.ROW, "prediction_value"), "scored")
    hits = threshold_select(scored, task, threshold, has_probability(model))
    return CustomRun(scored, align.extract_by_index(compounds, hits.select(align.ROW)))
