"""Batch scoring of a compound library."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descria.columns import quoted, require_columns, select_features
from descria.errors import DescriaError
from descria.operators import align, structures
from descria.operators.impute import apply_fills, fill_values
from descria.operators.score import PREDICTION, has_probability, score, threshold_select
from descria.storage import materialise

SCREENED = "screened"


@dataclass(frozen=True)
class Screening:
    """Selected library rows with their prediction, and the ordinals of those rows."""

    compounds: DataFrame
    indices: DataFrame


def library_fills(
    library: DataFrame, features: Sequence[str], medians: str | Mapping[str, float] = SCREENED
) -> dict[str, float]:
    """Fill values: exact medians of the screened table, or given ones (from training)."""
    if medians != SCREENED:
        return dict(medians)
    found = fill_values(library, features, "median")
    empty = [f for f in features if found[f] is None]
    if empty:
        raise DescriaError(f"no value at all in {empty}; pass medians from training")
    return found


def predict_library(
    model: PipelineModel,
    library: DataFrame,
    features: Sequence[str],
    task: str,
    medians: str | Mapping[str, float] = SCREENED,
) -> DataFrame:
    """Library rows (original cells) plus ``prediction_value``.

    The model sees filled copies of the features. One projection after the fill
    values are known, so with given ``medians`` the library may be a stream.
    """
    require_columns(library, features)
    fills = library_fills(library, features, medians)
    others = [c for c in library.columns if c not in set(features)]
    kept = F.struct(*[quoted(c) for c in features]).alias("__original")
    staged = library.select(*[quoted(c) for c in others], *[quoted(c) for c in features], kept)
    scored = score(model, apply_fills(staged, fills), task)
    original = [F.col("__original")[c].alias(c) if c in set(features) else quoted(c) for c in library.columns]
    return scored.select(*original, PREDICTION)


def virtual_screening(
    model: PipelineModel,
    library: DataFrame,
    features: Sequence[str],
    task: str,
    threshold: float = 10.0,
    medians: str | Mapping[str, float] = SCREENED,
) -> Screening:
    """Score a library, which must carry row ordinals, and keep the rows that meet the threshold."""
    require_columns(library, [align.ROW])
    scored = predict_library(model, library, features, task, medians)
    hits = threshold_select(scored, task, threshold, has_probability(model))
    return Screening(hits, hits.select(align.ROW))


@dataclass(frozen=True)
class Extraction:
    molecules: DataFrame
    not_found: DataFrame
    counts: DataFrame


def extract_molecules(records: DataFrame, indices: DataFrame) -> Extraction:
    """Structure records of the selected ordinals, ordinals not in the file, and counts."""
    asked = align.asked_ordinals(indices)
    return Extraction(
        align.extract_by_index(records, asked, "valid", stored=True),
        align.indices_not_found(records, asked, stored=True),
        align.extraction_counts(records, asked, "valid", stored=True),
    )


def screen_and_extract(
    model: PipelineModel,
    library: DataFrame,
    records: DataFrame,
    features: Sequence[str],
    task: str,
    threshold: float = 10.0,
    medians: str | Mapping[str, float] = SCREENED,
) -> tuple[Screening, Extraction | None]:
    """Both steps with one scoring pass; nothing is extracted when nothing was selected."""
    screened = virtual_screening(model, library, features, task, threshold, medians)
    hits = materialise(screened.compounds, "hits")
    chosen = Screening(hits, hits.select(align.ROW))
    if chosen.indices.isEmpty():
        return chosen, None
    return chosen, extract_molecules(records, chosen.indices)


def custom_screening(
    model: PipelineModel,
    compounds: DataFrame,
    features: Sequence[str],
    task: str,
    smiles_column: str = "SMILES",
    medians: str | Mapping[str, float] = SCREENED,
) -> DataFrame:
    """Predictions for every user compound: ``(Name or Original_Index, Prediction)``.

    A missing structure is an error. Descriptors are computed on the fly.
    """
    if structures.RECORD not in compounds.columns:
        require_columns(compounds, [smiles_column])
        if not compounds.filter(quoted(smiles_column).isNull()).isEmpty():
            raise DescriaError(f"missing values in column {smiles_column!r}")
        compounds = compounds.withColumnRenamed(smiles_column, structures.SMILES)
    identity = "Name" if "Name" in compounds.columns else align.ROW
    described = structures.constitutional_descriptors(compounds)
    # Descriptors are costly and the fills read them again: compute them once.
    table = materialise(select_features(described, features, keep=[identity]), "described")
    scored = predict_library(model, table, features, task, medians)
    name = "Name" if identity == "Name" else "Original_Index"
    return scored.select(F.col(identity).alias(name), F.col(PREDICTION).alias("Prediction"))
