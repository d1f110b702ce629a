"""Scoring a stream of descriptor rows.

Cleaning with known fills, scoring and the threshold are stateless row plans, so
they need no watermark and no state; everything that fits statistics is batch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from descria.operators.clean import drop_high_nan_rows, replace_inf
from descria.operators.impute import apply_fills
from descria.operators.score import has_probability, score, threshold_select


def score_stream(
    stream: DataFrame,
    model: PipelineModel,
    features: Sequence[str],
    fills: Mapping[str, float],
    task: str,
    threshold: float,
    nan_threshold: float = 0.5,
) -> DataFrame:
    """Rows of an unbounded table that meet the threshold, with their prediction.

    ``fills`` come from training: a stream has no median of its own.
    """
    usable = drop_high_nan_rows(replace_inf(stream), nan_threshold, features)
    scored = score(model, apply_fills(usable, {f: fills[f] for f in features}), task)
    return threshold_select(scored, task, threshold, has_probability(model))


def write_hits(hits: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append hits as Parquet with exactly-once file commits; drains what is there and stops."""
    return (
        hits.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
