"""Sinks. Every writer is a plain distributed write; nothing goes through the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from descria.columns import quoted
from descria.sources.readers import RECORD_END


def sink_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Table with a header and no index; NULL cells are written empty."""
    df.write.mode(mode).csv(path, header=True, nullValue="", emptyValue="")
    return path


def sink_sdf(records: DataFrame, path: str, column: str = "record", mode: str = "errorifexists") -> str:
    """Records with their original text, each closed by the record separator.

    Indexed records are written in ordinal order across the files.
    """
    records = records.orderBy("row_idx") if "row_idx" in records.columns else records
    records.select(quoted(column).alias("value")).write.mode(mode).option("lineSep", RECORD_END).text(path)
    return path


def sink_lines(df: DataFrame, column: str, path: str, mode: str = "errorifexists") -> str:
    df.select(quoted(column).cast("string").alias("value")).write.mode(mode).text(path)
    return path


def sink_feature_list(spark: SparkSession, features: Sequence[str], path: str, mode: str = "errorifexists") -> str:
    """Feature names, one per line, in one file so that the order survives."""
    table = spark.createDataFrame([(k, f) for k, f in enumerate(features)], "pos int, feature string")
    return sink_lines(table.orderBy("pos").coalesce(1), "feature", path, mode)


def sink_indices(selected: DataFrame, path: str, column: str = "row_idx", mode: str = "errorifexists") -> str:
    """Selected row ordinals, one integer per line, in ascending order across the files."""
    return sink_lines(selected.select(column).orderBy(column), column, path, mode)


def sink_model(
    model: PipelineModel, path: str, params: Mapping[str, object], algorithm: str, mode: str = "errorifexists"
) -> str:
    """Model folder ``<path>/model`` and best parameters as the table ``<path>/params``."""
    writer = model.write()
    (writer.overwrite() if mode == "overwrite" else writer).save(f"{path}/model")
    spark = SparkSession.active()
    rows = [("algorithm", algorithm), *[(k, str(v)) for k, v in params.items()]]
    spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode(mode).parquet(f"{path}/params")
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")


def load_params(spark: SparkSession, path: str) -> dict[str, str]:
    return {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/params").collect()}
