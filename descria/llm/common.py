"""Helpers that all operators of this package share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from descria.errors import DescriaError
from descria.storage import fresh_path, materialise, shared_dir, ship_package

__all__ = ["bit_map", "discard", "fresh_path", "materialise", "shared_dir", "ship_package", "narrow", "table", "map_arrow", "filter_arrow", "position"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def position(df: DataFrame, name: str) -> int:
    """Ordinal of the column spelled exactly ``name`` (the first, if several are)."""
    if name not in df.columns:
        raise DescriaError(f"column {name} is missing")
    return df.columns.index(name)


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns. Extra columns are ignored, also those that differ in case only or repeat a name."""
    places = [position(df, n) for n in names]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select([F.col(f"c{i}").alias(n) for i, n in zip(places, names, strict=True)])


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over the batches of each task; what its worker holds unused is given back after the task, as the worker lives on."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        release_unused()

    ship_package(df.sparkSession)
    return df.mapInArrow(work, schema)


def release_unused() -> None:
    """Gives free memory of this process back to the system: Arrow's, and where the C library can, its own."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def filter_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``fn`` passes some rows on; columns keep their names, also those that differ in case only or repeat a name."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return map_arrow(plain, fn, plain.schema).toDF(*df.columns)


def discard(df: DataFrame) -> None:
    """Deletes the folder of a table that ``materialise`` wrote and that nothing reads any more."""
    spark, folder = df.sparkSession, shared_dir(df.sparkSession).rstrip("/")
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        own = spark._jvm.org.apache.hadoop.fs.Path(path)
        if own.getParent().toUri().getPath() != spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath():
            raise DescriaError(f"{path} is not a table of the shared folder")
        own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def bit_map(keys: DataFrame, name: str, bits: int) -> np.ndarray:
    """One bit for each value of the leading ``bits`` bits of a long, set where a key has it: of fixed size."""
    place = F.shiftrightunsigned(name, 64 - bits)
    longs = keys.select(place.alias("place")).selectExpr("shiftright(place, 6) as at", "shiftleft(1L, cast(place & 63 as int)) as bit")
    out = np.zeros((1 << bits) // 64, np.int64)
    for r in longs.groupBy("at").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[r.at] = r.bits
    return out.view(np.uint8)


@contextmanager
def small_batches(spark: SparkSession, most_bytes: int = 4 << 20):
    """Jobs started inside hand Arrow batches of about ``most_bytes`` to Python; the session's own setting comes back afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most_bytes))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def crc32_of(column: Column) -> Column:
    return F.crc32(column.cast("string").cast("binary"))


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id written as text leaves ``rest``; a null id is never held out."""
    return F.coalesce(F.pmod(crc32_of(doc_id), F.lit(modulus)) == rest, F.lit(False))


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each starts (one more entry than texts). Null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_chunks(
    batches: Iterator[pa.RecordBatch], text_at: int, most_bytes: int = 1 << 20
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most ``most_bytes`` of text each, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, offsets = flat_text(batch.column(text_at))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            part = offsets[first : last + 1]
            yield batch.slice(first, last - first), raw[part[0] : part[-1]], part - part[0]
            first = last


def sums_between(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each range ``ends[i] : ends[i + 1]``; empty ranges give 0."""
    running = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return running[ends[1:]] - running[ends[:-1]]


def batch_of(schema: dict[str, pa.DataType], **columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, schema[n]) for n, c in columns.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))
