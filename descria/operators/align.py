"""Row ordinals, positional joins and extraction by ordinal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from descria.columns import quoted, require_columns
from descria.errors import RowCountMismatchError
from descria.storage import materialise

ROW = "row_idx"
_PARTITION_BITS = 33
# Largest sides sent to every task: input splits (about 100 bytes each) and row ordinals (8 bytes each).
MAX_BROADCAST_CHUNKS = 500_000
MAX_BROADCAST_ORDINALS = 5_000_000


def _tagged(df: DataFrame, from_files: bool) -> tuple[DataFrame, list[str]]:
    mark = F.monotonically_increasing_id().alias("__mark")
    if from_files:
        where = [
            F.col("_metadata.file_path").alias("__file"),
            F.col("_metadata.file_block_start").alias("__start"),
        ]
        return df.select("*", *where, mark), ["__file", "__start"]
    tagged = df.select("*", mark)
    return tagged.withColumn("__part", F.shiftright("__mark", _PARTITION_BITS)), ["__part"]


def with_row_index(df: DataFrame, name: str = ROW, from_files: bool = True) -> DataFrame:
    """Add the zero-based position of every row in its source.

    Each input split is a chunk whose rows are consecutive; chunk sizes are counted
    first and written out (one row per split), their running total gives the
    offset, and the position inside a chunk is a subtraction. The rows themselves are
    neither sorted nor shuffled, and the order is that of (file path, offset in file)
    however Spark packs splits. Call it directly on a scan; ``from_files=False`` uses
    partition order.
    """
    tagged, keys = _tagged(df, from_files)
    chunks = tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__mark").alias("__first"))
    # One row per input split, so this window orders a table of that size only.
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    ranked = chunks.select(*keys, "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    offsets = small_side(materialise(ranked, "chunks"), MAX_BROADCAST_CHUNKS)
    position = (F.col("__offset") + F.col("__mark") - F.col("__first")).cast("bigint").alias(name)
    return tagged.join(offsets, keys).select(position, *[quoted(c) for c in df.columns])


def small_side(df: DataFrame, limit: int) -> DataFrame:
    """Mark a stored table for broadcast when its row count is within ``limit``.

    Beyond that Spark joins by shuffle. Without the hint it would plan the shuffle of
    the big side even for a handful of rows, because it cannot estimate an aggregate.
    """
    return F.broadcast(df) if df.count() <= limit else df


def zip_join(left: DataFrame, right: DataFrame, name: str = ROW) -> DataFrame:
    """Pair two indexed tables by position; different lengths are an error."""
    require_columns(left, [name])
    require_columns(right, [name])
    n_left, n_right = left.select(name).count(), right.select(name).count()
    if n_left != n_right:
        raise RowCountMismatchError(f"row counts differ: {n_left} and {n_right}")
    return left.join(right, name)


def attach_target(features: DataFrame, source: DataFrame, target: str, key: str = ROW) -> DataFrame:
    """``features`` with the target of the row of ``source`` that has the same key, as the last column.

    Steps that drop rows or columns may lie between both. A row without its source row is an error, as is a key that
    stands on several source rows.
    """
    require_columns(features, [key])
    require_columns(source, [key, target])
    own = source.select(quoted(key).alias("__key"), quoted(target).alias("__target"))
    counts = own.groupBy("__key").agg(F.first("__target").alias("__target"), F.count(F.lit(1)).alias("__n"))
    others = [c for c in features.columns if c != target]
    joined = features.select(*[quoted(c) for c in others]).join(counts, quoted(key).eqNullSafe(F.col("__key")), "left")
    once = F.when(F.col("__n") == 1, F.col("__target")).otherwise(
        F.raise_error(F.concat(F.lit("no or several target rows for key "), F.coalesce(quoted(key).cast("string"), F.lit("null"))))
    )
    return joined.select(*[quoted(c) for c in others], once.alias(target))


def key_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairing for inputs that carry an identifier instead of relying on position."""
    return left.join(right, key)


def asked_ordinals(wanted: DataFrame, name: str = ROW) -> DataFrame:
    """Distinct wanted ordinals, stored once, ready to be the small side of a join."""
    asked = wanted.select(F.col(wanted.columns[0]).cast("bigint").alias(name)).distinct()
    return small_side(materialise(asked, "wanted"), MAX_BROADCAST_ORDINALS)


def extract_by_index(
    records: DataFrame, wanted: DataFrame, valid: str | None = None, name: str = ROW, stored: bool = False
) -> DataFrame:
    """Records whose ordinal is wanted; unreadable records are skipped.

    A list within the size limit is broadcast, so the library is filtered while it
    is read; a longer one is joined by shuffle. Rows carry their ordinal; sort by it
    where the order of the file is needed. ``stored``: ``wanted`` comes from :func:`asked_ordinals`.
    """
    readable = records if valid is None else records.filter(quoted(valid))
    return readable.join(wanted if stored else asked_ordinals(wanted, name), name, "left_semi")


def indices_not_found(records: DataFrame, wanted: DataFrame, name: str = ROW, stored: bool = False) -> DataFrame:
    """Wanted ordinals that the library does not have."""
    asked = wanted if stored else asked_ordinals(wanted, name)
    hit = records.select(name).join(asked, name, "left_semi")
    return asked.join(hit, name, "left_anti")


def extraction_counts(
    records: DataFrame, wanted: DataFrame, valid: str, name: str = ROW, stored: bool = False
) -> DataFrame:
    """One row ``(requested, extracted, not_found)``."""
    asked = wanted if stored else asked_ordinals(wanted, name)
    hit = records.select(name, quoted(valid).alias("__ok")).join(asked, name, "left_semi")
    found = hit.agg(F.count_if("__ok").alias("extracted"), F.count(F.lit(1)).alias("found"))
    requested = asked.agg(F.count(F.lit(1)).alias("requested"))
    # Two one-row tables side by side.
    both = requested.withColumn("__k", F.lit(1)).join(found.withColumn("__k", F.lit(1)), "__k")
    return both.select("requested", "extracted", (F.col("requested") - F.col("found")).alias("not_found"))
