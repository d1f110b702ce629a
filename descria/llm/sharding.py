"""Sharding by sampled splitters.

Records are put in the order of (hash of the text, doc_id). Keys are drawn with a chance in proportion to size, their
quantiles become splitters that cut the order into ranges, and bytes and rows of every range are counted exactly.
Ranges above their share are cut again with splitters drawn inside them, until none is left that can be cut. A record's
place among all bytes is that of its range plus its place inside, and cuts the order into shards of equal bytes; equal
texts stay together but where a boundary falls into their group, and a group of any size is cut by doc_id.

Defined results: a null text has size 8 and the checksum of the empty text; null doc_ids sort first;
repeated rows are records of their own; extra columns are ignored; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from descria.llm.common import map_arrow, materialise, narrow

SHARDS = 24
ROW_BYTES = 8
#: Ranges are cut until each holds at most 1 / RANGES_PER_SHARD of a shard.
RANGES_PER_SHARD = 64
SAMPLES_PER_RANGE = 24
ROUNDS = 6


def _records(docs: DataFrame) -> DataFrame:
    rows = narrow(docs, "doc_id", "text")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        # Tells repeated ids apart only where they differ in text; equal rows are alike anyway.
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"),
    )


def _assign(records: DataFrame, splitters: np.ndarray) -> DataFrame:
    """Adds the ordinal of each record's range; ``splitters``: (h, d) pairs in order, each the last key of its range."""
    shared = records.sparkSession.sparkContext.broadcast(splitters)  # at most a few thousand pairs
    schema = ", ".join(f"{n} {t}" for n, t in records.dtypes if n != "part") + ", part int"
    names = [n for n in records.columns if n != "part"]
    h_at, d_at = records.columns.index("h"), records.columns.index("d")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = shared.value
        for batch in batches:
            h, d = batch.column(h_at).to_numpy(), batch.column(d_at).to_numpy()
            part = np.searchsorted(cut["h"], h, "left")
            upto = np.searchsorted(cut["h"], h, "right")
            for own in np.unique(h[part < upto]).tolist():  # only hashes that are splitters themselves
                here = h == own
                a, b = np.searchsorted(cut["h"], own, "left"), np.searchsorted(cut["h"], own, "right")
                part[here] = a + np.searchsorted(cut["d"][a:b], d[here], "left")
            columns = [batch.column(batch.schema.names.index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(part.astype(np.int32))], names=[*names, "part"])

    return map_arrow(records, work, schema)


def _draw(records: DataFrame, total: int, wanted: int, seed: int) -> list[tuple[int, int]]:
    """About ``wanted`` keys, each record with a chance in proportion to its size; the draw hangs on the key alone."""
    if total <= 0:
        return []
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(wanted / total))
    drawn = F.pmod(F.xxhash64("h", "d", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30)) < chance
    return sorted({(r[0], r[1]) for r in records.where(drawn).select("h", "d").collect()})


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per record."""
    records = materialise(_records(docs), "records")
    total, largest = records.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    ranges = shards * RANGES_PER_SHARD
    pair = np.dtype([("h", np.int64), ("d", np.int64)])
    drawn = _draw(records, total, ranges * SAMPLES_PER_RANGE, 1)
    cuts = set(drawn[SAMPLES_PER_RANGE // 2 :: SAMPLES_PER_RANGE])
    goal = max(total / ranges, largest)
    for round_ in range(2, ROUNDS + 2):
        placed = _assign(records, np.array(sorted(cuts), pair))
        sums = {r[0]: (r[1], r[2]) for r in placed.groupBy("part").agg(F.sum("size"), F.count(F.lit(1))).collect()}
        over = [p for p, (size, rows) in sums.items() if size > 2 * goal and rows > 1]
        if not over or round_ > ROUNDS:
            break
        inside = placed.where(F.col("part").isin(over))
        more = _draw(inside, sum(sums[p][0] for p in over), 4 * SAMPLES_PER_RANGE * len(over), round_)
        new = set(more[:: SAMPLES_PER_RANGE // 4]) - cuts
        if not new:
            break
        cuts |= new
    # Bytes and rows before each range; a record's shard is the one that holds the middle of its bytes.
    plan, bytes_before, rows_before = [], 0, 0
    for p in sorted(sums):
        plan.append((p, bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + sums[p][0], rows_before + sums[p][1]
    spark = docs.sparkSession
    plan_table = spark.createDataFrame(plan or [(0, 0, 0)], "part int, bytes_before long, rows_before long")
    order = Window.partitionBy("part").orderBy("h", "d", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("bytes_before") + F.sum("size").over(order) - F.col("size") / 2
    placed = placed.join(F.broadcast(plan_table), "part").select(  # one row per range
        "doc_id", "size", "text_crc32",
        F.least(F.floor(middle * shards / max(total, 1)), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("rows_before") + F.count(F.lit(1)).over(order) - 1).alias("row"),
    )
    placed = materialise(placed, "placed")
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row per shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
