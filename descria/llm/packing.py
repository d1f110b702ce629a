"""Best-fit packing of token sequences.

Bounded-space online best fit: pieces arrive one by one; a piece goes to the open bin with the least free space that
still holds it, found in a bitset keyed by free space; if none does, a bin is opened, and if that makes too many, the
fullest closes. A task packs the pieces dealt to it by a hash of doc_id, in a fixed order, so a lost task gives
the same bins again. Only lengths and digests are dealt out, not ids. Each task wastes at most what its open bins
have left, so tasks are as few as ``DOCS_PER_TASK`` allows.

Defined results: a null or empty text is a piece of one end id; null doc_ids are packed like others; repeated rows are
packed each; extra columns are ignored; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from descria.llm.common import map_arrow, narrow, text_chunks
from descria.llm.tokens import encoder

CAPACITY = 4096
OPEN_BINS = 256
#: Pieces that are looked at together; the longest of them arrives first.
ARRIVALS = 1000
#: Documents dealt to a packing task; its rows are about 60 bytes.
DOCS_PER_TASK = 100_000
END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids binary"


class OpenBins:
    """At most ``most`` open bins, keyed by free space."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = 0
        self.made = 0

    def _put(self, number: int, free: int) -> None:
        if free:
            self.by_free[free].append(number)
            self.bits |= 1 << free
            self.open += 1

    def _take(self, free: int) -> int:
        own = self.by_free[free]
        number = own.pop()
        if not own:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of ``length``."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.made
            self.made += 1
        self._put(number, free - length)
        if self.open > self.most:
            self._take((self.bits & -self.bits).bit_length() - 1)
        return number, self.capacity - free


def tokenise(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``capacity`` ids: (doc_id, piece, start, length, ids as little-endian 32-bit integers)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for batch, _, _ in text_chunks(batches, 1, 2 << 20):
            doc, piece, start, length, ids = [], [], [], [], []
            found = own.encode(batch.column(1))
            for doc_id, data in zip(batch.column(0).to_pylist(), found, strict=True):
                data += end
                for k, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    doc.append(doc_id), piece.append(k), start.append(at // 4), length.append(len(part) // 4), ids.append(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids"],
            )
        own.forget()  # the worker lives on, for tasks of other stages too

    rows = narrow(docs, "doc_id", "text")
    return map_arrow(rows.select(rows.doc_id.cast("long").alias("doc_id"), "text"), work, PIECES)


def pack(
    pieces: DataFrame, docs: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, docs_per_task: int = DOCS_PER_TASK
) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...); other columns go along.

    ``docs``: how many documents there are, which sets the number of packing tasks.
    """
    tasks = max(2, -(-docs // docs_per_task))
    length_at = pieces.columns.index("length")
    fields = [*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            lengths = batch.column(length_at).to_numpy(zero_copy_only=False)
            placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
            for first in range(0, len(lengths), ARRIVALS):
                some = lengths[first : first + ARRIVALS]
                for k in np.argsort(-some, kind="stable").tolist():
                    placed[first + k] = bins.place(int(some[k]))
            numbers = pa.array([base + b for b, _ in placed], pa.int64())
            offsets = pa.array([o for _, o in placed], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, numbers, offsets], names=[*batch.schema.names, "sequence_id", "offset"])

    # A null doc_id hashes like any other value; whole rows break ties, so that a second run sees the same order.
    dealt = pieces.repartition(tasks, "doc_id", "piece").sortWithinPartitions(F.xxhash64("doc_id", "piece"), *pieces.columns)
    return map_arrow(dealt, work, T.StructType(fields))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: (sequence_id, length, ids, doc_ids) from packed pieces with their ids."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return (
        packed.groupBy("sequence_id")
        .agg(inside.alias("parts"))  # at most ``capacity`` ids
        .select(
            "sequence_id",
            F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p.length).alias("length"),
            F.expr("aggregate(parts, cast('' as binary), (all, p) -> concat(all, p.ids))").alias("ids"),
            F.transform("parts", lambda p: p.doc_id).alias("doc_ids"),
        )
    )


def pack_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per piece with its place and the digest of its ids."""
    pieces = tokenise(docs, vocabulary).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(pieces, docs.count())
