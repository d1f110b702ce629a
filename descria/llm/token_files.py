"""Token ids in binary files: Simple-8b words, block offsets and a table of documents.

Documents are put in ranges of doc_id, encoded where they lie and written in order, a few files a task at most
``FILE_IDS`` ids long. A file is: magic, the words, the offset of each block in words, the documents' ids,
their starts in the file, and a footer of fixed length with the counts. Files of the manifest are in order of doc_id.

Defined results: a null or empty text is the end id alone; null doc_ids come first; repeated rows follow each other;
extra columns are ignored; an empty table gives no file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descria.llm import simple8b
from descria.llm.common import fresh_path, map_arrow, materialise, narrow, small_batches, text_chunks
from descria.llm.files import file_system, new_file, read_range
from descria.llm.tokens import encoder

MAGIC = b"S8IDS001"
FOOTER = struct.Struct("<QQQQ8s")
END_ID = 2
#: Ids after which a task starts another file, and documents dealt to a writing task.
FILE_IDS = 250_000
DOCS_PER_TASK = 20_000
#: Files that a reading task takes, about.
FILES_PER_TASK = 8
NO_ID = -(2**63)


def write_file(folder: str, doc_ids: list[int | None], ids: list[bytes]) -> tuple[str, int]:
    """Path of the file and its number of ids; ``ids``: little-endian 32-bit integers of each document."""
    starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype("<u8")
    words, offsets = simple8b.encode(np.frombuffer(b"".join(ids), "<u4").astype(np.uint64))
    system, path = new_file(folder, ".ids")
    keys = np.array([NO_ID if d is None else d for d in doc_ids], "<i8")
    with system.open_output_stream(path, compression=None) as out:
        out.write(MAGIC)
        for part in (words.astype("<u8"), offsets.astype("<u8"), keys, starts):
            out.write(part.tobytes())
        out.write(FOOTER.pack(len(words), len(offsets), len(keys), int(starts[-1]), MAGIC))
    return path, int(starts[-1])


class TokenFile:
    """Reader of one file; ids of documents are decoded from the blocks they touch."""

    def __init__(self, folder: str, path: str):
        system, _ = file_system(folder)
        self.handle = system.open_input_file(path)
        size = self.handle.size()
        n_words, n_offsets, n_docs, self.n_ids, magic = FOOTER.unpack(read_range(self.handle, size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a file of ids")
        at = len(MAGIC) + 8 * n_words
        table = np.frombuffer(read_range(self.handle, at, 8 * (n_offsets + 2 * n_docs + 1)), "<u8")
        self.offsets = table[:n_offsets].astype(np.int64)
        keys = table[n_offsets : n_offsets + n_docs].view("<i8").tolist()
        self.doc_ids = [None if k == NO_ID else k for k in keys]
        self.starts = table[n_offsets + n_docs :].astype(np.int64)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids ``first : last`` of the file."""
        if first >= last:
            return np.zeros(0, np.uint64)
        a, b = first // simple8b.BLOCK, -(-last // simple8b.BLOCK)
        lo, hi = int(self.offsets[a]), int(self.offsets[b])
        words = np.frombuffer(read_range(self.handle, len(MAGIC) + 8 * lo, 8 * (hi - lo)), "<u8")
        values = simple8b.decode(words, self.offsets[a : b + 1] - lo)
        return values[first - a * simple8b.BLOCK : last - a * simple8b.BLOCK]


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Writes all documents in ascending doc_id; the manifest is (task, file, path, n_ids)."""
    tasks = max(2, -(-docs.count() // DOCS_PER_TASK))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        task, rows, doc_ids, ids, held = TaskContext.get().partitionId(), [], [], [], 0
        for batch, _, _ in text_chunks(batches, 1, 2 << 20):
            doc_ids += batch.column(0).to_pylist()
            ids += [x + end for x in own.encode(batch.column(1))]
            held = sum(map(len, ids)) // 4
            if held >= FILE_IDS:
                rows.append((task, len(rows), *write_file(folder, doc_ids, ids)))
                doc_ids, ids = [], []
        if doc_ids:
            rows.append((task, len(rows), *write_file(folder, doc_ids, ids)))
        own.forget()  # the worker lives on while the next stage's tasks need the memory
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["task", "file", "path", "n_ids"])

    rows = narrow(docs, "doc_id", "text")
    rows = rows.select(rows.doc_id.cast("long").alias("doc_id"), "text")
    ranged = rows.repartitionByRange(tasks, "doc_id").sortWithinPartitions("doc_id", "text")
    with small_batches(docs.sparkSession):
        return materialise(map_arrow(ranged, work, "task int, file int, path string, n_ids long"), "manifest")


def read_token_files(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids as little-endian 32-bit integers) of all documents of the files."""
    files = sorted(manifest.collect(), key=lambda r: (r.task, r.file))  # one row per file of FILE_IDS ids
    before, at = [], 0
    for r in files:
        before.append((r.path, at))
        at += r.n_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                source = TokenFile(folder, path)
                ids = source.ids(0, source.n_ids).astype("<u4").tobytes()
                starts = source.starts.tolist()
                for first in range(0, len(source.doc_ids), 500):
                    part = range(first, min(first + 500, len(source.doc_ids)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([source.doc_ids[i] for i in part], pa.int64()),
                            pa.array([base + starts[i] for i in part], pa.int64()),
                            pa.array([starts[i + 1] - starts[i] for i in part], pa.int64()),
                            pa.array([ids[4 * starts[i] : 4 * starts[i + 1]] for i in part], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    listed = spark.createDataFrame(before or [("", 0)], "path string, base long").where("path <> ''")
    listed = listed.repartition(max(1, -(-len(before) // FILES_PER_TASK)), "path")
    return map_arrow(listed, work, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes the files and gives (doc_id, start, n_tokens, ids_crc32) as read back from them."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "token-files")
    manifest = write_token_files(docs, vocabulary, folder)
    return read_token_files(spark, folder, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def digest(ids: bytes) -> int:
    return zlib.crc32(ids)
