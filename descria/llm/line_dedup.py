"""Incremental, reversible removal of lines that many documents share.

A :class:`LineStore` keeps, for each distinct line key, in how many documents it occurs: an exact table of reference counts,
as signed changes in Parquet, one folder for each version. Keys are dealt to shards by their own bits. A shard has
a file with the keys whose count has reached ``least_docs`` and a cuckoo filter over them. Inserting documents adds to the
counts, deleting them subtracts; keys that pass the limit upwards are inserted into their shard's filter, keys that
fall below it are deleted from it, and only shards with such keys are written anew. So the store after inserting and deleting a
batch cleans as if the batch had never been there.

To clean documents, their distinct keys travel to the shards (a hot shard is dealt to SPLITS tasks, which all read the
same small file); the filter answers for most of them, what it lets pass is looked up in the exact keys, and only keys
that are shared come back to the documents.

Keys are 128-bit hashes of the stripped, lower-cased line. A version is in force once the list of versions names it, so
a failed or repeated task leaves files behind that nothing reads.

Defined results: a null or empty text is one empty line; empty keys are never dropped; each row counts as a document,
repeated rows too; null doc_ids are handled like others; extra columns are ignored; empty tables give empty tables.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from descria.errors import DescriaError
from descria.llm.common import fresh_path, map_arrow, materialise, narrow
from descria.llm.cuckoo import CuckooFilter, key_words
from descria.llm.files import file_system, new_file, read_range

LEAST_DOCS = 10
LEAST_POINTS = 1
#: Documents for each shard of a new store; a shard's file is read whole.
DOCS_PER_SHARD = 20_000
#: Tasks that share the questions to one shard.
SPLITS = 16
#: Shard files that a task keeps open at a time.
OPEN_SHARDS = 4
STRIPPED = b"\t\n\x0b\x0c\r "
HEADER = struct.Struct("<QQ")
COUNTS = "shard int, key binary, n long"


def line_key(line: bytes, least_points: int = LEAST_POINTS) -> bytes | None:
    """Key of a lower-cased line; None if it is too short to be dropped."""
    own = line.strip(STRIPPED)
    if len(own) < least_points or (least_points > 1 and len(own.decode()) < least_points):
        return None
    return blake2b(own, digest_size=16).digest()


def shard_of(key: bytes, shards: int) -> int:
    return int.from_bytes(key[:4], "big") % shards


class ShardFile:
    """Keys of one shard whose counts have reached the limit, sorted, behind their filter."""

    def __init__(self, filter_: CuckooFilter, keys: np.ndarray):
        self.filter, self.keys = filter_, keys

    @classmethod
    def empty(cls) -> ShardFile:
        return cls(CuckooFilter.sized(0), np.zeros(0, "V16"))

    @classmethod
    def read(cls, folder: str, path: str) -> ShardFile:
        system, _ = file_system(folder)
        with system.open_input_file(path) as source:
            slots, keys = HEADER.unpack(read_range(source, 0, HEADER.size))
            data = read_range(source, HEADER.size, slots + 16 * keys)
        return cls(CuckooFilter.from_bytes(data[:slots]), np.frombuffer(data[slots:], "V16"))

    def write(self, folder: str) -> str:
        system, path = new_file(folder, ".shard")
        slots = self.filter.to_bytes()
        with system.open_output_stream(path, compression=None) as out:
            out.write(HEADER.pack(len(slots), len(self.keys)))
            out.write(slots)
            out.write(self.keys.tobytes())
        return path

    def changed(self, risen: list[bytes], fallen: list[bytes]) -> ShardFile:
        """The shard after some keys reached the limit and some fell below it."""
        gone = set(fallen)
        kept = sorted([k for k in map(bytes, self.keys.tolist()) if k not in gone] + risen)
        slots = CuckooFilter(self.filter.slots.copy())
        if fallen:
            slots.delete(key_words(fallen))
        if risen and not slots.insert(key_words(risen)):
            slots = CuckooFilter.of(key_words(kept))
        return ShardFile(slots, np.frombuffer(b"".join(kept), "V16"))

    def shared(self, keys: list[bytes]) -> list[bool]:
        """Whether each key has reached the limit: the filter first, then the exact keys."""
        maybe = self.filter.contains(key_words(keys))
        out = [False] * len(keys)
        if maybe.any():
            exact = self.exact
            for i in np.flatnonzero(maybe).tolist():
                out[i] = keys[i] in exact
        return out

    @property
    def exact(self) -> frozenset[bytes]:
        if not hasattr(self, "_exact"):
            self._exact = frozenset(map(bytes, self.keys.tolist()))
        return self._exact


def _lines_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split(b"\n")


def _with_ref(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text: rows that are equal in id and hash are copies of one row."""
    rows = narrow(docs, "doc_id", "text")
    return rows.select(rows.doc_id.cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def line_references(rows: DataFrame, shards: int, least_points: int) -> DataFrame:
    """(doc_id, text_hash, shard, key): the distinct keys of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, keys = [], []
            for i, text in enumerate(batch.column(2).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()):
                found = {line_key(x, least_points) for x in _lines_of(text.lower() if text else text)}
                found.discard(None)
                own += [i] * len(found)
                keys += found
            for first in range(0, len(keys), 50_000):
                part = keys[first : first + 50_000]
                at = pa.array(own[first : first + 50_000], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array([shard_of(k, shards) for k in part], pa.int32()), pa.array(part, pa.binary())],
                    names=["doc_id", "text_hash", "shard", "key"],
                )

    return map_arrow(rows, work, "doc_id long, text_hash long, shard int, key binary")


class LineStore:
    """Reference counts of line keys and the filters over those that many documents share."""

    def __init__(self, spark: SparkSession, folder: str, state: dict):
        self.spark, self.folder, self.state = spark, folder, state

    @classmethod
    def create(cls, spark: SparkSession, folder: str, shards: int, least_docs: int = LEAST_DOCS, least_points: int = LEAST_POINTS) -> LineStore:
        """A new store without documents; shards and limits stay as they are."""
        store = cls(spark, folder, {"shards": shards, "least_docs": least_docs, "least_points": least_points, "versions": []})
        store._save()
        return store

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LineStore:
        system, path = file_system(folder)
        listed = system.get_file_info(FileSelector(path))
        last = max(x.path for x in listed if x.base_name.startswith("store-") and x.base_name.endswith(".json"))
        with system.open_input_file(last) as source:
            return cls(spark, folder, json.loads(source.read()))

    def _save(self) -> None:
        """Writes the state under the next number; the largest number is in force."""
        system, path = file_system(self.folder)
        system.create_dir(path, recursive=True)
        self.state["saved"] = self.state.get("saved", 0) + 1
        with system.open_output_stream(f"{path.rstrip('/')}/store-{self.state['saved']:09d}.json", compression=None) as out:
            out.write(json.dumps(self.state).encode())

    def counts(self) -> DataFrame:
        """(shard, key, n): the exact reference counts, without keys that no document has any more."""
        paths = [v["counts"] for v in self.state["versions"]]
        if not paths:
            return self.spark.createDataFrame([], COUNTS)
        changes = self.spark.read.schema(COUNTS).parquet(*paths)
        return changes if len(paths) == 1 else changes.groupBy("shard", "key").agg(F.sum("n").alias("n")).where("n <> 0")

    def _files(self) -> dict[int, str]:
        """The latest file of each shard that has one; as many entries as shards at most."""
        return {int(k): path for v in self.state["versions"] for k, path in v["files"].items()}

    def insert(self, docs: DataFrame) -> None:
        """Counts the lines of more documents."""
        self._change(line_references(_with_ref(docs), self.state["shards"], self.state["least_points"]), 1)

    def delete(self, docs: DataFrame) -> None:
        """Takes documents out again that were inserted before; others are refused and change nothing."""
        self._change(line_references(_with_ref(docs), self.state["shards"], self.state["least_points"]), -1)

    def _change(self, references: DataFrame, sign: int) -> None:
        delta = references.groupBy("shard", "key").agg((F.count(F.lit(1)) * sign).alias("n"))
        least, folder, files = self.state["least_docs"], self.folder, self._files()
        path = fresh_path(self.spark, "line-counts")
        delta.write.parquet(path)
        after = self.spark.read.schema(COUNTS).parquet(path).withColumn("was", F.lit(0).cast("long"))
        if self.state["versions"]:
            both = self.counts().withColumnsRenamed({"n": "was"}).join(after.drop("was"), ["shard", "key"], "right")
            after = both.select("shard", "key", "n", F.coalesce("was", F.lit(0)).alias("was"))
            after = materialise(after, "line-changes")
            if sign < 0 and not after.where("was + n < 0").isEmpty():
                raise DescriaError("a document to delete was never inserted")
        elif sign < 0 and not after.isEmpty():
            raise DescriaError("a document to delete was never inserted")
        passed = after.where((F.col("was") >= least) != (F.col("was") + F.col("n") >= least))
        passed = passed.select("shard", "key", (F.col("was") < least).alias("rises"))

        def write(shard: int, keys: list[bytes], rises: list[bool]) -> pa.RecordBatch:
            old = ShardFile.read(folder, files[shard]) if shard in files else ShardFile.empty()
            up = [k for k, r in zip(keys, rises, strict=True) if r]
            new = old.changed(up, [k for k, r in zip(keys, rises, strict=True) if not r])
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([new.write(folder)])], names=["shard", "path"])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, keys, rises = None, [], []
            for batch in batches:
                for s, k, r in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if s != shard and keys:
                        yield write(shard, keys, rises)
                        keys, rises = [], []
                    shard = s
                    keys.append(k), rises.append(r)
            if keys:
                yield write(shard, keys, rises)

        dealt = passed.repartition("shard").sortWithinPartitions("shard", "key")
        written = materialise(map_arrow(dealt, work, "shard int, path string"), "line-shards")
        fresh = {r.shard: r.path for r in written.collect()}  # one row for each shard at most
        self.state["versions"].append({"counts": path, "files": fresh})
        self._save()

    def compact(self) -> None:
        """Sums all versions into one, so that later changes read one set of counts."""
        path = fresh_path(self.spark, "line-counts")
        self.counts().write.parquet(path)
        self.state["versions"] = [{"counts": path, "files": self._files()}]
        self._save()

    def shared_keys(self, references: DataFrame) -> DataFrame:
        """Those (doc_id, text_hash, key) references whose key has reached the limit."""
        folder, files = self.folder, self._files()

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            opened: dict[int, ShardFile] = {}
            for batch in batches:
                shards = batch.column(2).to_numpy()
                keep = np.zeros(batch.num_rows, bool)
                for shard in np.unique(shards).tolist():
                    if shard not in files:
                        continue
                    if shard not in opened:
                        if len(opened) >= OPEN_SHARDS:
                            opened.pop(next(iter(opened)))
                        opened[shard] = ShardFile.read(folder, files[shard])
                    at = np.flatnonzero(shards == shard)
                    keep[at] = opened[shard].shared(batch.column(3).take(pa.array(at)).to_pylist())
                yield batch.select([0, 1, 3]).filter(pa.array(keep))

        split = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SPLITS))
        dealt = references.withColumn("split", split).repartition("shard", "split").sortWithinPartitions("shard")
        return map_arrow(dealt.drop("split"), work, "doc_id long, text_hash long, key binary")

    def clean(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_lines, n_dropped, text): documents without the lines that many documents share."""
        least_points = self.state["least_points"]
        rows = _with_ref(docs)
        found = self.shared_keys(line_references(rows, self.state["shards"], least_points))
        # Copies of a row ask the same, so keys may come back several times; a document has as many keys as lines at most.
        dropped = found.groupBy("doc_id", "text_hash").agg(F.collect_set("key").alias("keys"))
        other = dropped.select(F.col("doc_id").alias("other_id"), F.col("text_hash").alias("other_hash"), "keys").hint("shuffle_hash")
        match: Column = F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("text_hash") == F.col("other_hash"))
        joined = rows.join(other, match, "left").select("doc_id", "text", "keys")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_lines, n_dropped, texts = [], [], []
                data = batch.column(1).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
                for text, keys in zip(data, batch.column(2).to_pylist(), strict=True):
                    lines = _lines_of(text)
                    kept = lines
                    if keys:
                        gone = set(keys)
                        kept = [x for x in lines if line_key(x.lower(), least_points) not in gone]
                    n_lines.append(len(lines)), n_dropped.append(len(lines) - len(kept))
                    texts.append(b"\n".join(kept) if keys else text or b"")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_lines", "n_dropped", "text"],
                )

        return map_arrow(joined, work, "doc_id long, n_lines long, n_dropped long, text string")


def drop_shared_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_points: int = LEAST_POINTS) -> DataFrame:
    """One row per document without the lines that ``least_docs`` of these documents share."""
    spark = docs.sparkSession
    shards = max(8, -(-docs.count() // DOCS_PER_SHARD))
    store = LineStore.create(spark, fresh_path(spark, "line-store"), shards, least_docs, least_points)
    store.insert(docs)
    return store.clean(docs)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) per document."""
    return drop_shared_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
