"""WARC archives with a two-level capture index.

Pages are put in the order of (reversed-host URL key, page_id) and written as gzipped records, one member each, with
digests; of equal payloads the largest page_id is written as response, the others as revisits that name it. Every task
also writes the index of its records: lines in key order, packed into compressed blocks of BLOCK_LINES, followed by a
sparse directory of the blocks' first keys. The upper level holds the first and last key of each index file. A lookup
bisects the upper level, then the directory, reads one block, bisects it, and reads one range of the archive.

Defined results: a null html is an empty payload; a null URL has the empty key; null page_ids sort below all others;
repeated rows are records each (rows with the largest page_id of their payload are responses); extra columns are
ignored; an empty table gives no file.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descria.llm.common import fresh_path, map_arrow, materialise, narrow
from descria.llm.files import file_system, new_file, read_range

BLOCK_LINES = 256
#: Pages dealt to a writing task.
PAGES_PER_TASK = 4000
#: Bytes of one archive before a task starts another.
ARCHIVE_BYTES = 256 << 20
LEAST_REVISIT_BYTES = 0
#: Up to this many revisits (about 60 bytes each) are broadcast to the pages, which then stay where they are.
BROADCAST_REVISITS = 500_000
TAIL = struct.Struct("<QQ")
NO_ID = -(2**63)


def url_key(url: Column) -> Column:
    """Reversed host, then what follows it: http://a.example.org/x?y becomes org,example,a)/x?y."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"\A[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"\A([^/?#]*)", 1))
    tail = F.regexp_extract(rest, r"\A[^/?#]*([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    target = url.encode().replace(b"\r", b"%0D").replace(b"\n", b"%0A").decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {target}')}>",
        f"WARC-Target-URI: {target}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-Id: {page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n", 6, mtime=0)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(WARC header fields, payload) of one compressed record."""
    plain = gzip.decompress(data)
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _with_verdicts(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, key, digest, refers_to); page_id null is NO_ID here."""
    rows = narrow(pages, "page_id", "url", "html").select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    rows = rows.withColumns({"key": url_key(F.col("url")), "sha": F.sha1(F.col("html").cast("binary"))})
    long_enough = F.octet_length("html") >= LEAST_REVISIT_BYTES
    groups = rows.where(long_enough).groupBy("sha").agg(F.max("page_id").alias("last_id"), F.count(F.lit(1)).alias("n"))
    # Only payloads that occur again matter; the rows' own side keeps its html out of this small join.
    again = rows.select("page_id", "sha", long_enough.alias("fits")).join(groups.where("n > 1"), "sha")
    again = again.where("fits and page_id < last_id").select("page_id", "sha", F.col("last_id").alias("refers_to")).distinct()
    again = materialise(again, "revisits")
    if again.count() <= BROADCAST_REVISITS:  # else both sides are shuffled
        again = F.broadcast(again)
    return rows.join(again, ["page_id", "sha"], "left").drop("sha")


def write_archive(pages: DataFrame, folder: str) -> DataFrame:
    """Writes archives and their index; the upper level is (path, first_key, last_key) per index file."""
    tasks = max(2, -(-pages.count() // PAGES_PER_TASK))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[tuple[str, int, str, int, int]] = []
        out, path, at = None, "", 0
        for batch in batches:
            for page_id, url, html, key, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    system, path = new_file(folder, ".warc.gz")
                    out, at = system.open_output_stream(path, compression=None), 0
                payload = html.encode()
                data = _record(page_id, url, payload, payload_digest(payload), refers_to)
                out.write(data)
                lines.append((key, page_id, path, at, len(data)))
                at += len(data)
        rows = []
        if out is not None:
            out.close()
            rows.append((write_index(folder, lines), key_text(lines[0]), key_text(lines[-1])))
        columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(3)]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "first_key", "last_key"])

    rows = _with_verdicts(pages).select("page_id", "url", "html", "key", "refers_to")
    ranged = rows.repartitionByRange(tasks, "key", "page_id").sortWithinPartitions("key", "page_id", "html")
    return materialise(map_arrow(ranged, work, "path string, first_key string, last_key string"), "captures")


def key_text(line: tuple) -> str:
    """Key of a capture as it stands in the upper level: URL key and page_id."""
    return json.dumps([line[0], line[1]], ensure_ascii=False)


def _ordered(key: str, page_id: int) -> tuple[bytes, int]:
    return key.encode(), page_id


def write_index(folder: str, lines: list[tuple[str, int, str, int, int]]) -> str:
    system, path = new_file(folder, ".cdx")
    directory, at = [], 0
    with system.open_output_stream(path, compression=None) as out:
        for first in range(0, len(lines), BLOCK_LINES):
            data = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in lines[first : first + BLOCK_LINES]).encode())
            directory.append((lines[first][0], lines[first][1], at, len(data)))
            out.write(data)
            at += len(data)
        tail = zlib.compress(json.dumps(directory, ensure_ascii=False).encode())
        out.write(tail)
        out.write(TAIL.pack(at, len(tail)))
    return path


class IndexFile:
    """One index file: its directory in memory, blocks read when a key falls into them."""

    def __init__(self, folder: str, path: str):
        self.system, _ = file_system(folder)
        self.handle = self.system.open_input_file(path)
        at, length = TAIL.unpack(read_range(self.handle, self.handle.size() - TAIL.size, TAIL.size))
        self.directory = json.loads(zlib.decompress(read_range(self.handle, at, length)))
        self.firsts = [_ordered(x[0], x[1]) for x in self.directory]
        self.block, self.lines, self.keys = -1, [], []
        self.archive_path, self.archive = "", None

    def _load(self, block: int) -> None:
        if block != self.block:
            _, _, at, length = self.directory[block]
            self.lines = [json.loads(x) for x in zlib.decompress(read_range(self.handle, at, length)).decode().split("\n")]
            self.keys = [_ordered(x[0], x[1]) for x in self.lines]
            self.block = block

    def captures(self, key: str, page_id: int) -> Iterator[bytes]:
        """Compressed records of all captures with this key and page."""
        wanted = _ordered(key, page_id)
        block = max(bisect.bisect_left(self.firsts, wanted) - 1, 0)
        while block < len(self.firsts) and self.firsts[block] <= wanted:
            self._load(block)
            for i in range(bisect.bisect_left(self.keys, wanted), bisect.bisect_right(self.keys, wanted)):
                _, _, path, at, length = self.lines[i]
                if path != self.archive_path:
                    self.archive_path, self.archive = path, self.system.open_input_file(path)
                yield read_range(self.archive, at, length)
            block += 1


def lookup(spark, folder: str, captures: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records of the wanted (url, page_id) pairs, each pair once: (page_id, url, record_type, refers_to, payload, ...)."""
    # The upper level has one row per writing task.
    upper = sorted(
        ((_ordered(*json.loads(r.first_key)), _ordered(*json.loads(r.last_key)), r.path) for r in captures.collect()),
        key=lambda x: (x[0], x[1], x[2]),
    )
    shared = spark.sparkContext.broadcast(upper)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, opened = shared.value, {}
        firsts = [x[0] for x in level]
        for batch in batches:
            rows = []
            for key, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = _ordered(key, page_id)
                k = bisect.bisect_right(firsts, own) - 1
                while k >= 0 and level[k][1] >= own:  # a key repeated across files is in neighbours
                    path = level[k][2]
                    if path not in opened:
                        opened.clear()
                        opened[path] = IndexFile(folder, path)
                    for data in opened[path].captures(key, page_id):
                        fields, payload = parse_record(data)
                        refers = fields.get("WARC-Refers-To-Page")
                        rows.append(
                            (
                                page_id, fields["WARC-Target-URI"], fields["WARC-Type"], None if refers is None else int(refers),
                                fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"]), payload,
                            )
                        )
                    k -= 1
            types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    asked = narrow(wanted, "url", "page_id").select(
        url_key(F.col("url")).alias("key"), F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id")
    )
    asked = asked.distinct().repartitionByRange(max(2, len(upper)), "key", "page_id").sortWithinPartitions("key", "page_id")
    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
    found = map_arrow(asked, work, schema)
    real = {c: F.when(F.col(c) != NO_ID, F.col(c)) for c in ("page_id", "refers_to")}
    return found.withColumns(real)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives all pages and reads every record back through the index."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    captures = write_archive(pages, folder)
    found = lookup(spark, folder, captures, pages)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
