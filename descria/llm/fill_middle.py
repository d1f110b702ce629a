"""Fill-in-the-middle transformation of whole texts.

Texts are handled in chunks. A Fenwick tree over fixed blocks of a chunk's bytes stores how many units (lines) end in a
block and how many code points start in it. The end of the k-th unit is found by binary-lifting descent to its block and
a look into that block alone; all cuts of a chunk descend together. A cut's code points come from the same descent.

Two hashes of the id choose the cuts, two more the form. A text that is empty, contains a marker, or is not chosen, stays
plain. Everything depends on the row alone, so a second run, other partitions or a lost executor change nothing.

Defined results: a null text is empty, hence plain; a null doc_id counts as an empty number in the hash; repeated rows
give equal rows; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descria.llm.common import map_arrow, narrow, text_chunks

#: Bytes of a block; a cut looks at one block.
BLOCK = 256
MARKERS = ("<P>", "<S>", "<M>")
LINE_END = 10
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class BlockTree:
    """Fenwick trees over blocks of bytes: unit ends and starts of code points."""

    def __init__(self, raw: np.ndarray, block: int = BLOCK):
        self.raw, self.block = raw, block
        blocks = max(1, -(-len(raw) // block))
        self.size = 1 << (blocks - 1).bit_length()
        padded = np.full(self.size * block, 128, np.uint8)  # neither a line end nor a start of a code point
        padded[: len(raw)] = raw
        self.grid = padded.reshape(self.size, block)
        self.units = self._tree((self.grid == LINE_END).sum(1))
        self.points = self._tree(((self.grid & 0xC0) != 0x80).sum(1))

    def _tree(self, counts: np.ndarray) -> np.ndarray:
        """Node i (from 1) holds the sum of the lowest-bit-of-i blocks that end with block i."""
        tree = np.zeros(self.size + 1, np.int64)
        tree[1:] = counts
        step = 1
        while step < self.size:
            tree[2 * step :: 2 * step] += tree[step : -step : 2 * step]
            step *= 2
        return tree

    def descend(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block that holds the ``wanted``-th unit end, its rank inside the block, code points before the block)."""
        at, rest, points = np.zeros(len(wanted), np.int64), wanted.astype(np.int64), np.zeros(len(wanted), np.int64)
        step = self.size // 2
        while step:
            node = at + step
            right = self.units[node] < rest
            rest = rest - np.where(right, self.units[node], 0)
            points = points + np.where(right, self.points[node], 0)
            at = np.where(right, node, at)
            step //= 2
        return at, rest, points

    def before(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit ends, code points) before byte ``places``."""
        node = places // self.block
        inside = np.arange(self.block)[None, :] < (places % self.block)[:, None]
        last = self.grid[np.minimum(node, self.size - 1)]
        inside &= (node < self.size)[:, None]
        units = ((last == LINE_END) & inside).sum(1)
        points = (((last & 0xC0) != 0x80) & inside).sum(1)
        while (node > 0).any():
            units, points = units + self.units[node], points + self.points[node]  # node 0 is empty
            node = node & (node - 1)
        return units, points

    def unit_ends(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte after the ``wanted``-th unit end of the chunk, code points before it); ``wanted`` counts from 1."""
        block, rank, points = self.descend(wanted)
        rows = self.grid[block]
        inside = np.argmax(np.cumsum(rows == LINE_END, axis=1) == rank[:, None], axis=1) + 1
        here = np.arange(self.block)[None, :] < inside[:, None]
        return block * self.block + inside, points + (((rows & 0xC0) != 0x80) & here).sum(1)


def id_hashes(doc_ids: list[int | None], seed: int) -> np.ndarray:
    """Four 32-bit numbers for each id: the first digits of the sha256 of ``seed:id``."""
    digests = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in doc_ids]
    return np.frombuffer(b"".join(digests), ">u4").reshape(-1, 4).astype(np.int64)


def _pieces(raw: np.ndarray, offsets: np.ndarray, hashes: np.ndarray):
    """(units, byte of both cuts, code points of prefix and middle) of each text of a chunk."""
    tree = BlockTree(raw)
    ends_before, points_before = tree.before(offsets)
    line_ends = np.diff(ends_before)
    lengths = np.diff(offsets)
    open_end = lengths > 0
    open_end[open_end] = raw[offsets[1:][open_end] - 1] != LINE_END
    units = line_ends + open_end
    chosen = np.sort(hashes[:, :2] % (units[:, None] + 1), axis=1)
    bytes_, points = np.empty(chosen.shape, np.int64), np.empty(chosen.shape, np.int64)
    for side in (0, 1):
        k = chosen[:, side]
        at, before = offsets[:-1].copy(), points_before[:-1].copy()
        at[k == units], before[k == units] = offsets[1:][k == units], points_before[1:][k == units]
        inner = np.flatnonzero((k > 0) & (k < units))
        if len(inner):
            at[inner], before[inner] = tree.unit_ends(ends_before[inner] + k[inner])
        bytes_[:, side], points[:, side] = at, before
    return units, bytes_, points[:, 0] - points_before[:-1], points[:, 1] - points[:, 0]


def fill_in_middle(
    docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, markers: Sequence[str] = MARKERS
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each text, rearranged or plain.

    ``fim_percent`` of the texts are rearranged, ``spm_percent`` of these with the suffix first.
    """
    p, s, m = (x.encode() for x in markers)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in text_chunks(batches, 1):
            doc_ids = batch.column(0).to_pylist()
            hashes = id_hashes(doc_ids, seed)
            units, cuts, prefix_chars, middle_chars = _pieces(raw, offsets, hashes)
            texts = batch.column(1).fill_null("")
            marked = np.zeros(len(doc_ids), bool)
            for x in markers:
                marked |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
            plain = (units == 0) | marked | (hashes[:, 2] % 100 >= fim_percent)
            spm = hashes[:, 3] % 100 < spm_percent
            data, out, form = raw.tobytes(), [], []
            rows = zip(offsets[:-1].tolist(), cuts[:, 0].tolist(), cuts[:, 1].tolist(), offsets[1:].tolist(), plain.tolist(), spm.tolist(), strict=True)
            for a, b, c, d, is_plain, is_spm in rows:
                if is_plain:
                    out.append(data[a:d]), form.append("plain")
                elif is_spm:
                    out.append(b"".join((s, data[c:d], p, data[a:b], m, data[b:c]))), form.append("spm")
                else:
                    out.append(b"".join((p, data[a:b], s, data[c:d], m, data[b:c]))), form.append("psm")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(units, pa.int64()),
                    pa.array(form, pa.string()),
                    pa.array(prefix_chars, pa.int64(), mask=plain),
                    pa.array(middle_chars, pa.int64(), mask=plain),
                    pa.array(out, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    rows = narrow(docs, "doc_id", "text")
    return map_arrow(rows.select(rows.doc_id.cast("long").alias("doc_id"), "text"), work, SCHEMA)


def restored(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text an output was made from, from output and form alone. Markers hold no pattern signs but those quoted here."""
    pattern = "|".join(rf"\Q{x}\E" for x in markers)
    parts = F.split(output, pattern, -1)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )


def digests(docs: DataFrame) -> DataFrame:
    """One row per document with digests of its output and of the text rebuilt from it."""
    made = fill_in_middle(docs)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
