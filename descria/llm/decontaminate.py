"""Benchmark decontamination: BM25 with block-max WAND over an inverted index of the test items.

Texts are lower-cased and ASCII punctuation is blank. Every document is cut into passages of PASSAGE words, half of each
shared with the next, and each passage is a query. An item's BM25 impacts are divided by their sum, so a score is the
share of the item that the passage holds, and THRESHOLD means the same for all items. Passages whose terms' largest
impacts can't add up to the threshold are dropped for a whole batch at once, then blocks of units whose block maxima can't
for the passage; WAND over the postings of the blocks that are left returns every item above the threshold. A hit is confirmed if enough word n-grams of the item's question and of its answer (its
last sentence, else its last quarter) stand around the passage.

The index is made and broadcast in blocks of ITEMS_PER_BLOCK items, one pass over the documents a block. Documents aren't
shuffled. Defined results: null or empty texts match nothing; items without words are skipped; null ids are
carried; repeated rows are judged each; extra columns are ignored or passed through; empty tables give empty tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descria.llm.common import filter_arrow, map_arrow, narrow, position, text_chunks
from descria.llm.words import mix, plain_words, split_words

PASSAGE = 64
STRIDE = 32
THRESHOLD = 0.5
LEAST_OVERLAP = 0.6
GRAM = 3
K1, B = 1.2, 0.75
UNITS_PER_BLOCK = 8
#: Items of an index block; a block is broadcast and takes about 1 kB an item of 60 words.
ITEMS_PER_BLOCK = 20_000
HITS = "doc_id long, item_id long, passage_start long, score double, question_overlap double, answer_overlap double"
_SENTENCE_END = re.compile(r"[.?!][\s]+(?=\S)")


def answer_start(text: str) -> int:
    """Ordinal of the plain word that opens the answer."""
    words = len(split_words(*plain_words(pa.array([text]))).hashes)
    ends = [m.end() for m in _SENTENCE_END.finditer(text)]
    if ends:
        at = len(split_words(*plain_words(pa.array([text[: ends[-1]]]))).hashes)
        if 0 < at < words:
            return at
    return words - max(1, words // 4)


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, terms, answer) per item with words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = plain_words(batch.column(1))
            words = split_words(raw, offsets)
            terms = pa.ListArray.from_arrays(pa.array(words.first.astype(np.int32)), pa.array(words.hashes.view(np.int64)))
            answer = pa.array([answer_start(t or "") for t in batch.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), terms, answer], names=["item_id", "terms", "answer"])

    rows = narrow(benchmark, "item_id", "text")
    found = map_arrow(rows.select(rows.item_id.cast("long").alias("item_id"), "text"), work, "item_id long, terms array<long>, answer int")
    return found.where(F.size("terms") > 0)


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    if len(hashes) < size:
        size = max(len(hashes), 1)
    total = np.zeros(max(len(hashes) - size + 1, 0), np.uint64)
    for k in range(size):
        total = mix(total * np.uint64(31) + hashes[k : len(hashes) - size + 1 + k])
    return total


class Index:
    """Impacts of one block of items. Units are parts of items of at most PASSAGE words."""

    def __init__(self, items: list[tuple[int | None, list[int], int]], n_units: int, average: float, df: dict[int, int]):
        self.items = [(i, np.array(t, np.int64).view(np.uint64), a) for i, t, a in items]
        parts = [(k, first) for k, (_, hashes, _) in enumerate(self.items) for first in range(0, len(hashes), PASSAGE)]
        # Units of like length share a block: impacts are shares, so short units have the large ones.
        parts.sort(key=lambda x: (min(len(self.items[x[0]][1]) - x[1], PASSAGE), x))
        self.unit_item = [k for k, _ in parts]
        by_term: dict[int, list[tuple[int, float]]] = {}
        for unit, (k, first) in enumerate(parts):
            terms, tf = np.unique(self.items[k][1][first : first + PASSAGE], return_counts=True)
            n = np.array([df[int(t)] for t in terms.view(np.int64)])
            idf = np.log(1 + (n_units - n + 0.5) / (n + 0.5))
            impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * tf.sum() / average))
            for t, x in zip(terms.tolist(), (impact / impact.sum()).tolist(), strict=True):
                by_term.setdefault(t, []).append((unit, x))
        self.terms = np.array(sorted(by_term), np.uint64)
        #: Postings of term t: self.postings[t][block] = [(unit, impact), ...]; the largest impact of each, term by term.
        self.postings: list[dict[int, list[tuple[int, float]]]] = []
        blocks, tops, ends = [], [], [0]
        for t in self.terms.tolist():
            own: dict[int, list[tuple[int, float]]] = {}
            for unit, x in by_term[t]:
                own.setdefault(unit // UNITS_PER_BLOCK, []).append((unit, x))
            self.postings.append(own)
            blocks += own
            tops += [max(x for _, x in part) for part in own.values()]
            ends.append(len(blocks))
        self.block, self.top, self.ends = np.array(blocks, np.int64), np.array(tops, float), np.array(ends, np.int64)
        self.n_blocks = -(-len(parts) // UNITS_PER_BLOCK)
        self.most = np.array([max(x for _, x in by_term[t]) for t in self.terms.tolist()])
        self.grams = [(np.unique(_grams(h[:a], GRAM)), np.unique(_grams(h[a:], GRAM))) for _, h, a in self.items]

    def term_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ordinal of each term, -1 for terms of no item."""
        if not len(self.terms):
            return np.full(len(hashes), -1, np.int32)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1).astype(np.int32)

    def open_blocks(self, row: np.ndarray, term: np.ndarray, threshold: float) -> list[tuple[int, int]]:
        """(row, block) pairs in which the block maxima of the row's distinct terms reach the threshold."""
        count = self.ends[term + 1] - self.ends[term]
        at = np.repeat(self.ends[term] - np.cumsum(count) + count, count) + np.arange(count.sum())
        key = np.repeat(row, count) * self.n_blocks + self.block[at]
        total = np.bincount(key, self.top[at])
        found = np.flatnonzero(total >= threshold - 1e-9)
        return list(zip((found // self.n_blocks).tolist(), (found % self.n_blocks).tolist(), strict=True))

    def above(self, terms: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """(unit, score) of every unit of a block that the distinct terms give at least ``threshold``, by WAND."""
        lists = [own[block] for t in terms if block in (own := self.postings[t])]
        tops = [max(x for _, x in own) for own in lists]
        cursors = [[own[0][0], 0, k] for k, own in enumerate(lists)]
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += tops[c[2]]
                if bound >= threshold - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                break
            unit = cursors[pivot][0]
            if cursors[0][0] == unit:
                score = sum(lists[c[2]][c[1]][1] for c in cursors if c[0] == unit)
                if score >= threshold - 1e-9:
                    found.append((unit, score))
                unit += 1  # all lists that stand before it move on
            kept = []
            for c in cursors:
                own, at = lists[c[2]], c[1]
                while at < len(own) and own[at][0] < unit:
                    at += 1
                if at < len(own):
                    kept.append([own[at][0], at, c[2]])
            cursors = kept
        return found

    def hits(self, hashes: np.ndarray, first: np.ndarray, threshold: float, overlap: float) -> Iterator[tuple]:
        """(text, item_id, passage start, score, question overlap, answer overlap), one per text and item."""
        ids = self.term_ids(hashes)
        ub = np.where(ids >= 0, self.most[np.maximum(ids, 0)] if len(self.most) else 0.0, 0.0)
        running = np.concatenate([[0.0], np.cumsum(ub)])
        lengths = np.diff(first)
        count = np.where(lengths > 0, np.maximum(-(-(lengths - PASSAGE) // STRIDE), 0) + 1, 0)
        text = np.repeat(np.arange(len(lengths)), count)
        start = first[:-1][text] + STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
        end = np.minimum(start + PASSAGE, first[1:][text])
        maybe = np.flatnonzero(running[end] - running[start] >= threshold - 1e-9)
        # Terms that a passage repeats count once.
        at = start[maybe][:, None] + np.arange(PASSAGE)[None, :]
        grid = np.where(at < end[maybe][:, None], ids[np.minimum(at, max(len(ids) - 1, 0))] if len(ids) else -1, -1)
        grid.sort(axis=1)
        new = grid >= 0
        new[:, 1:] &= grid[:, 1:] != grid[:, :-1]
        bound = np.where(new, self.most[np.maximum(grid, 0)] if len(self.most) else 0.0, 0.0).sum(axis=1)
        best: dict[tuple[int, int], tuple] = {}
        rows = np.flatnonzero(bound >= threshold - 1e-9)
        step = max(1, 2_000_000 // max(self.n_blocks, 1))
        opened: list[tuple[int, int]] = []
        for part in (rows[i : i + step] for i in range(0, len(rows), step)):
            own, place = np.nonzero(new[part])
            opened += [(int(part[r]), b) for r, b in self.open_blocks(own, grid[part][own, place], threshold)]
        for row, block in opened:
            p = maybe[row]
            for unit, score in self.above(grid[row][new[row]].tolist(), block, threshold):
                k = self.unit_item[unit]
                key = (int(text[p]), k)
                if key in best and best[key][2] >= score:
                    continue
                item_id, item, _ = self.items[k]
                lo, hi = max(int(first[text[p]]), int(start[p]) - len(item)), min(int(first[text[p] + 1]), int(end[p]) + len(item))
                there = hashes[lo:hi]
                q, a = (
                    float(np.isin(g, _grams(there, min(GRAM, max(n, 1)))).mean()) if len(g) else 1.0
                    for g, n in zip(self.grams[k], (self.items[k][2], len(item) - self.items[k][2]), strict=True)
                )
                if q >= overlap and a >= overlap:
                    best[key] = (item_id, int(start[p] - first[text[p]]), float(score), q, a)
        for (t, _), values in sorted(best.items()):
            yield (t, *values)


def build_indexes(benchmark: DataFrame, items_per_block: int = ITEMS_PER_BLOCK) -> Iterator[Index]:
    """Index blocks; document frequencies and lengths are those of all items."""
    items = _items(benchmark)
    cuts = F.explode(F.sequence(F.lit(0), F.size("terms") - 1, F.lit(PASSAGE)))
    units = items.select("item_id", "terms", cuts.alias("cut")).select(F.slice("terms", F.col("cut") + 1, PASSAGE).alias("t"))
    n_units, average = units.agg(F.count(F.lit(1)), F.avg(F.size("t"))).first()
    df = units.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    blocks = -(-items.count() // items_per_block)
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == block)
        rows = [(r[0], list(r[1]), r[2]) for r in own.collect()]
        used = own.select(F.explode("terms").alias("term")).distinct()
        counts = {r[0]: r[1] for r in df.join(used, "term").collect()}
        yield Index(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])), n_units, average, counts)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = LEAST_OVERLAP) -> DataFrame:
    """One row per document and benchmark item that it holds."""
    spark = docs.sparkSession
    rows = narrow(docs, "doc_id", "text")
    rows = rows.select(rows.doc_id.cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], HITS)
    for index in build_indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, _, _ in text_chunks(batches, 1):
                words = split_words(*plain_words(batch.column(1)))
                ids = batch.column(0).to_pylist()
                found = [(ids[t], *rest) for t, *rest in shared.value.hits(words.hashes, words.first, threshold, overlap)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                names = ["doc_id", "item_id", "passage_start", "score", "question_overlap", "answer_overlap"]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=names)

        out = out.union(map_arrow(rows, work, HITS))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = LEAST_OVERLAP) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    text_at = position(docs, "text")
    for index in build_indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, _, _ in text_chunks(batches, text_at):
                words = split_words(*plain_words(batch.column(text_at)))
                clean = np.ones(batch.num_rows, bool)
                clean[[t for t, *_ in shared.value.hits(words.hashes, words.first, threshold, overlap)]] = False
                yield batch.filter(pa.array(clean))

        docs = filter_arrow(docs, work)
    return docs
