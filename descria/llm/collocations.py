"""Phrases whose words stand together more often than their parts suggest.

Words are counted first, then level by level the phrases that are one word longer: a phrase of k + 1 words is a pair of
two frequent phrases of k words that stand one word apart, so each level only pairs symbols of the level before, and
a phrase that is frequent has frequent parts. Symbols are ranked by frequency; the DENSE_IDS most frequent ones of a
level get direct addresses. A task splits their pairs into tiles of TILE x TILE addresses: tiles with many pairs are counted
with numpy's bincount in a dense array, the pairs of all other tiles are sorted and counted as runs. Symbols
beyond DENSE_IDS keep their 64-bit hash as address and are counted as sorted runs as well; a bitmap of fixed size, set
for every frequent one, leaves out most of those that are rare. Counts are summed in Spark by pair. So what a level
broadcasts has a fixed bound, whatever the size of the vocabulary, and no count is cut off.

Languages are kept apart by their hash in every word's code. All numbers are exact; products are decimals.

Defined results: a null text is empty; a null language is ``und``, as is the language of that name; each row counts,
repeated rows too; doc_id and extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from descria.llm.common import bit_map, map_arrow, materialise, narrow, text_chunks
from descria.llm.words import hash_words, lower_ascii, mix, prefix_hash, span_hash

#: Symbols of a level with a direct address (2**20 at most), and the edge of a tile of addresses.
DENSE_IDS = 1 << 18
TILE_BITS = 10
TILE = 1 << TILE_BITS
#: Pairs counted together, share of a tile's cells from which it is dense, and dense tiles that a task keeps open.
BUFFER = 1 << 21
DENSE_SHARE = 16
OPEN_TILES = 4
#: Bits of the map of frequent symbols without a direct address.
MAP_BITS = 24
#: Parts of a language that are ordered apart.
SPLITS = 16
#: Steps of the histogram of counts that finds the DENSE_IDS most frequent symbols, for each doubling.
BINS = 64

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_APART = _BREAK.copy()
_APART[[9, 32]] = True


@dataclass
class Symbols:
    """Codes of the phrases that start at each word; ``valid`` where one does, ``ids`` of -1 without direct address."""

    codes: np.ndarray
    ids: np.ndarray
    valid: np.ndarray


@dataclass
class Ranking:
    """Frequent symbols of a level: the sorted codes that have an address, their addresses, and the map of all others."""

    codes: np.ndarray
    ids: np.ndarray
    by_id: np.ndarray
    others: np.ndarray | None

    def look_up(self, codes: np.ndarray, valid: np.ndarray) -> Symbols:
        ids = np.full(len(codes), -1, np.int64)
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            ids = np.where((self.codes[at] == codes) & valid, self.ids[at], -1)
        frequent = ids >= 0
        if self.others is not None:
            place = codes >> np.uint64(64 - MAP_BITS)
            bit = self.others[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1
            frequent |= valid & (bit == 1)
        return Symbols(codes, ids, frequent)


def pair_codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a * np.uint64(0x9FB21C651E98DF25)) + b * np.uint64(0xD6E8FEB86659FD93))


def words_of(raw: np.ndarray, offsets: np.ndarray, languages: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text, code, whether the next word follows in the same piece) of all words of lower-cased texts."""
    inside = ~_APART[raw]
    n = len(raw)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | cut[1:n]
    closes[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    distinct = languages.dictionary_encode()
    salts = hash_words(distinct.dictionary.to_pylist()) if len(distinct.dictionary) else np.zeros(0, np.uint64)
    salt = mix(salts * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))[distinct.indices.to_numpy(zero_copy_only=False)]
    codes = mix(span_hash(prefix_hash(raw), starts, ends) + salt[text]) if len(starts) else np.zeros(0, np.uint64)
    breaks = np.concatenate([[0], np.cumsum(_BREAK[raw])])
    follows = np.zeros(len(starts), bool)
    follows[:-1] = (text[1:] == text[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1]])
    return starts, ends, text, codes, follows


def _chunks(batches: Iterator[pa.RecordBatch]):
    """(language of each text, lower-cased bytes, offsets) of chunks of (lang, text) rows."""
    for batch, raw, offsets in text_chunks(batches, 1, 4 << 20):
        yield batch.column(0), lower_ascii(raw), offsets


def count_words(rows: DataFrame) -> DataFrame:
    """(lang, word, code, n) of all words of (lang, text) rows; a null word holds the number of all words of the language."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for languages, raw, offsets in _chunks(batches):
            starts, ends, text, codes, _ = words_of(raw, offsets, languages)
            distinct, first, count = np.unique(codes, return_index=True, return_counts=True)
            lengths = (ends - starts)[first]
            until = np.concatenate([[0], np.cumsum(lengths)])
            data = raw[np.repeat(starts[first] - until[:-1], lengths) + np.arange(until[-1])]
            words = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(until.astype(np.int32)), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [languages.take(pa.array(text[first])), words, pa.array(distinct.view(np.int64)), pa.array(count, pa.int64())],
                names=["lang", "word", "code", "n"],
            )
            totals = np.bincount(text, minlength=len(languages))
            yield pa.RecordBatch.from_arrays(
                [languages, pa.nulls(len(languages), pa.string()), pa.nulls(len(languages), pa.int64()), pa.array(totals, pa.int64())],
                names=["lang", "word", "code", "n"],
            )

    counted = map_arrow(rows, work, "lang string, word string, code long, n long")
    return counted.groupBy("lang", "word", "code").agg(F.sum("n").alias("n"))


class PairTiles:
    """Counts of (id, id) pairs: dense arrays for full tiles, sorted runs for the rest."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.held = 0
        self.dense: dict[int, np.ndarray] = {}

    def add(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes pairs; gives (a << 32 | b, count) of what is counted meanwhile."""
        if not len(a):
            return
        tile = (a >> TILE_BITS) << 32 | b >> TILE_BITS
        self.parts.append(tile << (2 * TILE_BITS) | (a & TILE - 1) << TILE_BITS | b & TILE - 1)
        self.held += len(a)
        if self.held >= BUFFER:
            yield from self._count()

    def _count(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        places = np.sort(np.concatenate(self.parts))
        self.parts, self.held = [], 0
        tiles = places >> (2 * TILE_BITS)
        heads = np.flatnonzero(np.concatenate([[True], tiles[1:] != tiles[:-1]]))
        sizes = np.diff(np.append(heads, len(places)))
        sparse = np.ones(len(places), bool)
        for k in np.flatnonzero(sizes >= TILE * TILE // DENSE_SHARE).tolist():
            first, last, tile = heads[k], heads[k] + sizes[k], int(tiles[heads[k]])
            counts = np.bincount(places[first:last] & (TILE * TILE - 1), minlength=TILE * TILE)
            if tile in self.dense:
                self.dense[tile] += counts
            elif len(self.dense) < OPEN_TILES:
                self.dense[tile] = counts
            else:
                yield self._cells(tile, counts)
            sparse[first:last] = False
        left = places[sparse]
        if len(left):
            heads = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
            yield self._pairs(left[heads]), np.diff(np.append(heads, len(left)))

    def _cells(self, tile: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        there = np.flatnonzero(counts)
        return self._pairs((tile << (2 * TILE_BITS)) | there), counts[there]

    @staticmethod
    def _pairs(places: np.ndarray) -> np.ndarray:
        tile, cell = places >> (2 * TILE_BITS), places & (TILE * TILE - 1)
        a = (tile >> 32) << TILE_BITS | cell >> TILE_BITS
        return a << 32 | (tile & 0xFFFFFFFF) << TILE_BITS | cell & (TILE - 1)

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.parts:
            yield from self._count()
        for tile, counts in self.dense.items():
            yield self._cells(tile, counts)
        self.dense = {}


def _runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of 64-bit codes and their counts."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    heads = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[heads], b[heads], np.diff(np.append(heads, len(a)))


def count_pairs(rows: DataFrame, rankings: list[Ranking]) -> DataFrame:
    """(a, b, n): how often symbols a and b of the last level stand one word apart; b is null where a packs two ids."""
    shared = rows.sparkSession.sparkContext.broadcast(rankings)
    schema = "a long, b long, n long"

    def batch(a, b, n) -> Iterator[pa.RecordBatch]:
        for first in range(0, len(a), 200_000):
            part = slice(first, first + 200_000)
            right = pa.nulls(len(a[part]), pa.int64()) if b is None else pa.array(b[part].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(a[part].view(np.int64)), right, pa.array(n[part], pa.int64())], names=["a", "b", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, tiles, loose, held = shared.value, PairTiles(), [], 0
        for languages, raw, offsets in _chunks(batches):
            *_, codes, follows = words_of(raw, offsets, languages)
            now = levels[0].look_up(codes, np.ones(len(codes), bool))
            both = now.valid[:-1] & now.valid[1:] & follows[:-1]
            for ranking in levels[1:]:
                now = ranking.look_up(pair_codes(now.codes[:-1], now.codes[1:]), both)
                both = now.valid[:-1] & now.valid[1:]
            at = np.flatnonzero(both)
            left, right = now.ids[at], now.ids[at + 1]
            near = (left >= 0) & (right >= 0)
            for pairs, n in tiles.add(left[near], right[near]):
                yield from batch(pairs, None, n)
            far = at[~near]
            if len(far):
                loose.append((now.codes[far], now.codes[far + 1]))
                held += len(far)
                if held >= BUFFER:
                    yield from batch(*_runs(*(np.concatenate(x) for x in zip(*loose, strict=True))))
                    loose, held = [], 0
        for pairs, n in tiles.rest():
            yield from batch(pairs, None, n)
        if loose:
            yield from batch(*_runs(*(np.concatenate(x) for x in zip(*loose, strict=True))))

    return map_arrow(rows, work, schema).groupBy("a", "b").agg(F.sum("n").alias("n"))


def rank(level: DataFrame, dense_ids: int = DENSE_IDS) -> Ranking:
    """Addresses by falling frequency for at most ``dense_ids`` symbols of (code, n), and the map of the others."""
    step = F.floor(F.log2("n") * BINS)
    bins = sorted(((r.step, r.k) for r in level.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    total, least = 0, None  # at most 64 * BINS rows above
    for value, k in bins:
        if total + k > dense_ids:
            break
        total, least = total + k, value
    others = None
    if least is None:
        top = np.zeros(0, np.int64), np.zeros(0, np.int64)
    else:
        found = level.where(step >= least).select("code", "n").toPandas()  # at most ``dense_ids`` rows
        top = found["code"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    if bins and total < sum(k for _, k in bins):
        rest = level if least is None else level.where(step < least)
        others = bit_map(rest, "code", MAP_BITS)
    codes = top[0].view(np.uint64)
    by_id = codes[np.lexsort((codes, -top[1]))]
    order = np.argsort(by_id)
    return Ranking(by_id[order], order.astype(np.int64), by_id, others)


def _with_codes(pairs: DataFrame, ranking: Ranking) -> DataFrame:
    """(code, a, b, n) with the codes of both symbols, and of the phrase that they make."""
    shared = pairs.sparkSession.sparkContext.broadcast(ranking.by_id)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1)
            packed = b.is_null().to_numpy(zero_copy_only=False)
            right = b.fill_null(0).to_numpy(zero_copy_only=False).copy().view(np.uint64)
            left = a.copy().view(np.uint64)
            left[packed], right[packed] = shared.value[a[packed] >> 32], shared.value[a[packed] & 0xFFFFFFFF]
            columns = [pa.array(x.view(np.int64)) for x in (pair_codes(left, right), left, right)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(2)], names=["code", "a", "b", "n"])

    return map_arrow(pairs, work, "code long, a long, b long, n long")


def _named(level: DataFrame, below: DataFrame) -> DataFrame:
    """Words, and counts of all shorter phrases inside, of the phrases of a level.

    ``parts[j]`` has the counts of the phrases of j + 1 words in their order.
    """
    a = below.select(F.col("code").alias("a"), "lang", F.col("words").alias("words_a"), F.col("parts").alias("parts_a"), F.col("n").alias("n_a"))
    b = below.select(F.col("code").alias("b"), F.col("words").alias("words_b"), F.col("parts").alias("parts_b"), F.col("n").alias("n_b"))
    inner = F.zip_with("parts_a", "parts_b", lambda x, y: F.concat(x, F.array(F.element_at(y, -1))))
    return level.join(a, "a").join(b, "b").select(
        "code", "a", "b", "lang", "n",
        F.concat("words_a", F.array(F.element_at("words_b", -1))).alias("words"),
        F.concat(inner, F.array(F.array("n_a", "n_b"))).alias("parts"),
    )


def _scored(level: DataFrame, longer: DataFrame | None, size: int, scale: int, inside: int) -> DataFrame:
    """Phrases of ``size`` words with their lowest-scoring cut, without those that a longer one covers."""
    cuts = ", ".join(
        f"named_struct('score', (cast(n as decimal(20,0)) * cast({scale} as decimal(10,0))) div cast(parts[{k - 1}][0] + element_at(parts[{size - k - 1}], -1) as decimal(20,0)), "
        f"'k', {k}, 'l', parts[{k - 1}][0], 'r', element_at(parts[{size - k - 1}], -1))"
        for k in range(1, size)
    )
    out = level.withColumn("cut", F.expr(f"array_min(array({cuts}))"))
    if longer is not None:
        # A phrase inside one two words longer is also inside the one between, which is as frequent at least.
        covers = longer.select(F.col("a").alias("code"), "n").union(longer.select(F.col("b").alias("code"), "n"))
        covers = covers.groupBy("code").agg(F.max("n").alias("n_longer"))
        out = out.join(covers, "code", "left").where(
            F.expr(f"n_longer is null or cast(n_longer as decimal(20,0)) * 100 < cast(n as decimal(20,0)) * {inside}")
        )
    return out.select("lang", F.array_join("words", " ").alias("phrase"), F.col("n").alias("a"), "cut.l", "cut.r", "cut.score")


def mine_collocations(
    docs: DataFrame, longest: int = 4, least: int = 30, top: int = 2000, scale: int = 2_000_000, inside: int = 80, dense_ids: int = DENSE_IDS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language."""
    rows = narrow(docs, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = materialise(count_words(rows).where((F.col("n") >= least) | F.col("word").isNull()), "words")
    totals = words.where("word is null").select("lang", F.col("n").alias("total"))
    words = words.where("word is not null")
    named = words.select("code", "lang", F.array("word").alias("words"), F.array().cast("array<array<bigint>>").alias("parts"), "n")
    levels, rankings = [named], [rank(words.select("code", "n"), dense_ids)]
    for size in range(2, longest + 1):
        pairs = count_pairs(rows, rankings).where(F.col("n") >= least)
        level = materialise(_with_codes(pairs, rankings[-1]), f"phrases-{size}")
        levels.append(materialise(_named(level, levels[-1]), f"named-{size}"))
        if size < longest:
            rankings.append(rank(level.select("code", "n"), dense_ids))
    found = None
    for size in range(2, longest + 1):
        longer = levels[size] if size < longest else None
        own = _scored(levels[size - 1], longer, size, scale, inside)
        found = own if found is None else found.union(own)
    # The first of each of SPLITS parts of a language, then the first of all: one task never orders a whole language.
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SPLITS)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    order = Window.partitionBy("lang").orderBy(*best)
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score"
    )
