"""N-gram Jaccard join by PartEnum signatures, and the components of its links.

A document's set holds the hashes of its distinct word shingles. Sets are put into size bands whose limits grow by
BAND_STEPS times 1 / threshold, so linked sets are in the same or in neighbouring bands; only sets so near the top of their
band that they may link into the next one give signatures for that one too. For a band with largest size r, linked sets
differ in at most k = 2 r (1 - t) / (1 + t) shingles. The domain of hashes is cut into n1 * N2 equal ranges; of each
run of N2 ranges every subset that leaves out K2 of them gives a signature. With n1 = ceil((k + 1) / (K2 + 1)),
two linked sets agree on at least one signature, so no link is lost. There are some runs more (MORE_RUNS), and a set's
own size often allows fewer differences than k, so linked sets agree in s + 1 runs at least. Each set then leaves
out signatures of s runs, chosen in one order for all sets: those of ranges without any shingle first, as
unrelated sets share them and their buckets would grow with the table. Of the signatures that linked sets share, the last in
that order is left out by neither: those up to it are of s + 1 runs.

Sets with one signature share a bucket. Buckets are never expanded into pairs: each round compares a few pivots of
a bucket with those members that aren't yet in the pivot's component, counts shingles in common exactly, and joins
components. Pivots leave the bucket afterwards; their number grows by PIVOT_GROWTH a round. A bucket ends when its members
are one component, so groups of copies end after a round or two, whatever their size. Equal sets are one node from the
start. Similar sets share many signatures: buckets of the same nodes are one bucket, so a pair isn't made once for each of them, and
a node is a pivot in all buckets of one size or in none, so fewer pairs of a group are made. From the second round on a row also has
the few buckets of its node before its own, in order of signatures: a pair that both met in one of these is not made again. The first
bucket that makes it has none before, so no pair is lost. A pair is checked in three steps, each for what the last one let pass: parities of the shingles on half as many bits as
shingles or more (SKETCH_LONGS * 64 at least), then on twice as many or more, then the whole sets. Parities may differ in no
more bits than linked sets may differ in shingles: never more bits than shingles differ, so no link is lost. Unrelated sets differ
in about half the bits, so the first step refuses them at every size. From the second round on pairs that it refuses aren't even made. Whole sets are read again from the texts, for sets in remaining
pairs alone: a bitmap of fixed size picks them where the texts lie, a join makes the choice exact.

All signatures travel once and are read once, in order; tables of a finished round are deleted.

Defined results: a null or empty text has no shingles, is its own component and links with nothing; a null doc_id takes
part like others, and a component without any id has the null id; repeated rows are one node; extra columns are
ignored; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from descria.llm.common import bit_map, discard, map_arrow, materialise, narrow, position, small_batches, text_chunks
from descria.llm.words import lower_ascii, mix, split_words, word_grams

SHINGLE_WORDS = 3
THRESHOLD = Fraction(9, 10)
#: Ranges in a run, and how many of them a signature leaves out.
N2, K2 = 3, 1
KEPT = list(combinations(range(N2), N2 - K2))
#: Runs beyond those that no link is lost with, as a share of them: of so many more a set may leave signatures out.
MORE_RUNS = Fraction(1, 16)
#: Width of a band in powers of 1 / threshold: wide ones have longer lists of signatures, narrow ones more sets at the top.
BAND_STEPS = 2
#: Bits of the maps that pick sets and rows where the texts lie: 2 MB, whatever the number of sets.
MAP_BITS = 24
#: Keys that a task remembers so as not to give the set of a copy again.
KEPT_KEYS = 200_000
PIVOT_GROWTH = 8
#: So many buckets before a bucket are looked at for a pair that has met there.
EARLIER = 8
SKETCH_LONGS = 8
NO_SET = 0


@lru_cache(maxsize=4096)
def _bands(threshold: Fraction, size: int) -> int:
    """Number of the size band of ``size``: bands are [1, 1], then on by a factor 1/t to the power BAND_STEPS."""
    band, top = 0, 1
    while top < size:
        band, top = band + 1, _next_top(threshold, top)
    return band


def _next_top(threshold: Fraction, top: int) -> int:
    """Upper limit of the band after the one that ends at ``top``; at least the largest size that links into it."""
    top += 1
    for _ in range(BAND_STEPS):
        top = int(top / threshold)
    return top


@lru_cache(maxsize=4096)
def _top(threshold: Fraction, band: int) -> int:
    top = 1
    for _ in range(band):
        top = _next_top(threshold, top)
    return top


@lru_cache(maxsize=4096)
def _runs(threshold: Fraction, band: int) -> int:
    """n1 of a band; 0 where only equal sets are linked, as these are one node already."""
    most_different = int(2 * _top(threshold, band) * (1 - threshold) / (1 + threshold))
    least = -(-(most_different + 1) // (K2 + 1))
    return least + ceil(least * MORE_RUNS) if most_different else 0


def _distinct(doc: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    return doc[new], grams[new]


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted shingle hashes of all texts, ends by text, key of each set). The key of an empty set is NO_SET."""
    words = split_words(lower_ascii(raw), offsets)
    texts = len(offsets) - 1
    grams, ends = word_grams(words, size)
    doc = np.repeat(np.arange(texts), np.diff(ends))
    lengths = np.diff(words.first)
    for i in np.flatnonzero((lengths > 0) & (lengths < size)):
        # Too short for a shingle: the words in order, under a seed of their own, are the only element.
        one = np.uint64(len(words.hashes[words.first[i] : words.first[i + 1]]))
        for h in words.hashes[words.first[i] : words.first[i + 1]]:
            one = mix(np.array([one], np.uint64) * np.uint64(0x9FB21C651E98DF25) + h)[0]
        doc, grams = np.append(doc, i), np.append(grams, one)
    doc, grams = _distinct(doc, grams)
    ends = np.searchsorted(doc, np.arange(texts + 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams + np.uint64(0x5851F42D4C957F2D)))])
    key = mix(sums[ends[1:]] - sums[ends[:-1]] + np.diff(ends).astype(np.uint64))
    key[np.diff(ends) == 0] = NO_SET
    return grams, ends, key


@lru_cache(maxsize=4096)
def _spare_runs(threshold: Fraction, band: int, size: int) -> int:
    """How many runs of a band a set of ``size`` may leave out: one less than the runs that it shares with any linked set."""
    partner = min(int(size / threshold), _top(threshold, band))
    different = int((size + partner) * (1 - threshold) / (1 + threshold))
    # Sets that differ in nothing are one node already.
    return _runs(threshold, band) - different // (K2 + 1) - 1 if different else _runs(threshold, band)


def signatures(grams: np.ndarray, threshold: Fraction = THRESHOLD) -> np.ndarray:
    """The signatures that one set gives, given as sorted distinct 64-bit hashes."""
    band = _bands(threshold, len(grams))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams))])
    out = []
    reaches = int(len(grams) / threshold) > _top(threshold, band)
    for instance in (band, band + 1) if reaches else (band,):
        runs = _runs(threshold, instance)
        spare = _spare_runs(threshold, instance, len(grams)) if runs else 0
        if spare == runs:
            continue
        ranges = runs * N2
        # Equal ranges of the upper 32 bits; a set has its elements of a range next to each other.
        at = np.searchsorted((grams >> np.uint64(32)).astype(np.int64) * ranges >> 32, np.arange(ranges + 1))
        held = np.diff(at).reshape(runs, N2)
        part = (sums[at[1:]] - sums[at[:-1]]).reshape(runs, N2) + held.astype(np.uint64)
        own, filled = np.empty((runs, len(KEPT)), np.uint64), np.zeros((runs, len(KEPT)), bool)
        for i, kept in enumerate(KEPT):
            tag = np.uint64((instance << 8) + sum(1 << j for j in kept)) + (np.arange(runs, dtype=np.uint64) << np.uint64(32))
            own[:, i] = mix(tag)
            for j in kept:
                own[:, i] = mix(own[:, i] + part[:, j])
                filled[:, i] |= held[:, j] > 0
        # Those of no shingle first, then run by run: they go until ``spare`` runs are met.
        order = np.argsort(filled.ravel(), kind="stable")
        run = order // len(KEPT)
        opens = np.zeros(len(order), np.int64)
        opens[np.unique(run, return_index=True)[1]] = 1
        out.append(own.ravel()[order[np.cumsum(opens) > spare]])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def parities(grams: np.ndarray, longs: int = SKETCH_LONGS) -> np.ndarray:
    """Whether an odd number of shingles falls on each of ``longs`` * 64 bits."""
    bits = longs * 64
    odd = np.bincount((grams.view(np.uint64) % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def folded(sketch: np.ndarray, longs: int) -> np.ndarray:
    """Parities on fewer bits; both lengths are powers of two."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, longs), axis=0)


def wide_longs(size: int) -> int:
    """Longs of the wide parities of a set: two bits a shingle at least, a power of two."""
    return max(SKETCH_LONGS, 1 << (-(-size // 32) - 1).bit_length()) if size else SKETCH_LONGS


def _with_keys_and_parities(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, wide parities); equal sets carry parities once in a task's slice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in text_chunks(batches, 1):
            grams, ends, key = shingle_sets(raw, offsets, size)
            wide = [_NOTHING] * len(key)
            for i in _firsts(key):
                wide[i] = parities(grams[ends[i] : ends[i + 1]], wide_longs(int(ends[i + 1] - ends[i])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(key.view(np.int64)), list_array(wide)],
                names=["doc_id", "n_shingles", "set_key", "wide"],
            )

    return map_arrow(docs, work, "doc_id long, n_shingles long, set_key long, wide array<long>")


def _signature_rows(docs: DataFrame, size: int, threshold: Fraction) -> DataFrame:
    """(signature, node, n) of all sets; equal sets of a task's slice give theirs once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raw, offsets in text_chunks(batches, 0, 1 << 18):
            grams, ends, key = shingle_sets(raw, offsets, size)
            lists, own = [], []
            for i in _firsts(key):
                lists.append(signatures(grams[ends[i] : ends[i + 1]], threshold)), own.append(i)
            counts = [len(x) for x in lists]
            flat = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
            nodes, sizes = np.repeat(key[own].view(np.int64), counts), np.repeat(np.diff(ends)[own], counts)
            for first in range(0, len(flat), 50_000):
                part = slice(first, first + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat[part].view(np.int64)), pa.array(nodes[part]), pa.array(sizes[part], pa.int64())], names=["signature", "node", "n"]
                )

    return map_arrow(docs.select("text"), work, "signature long, node long, n long")


def _of_several_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct rows of those signatures that several nodes have, from rows in order of both; holds one row back at most."""
    held, going_on = None, None  # a row that is alone so far; the last row given of a signature that may go on
    for batch in batches:
        rows = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
        if held is not None:
            rows = np.concatenate([held, rows])
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        if going_on is not None and len(rows):
            fresh[0] = (rows[0, :2] != going_on).any()
        rows = rows[fresh]
        if not len(rows):
            continue
        shared = np.zeros(len(rows), bool)
        again = rows[1:, 0] == rows[:-1, 0]
        shared[1:] |= again
        shared[:-1] |= again
        if going_on is not None:
            shared |= rows[:, 0] == going_on[0]
        held = None if shared[-1] else rows[-1:]
        going_on = rows[-1, :2] if shared[-1] else None
        out = rows[shared]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[:, k])) for k in range(3)], names=["signature", "node", "n"])


def _firsts(key: np.ndarray) -> list[int]:
    """Where each key but that of the empty set occurs first."""
    _, first = np.unique(key, return_index=True)
    return [i for i in np.sort(first).tolist() if key[i] != NO_SET]


_NOTHING = np.zeros(0, np.int64)


def list_array(lists: list[np.ndarray]) -> pa.ListArray:
    until = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(until), pa.array(np.concatenate(lists) if lists else _NOTHING))


def _sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(set_key, shingles) of the wanted sets, each once; read again from the texts."""
    picked = docs.sparkSession.sparkContext.broadcast(bit_map(wanted, "set_key", MAP_BITS))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for _, raw, offsets in text_chunks(batches, 0):
            grams, ends, key = shingle_sets(raw, offsets, size)
            place = key >> np.uint64(64 - MAP_BITS)
            bit = picked.value[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1
            usable = np.flatnonzero((bit == 1) & (key != NO_SET))
            _, first = np.unique(key[usable], return_index=True)
            chosen = [i for i in usable[np.sort(first)].tolist() if int(key[i]) not in done]
            if len(done) < KEPT_KEYS:
                done.update(key[chosen].tolist())
            sets = [grams[ends[i] : ends[i + 1]].view(np.int64) for i in chosen]
            yield pa.RecordBatch.from_arrays([pa.array(key[chosen].view(np.int64)), list_array(sets)], names=["set_key", "shingles"])

    found = map_arrow(docs.select("text"), work, "set_key long, shingles array<long>").join(wanted, "set_key", "left_semi")
    return found.groupBy("set_key").agg(F.first("shingles").alias("shingles"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of (a, b) links; root is the smallest node reachable.

    Alternates two regroupings that hang every node's neighbours below its smallest neighbour, until nothing changes;
    every round is written to the shared folder.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    links = materialise(links, "links")
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Larger neighbours of u go below the smallest node around u ...
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct(), "links")
        # ... then smaller neighbours of u do.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = materialise(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        if links.count() == small.count() and small.join(links, ["u", "v"], "left_anti").isEmpty():
            break
        links = small
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def _within_parity_bound(sketch: str, n: str, other_sketch: str, other_n: str, threshold: Fraction) -> Column:
    """Whether no more parity bits differ than shingles may between linked sets of these sizes."""
    x, y = F.col(sketch), F.col(other_sketch)
    short = sum(F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(SKETCH_LONGS))
    longs = F.least(F.size(x), F.size(y))

    def at(sketch: Column, i: Column) -> Column:
        # One sketch may be twice as long as the other, see _sketch_longs; it is folded on its way.
        return F.get(sketch, i).bitwiseXOR(F.coalesce(F.get(sketch, i + longs), F.lit(0).cast("long")))

    long_ = F.aggregate(F.sequence(F.lit(0), longs - 1), F.lit(0), lambda sum_, i: sum_ + F.bit_count(at(x, i).bitwiseXOR(at(y, i))))
    apart = F.when(F.greatest(F.size(x), F.size(y)) == SKETCH_LONGS, short).otherwise(long_)
    least, most = threshold.denominator + threshold.numerator, threshold.denominator - threshold.numerator
    return apart * F.lit(least) <= (F.col(n) + F.col(other_n)) * F.lit(most)


def _within_wide_bound(pairs: DataFrame, threshold: Fraction) -> DataFrame:
    """Those (a, b, wide_a, n_a, wide_b, n_b) whose wide parities, folded to the shorter of both, allow a link; (a, b)."""
    least, most = threshold.denominator + threshold.numerator, threshold.denominator - threshold.numerator

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(6)]
            keep = []
            for x, n, y, m in zip(columns[2], columns[3].to_pylist(), columns[4], columns[5].to_pylist(), strict=True):
                x, y = (v.values.to_numpy() for v in (x, y))
                longs = min(len(x), len(y))
                apart = int(np.bitwise_count((folded(x, longs) ^ folded(y, longs)).view(np.uint64)).sum())
                keep.append(apart * least <= (n + m) * most)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(pairs, work, "a long, b long")


def _linked(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, size: int, threshold: Fraction) -> DataFrame | None:
    """Those (a, b) pairs whose sets are similar enough, counted exactly; None if none is."""
    narrow_, wide = (
        [sketches.select(F.col("set_key").alias(x), F.col(c).alias(f"{c}_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab"]
        for c in ("sketch", "wide")
    )
    may_link = _within_parity_bound("sketch_a", "n_a", "sketch_b", "n_b", threshold)
    near = pairs.join(narrow_[0], "a").join(narrow_[1], "b").where(may_link).select("a", "b")
    near = near.join(wide[0], "a").join(wide[1], "b").select("a", "b", "wide_a", "n_a", "wide_b", "n_b")
    near = materialise(_within_wide_bound(near, threshold), "near")
    if near.isEmpty():
        return None
    wanted = near.select(F.col("a").alias("set_key")).union(near.select(F.col("b").alias("set_key"))).distinct()
    sets = materialise(_sets_of(docs, wanted, size), "sets")
    a = sets.select(F.col("set_key").alias("a"), F.col("shingles").alias("of_a"))
    b = sets.select(F.col("set_key").alias("b"), F.col("shingles").alias("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    both = F.size("of_a") + F.size("of_b") - shared
    close = shared * F.lit(threshold.denominator) >= both * F.lit(threshold.numerator)
    found = materialise(near.join(a, "a").join(b, "b").where(close).select("a", "b"), "found")
    discard(near), discard(sets)
    return found


def _apply_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    new = roots.select(F.col("node").alias("root"), F.col("root").alias("new_root"))
    joined = members.join(new, "root", "left")
    return joined.select("signature", "node", "n", F.coalesce("new_root", "root").alias("root"))


def _open_buckets(members: DataFrame) -> DataFrame:
    """(signature, members, first) of the buckets of several components; one of those with the same nodes.

    Nodes are told by their number, the smallest and two 64-bit sums, as sets are by their key.
    """
    sums = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"sum{k}") for k in range(2)]
    buckets = members.groupBy("signature").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("members"), F.min("node").alias("first"), *sums
    )
    same = buckets.where("low <> high").groupBy("members", "first", "sum0", "sum1").agg(F.min("signature").alias("signature"))
    return same.select("signature", "members", "first")


def _meetings(members: DataFrame, sketches: DataFrame, pivots: int, threshold: Fraction) -> DataFrame:
    """(a, b) of pivots and other members of their buckets that may link; a pair may come more than once."""
    others = members
    if pivots > 1:
        before = Window.partitionBy("node").orderBy("signature").rowsBetween(-EARLIER, -1)
        others = others.join(sketches.select(F.col("set_key").alias("node"), "sketch"), "node").withColumns(
            {"met": F.collect_list("signature").over(before), "led": F.collect_list(F.when(F.col("pivot"), F.col("signature"))).over(before)}
        )
    own = others.where("pivot").drop("met")
    own = own.select("signature", *[F.col(c).alias(f"p_{c}") for c in own.columns if c not in ("signature", "pivot")])
    own = own.withColumnRenamed("p_node", "p")
    may_link = (F.col("root") != F.col("p_root")) & (
        F.least("n", "p_n") * F.lit(threshold.denominator) >= F.greatest("n", "p_n") * F.lit(threshold.numerator)
    )
    if pivots > 1:
        # Two pivots meet twice in a bucket; once is enough.
        may_link &= ~F.col("pivot") | (F.col("p") < F.col("node"))
        may_link &= _within_parity_bound("sketch", "n", "p_sketch", "p_n", threshold)
        may_link &= ~F.arrays_overlap("met", "p_led")
    pairs = others.drop("led").join(own, "signature").where(may_link)
    return pairs.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b"))


def linked_sets(table: DataFrame, docs: DataFrame, size: int, threshold: Fraction) -> DataFrame | None:
    """(node, root) over set keys that have links; None if there is no link."""
    dealt = _signature_rows(docs, size, threshold).repartition("signature").sortWithinPartitions("signature", "node")
    members = map_arrow(dealt, _of_several_nodes, "signature long, node long, n long")
    members = materialise(members.withColumn("root", F.col("node")), "members")
    if members.isEmpty():
        return None
    longs = _sketch_longs(threshold)
    sketch = F.transform(F.sequence(F.lit(0), longs - 1), lambda place: _folded_long(place, longs))
    sketches = table.where(F.size("wide") > 0).groupBy("set_key").agg(F.first("n_shingles").alias("n"), F.first("wide").alias("wide"))
    sketches = materialise(sketches.select("set_key", "n", "wide", sketch.alias("sketch")), "sketches")
    links, compared, roots, pivots = None, None, None, 1
    while True:
        chance = F.pmod(F.xxhash64("node", F.lit(pivots)), F.lit(1 << 20)) * F.col("members") < F.lit(pivots << 20)
        chosen = members.join(_open_buckets(members), "signature").select(
            "signature", "node", "n", "root", ((F.col("node") == F.col("first")) | (F.lit(pivots > 1) & chance)).alias("pivot")
        )
        chosen = materialise(chosen, "members")
        discard(members)
        members = chosen
        if members.isEmpty():
            break
        pairs = _meetings(members, sketches, pivots, threshold).distinct()
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        compared = pairs if compared is None else compared.union(pairs)
        found = _linked(pairs, sketches, docs, size, threshold)
        if found is not None and not found.isEmpty():
            links = found if links is None else links.union(found)
            roots = materialise(components(links), "roots")
        left = members.where("not pivot").select("signature", "node", "n", F.col("node").alias("root"))
        # The next round's table reads the members once more and then replaces them.
        members = left if roots is None else _apply_roots(left, roots)
        members = materialise(members, "left")
        discard(chosen)
        pivots *= PIVOT_GROWTH
    return roots


def _sketch_longs(threshold: Fraction) -> Column:
    """Longs of the narrow sketch: a quarter of the wide one. Sets that may link are of sizes less than a factor two apart, so
    lengths are equal or twice each other; thresholds too low for that have one length only."""
    if 2 * threshold <= 1:
        return F.lit(SKETCH_LONGS)
    return F.greatest(F.lit(SKETCH_LONGS), F.shiftright(F.size("wide"), 2))


def _folded_long(place: Column, longs: Column) -> Column:
    """Parities of one long of the narrow sketch: those of all longs of the wide one that fold on it."""
    return F.aggregate(
        F.transform(F.sequence(place, F.size("wide") - 1, longs), lambda k: F.get("wide", k)),
        F.lit(0).cast("long"),
        lambda all_, one: all_.bitwiseXOR(one),
    )


def jaccard_components(docs: DataFrame, size: int = SHINGLE_WORDS, threshold: Fraction = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document."""
    return _placed(docs, size, threshold).select("doc_id", "n_shingles", "component_id")


def _placed(docs: DataFrame, size: int, threshold: Fraction) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_key, root) per document; all that Python does is done when it returns."""
    with small_batches(docs.sparkSession):
        return _with_components(docs, size, threshold)


def _with_components(docs: DataFrame, size: int, threshold: Fraction) -> DataFrame:
    rows = narrow(docs, "doc_id", "text")
    rows = rows.select(rows.doc_id.cast("long").alias("doc_id"), "text")
    table = materialise(_with_keys_and_parities(rows, size), "keys")
    plain = table.select("doc_id", "n_shingles", "set_key")
    roots = linked_sets(table, rows, size, threshold)
    if roots is not None:
        plain = plain.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left")
        plain = materialise(plain.select("doc_id", "n_shingles", "set_key", F.coalesce("root", "set_key").alias("root")), "rooted")
    else:
        plain = plain.withColumn("root", F.col("set_key"))
    # Written first, so that the join below stands alone and Spark can split the rows of a large group.
    names = materialise(plain.where(F.col("set_key") != NO_SET).groupBy("root").agg(F.min("doc_id").alias("least_id")), "names")
    some = plain.where(F.col("set_key") != NO_SET).join(names, "root").select("doc_id", "n_shingles", F.col("least_id").alias("component_id"), "set_key", "root")
    none = plain.where(F.col("set_key") == NO_SET).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "set_key", "root")
    return some.union(none)


def _with_keys(docs: DataFrame, at: int, size: int) -> DataFrame:
    """``docs`` and the key of the set of each text, the column at ``at``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in text_chunks(batches, at):
            key = pa.array(shingle_sets(raw, offsets, size)[2].view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, key], names=[*batch.schema.names, "set_key"])

    return map_arrow(docs, work, T.StructType([*docs.schema.fields, T.StructField("set_key", T.LongType())]))


def keep_first(docs: DataFrame, size: int = SHINGLE_WORDS, threshold: Fraction = THRESHOLD) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest id, and documents without id or shingles.

    Where an id is on several texts, a row stays if its own set is the kept one of its component. A bitmap of fixed size tells ids
    that are on one row and first of their component; only other rows, and those that look like them, meet the kept ids in a join.
    """
    found = materialise(_placed(docs, size, threshold), "placed")
    times = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"))
    kept = found.where("doc_id = component_id").groupBy("root", "doc_id").agg(F.min("set_key").alias("set_key"))
    kept = materialise(kept.join(times, "doc_id").select("doc_id", "set_key", "times"), "kept")
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"), F.bool_and(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("first"))
    marks = materialise(_marks(ids.where("doc_id is not null and (times > 1 or not first)").select("doc_id")), "marks")
    at = position(docs, "doc_id")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    key, names = f"c{at}", plain.columns
    place = _mark_place(F.col(key).cast("long"))
    marked = plain.join(F.broadcast(marks), F.shiftright(place, 6) == F.col("mark_at"), "left")
    bit = F.coalesce(F.getbit("marks", place.bitwiseAND(F.lit(63))), F.lit(0))
    sure = marked.where((bit == 0) | F.col(key).isNull()).select(names)
    plain = marked.where(bit == 1).select(names)
    kept = kept.withColumnRenamed("doc_id", key)
    once = plain.join(kept.where("times = 1").select(key), key, "left_semi")
    # Rows that repeat an id: few, so only they are moved.
    several = kept.where("times > 1").select(key, "set_key")
    again = plain.join(several.select(key), key, "left_semi")
    again = _with_keys(again, position(docs, "text"), size).join(several, [key, "set_key"], "left_semi")
    again = again.dropDuplicates([key, "set_key"]).select(plain.columns)
    return sure.union(once).union(again).toDF(*docs.columns)


def _mark_place(doc_id: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(doc_id), 64 - MAP_BITS)


def _marks(ids: DataFrame) -> DataFrame:
    """(mark_at, marks): the longs of a bitmap of MAP_BITS with any bit set, however many ids there are."""
    place = _mark_place(F.col("doc_id"))
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    return ids.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("mark_at")).agg(F.bit_or(bit).alias("marks"))
