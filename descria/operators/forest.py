"""Regression forests whose trees, also those over different columns, are grown together.

Values become bins of at most ``max_bins`` ranges, once. Growth has two phases:

1. Levels. While a node has more than ``local_rows`` rows, its best split comes from sums of label moments by (node,
   column, bin). One scan per level takes these sums for all open nodes of all trees, each task adding up its own rows
   first, Spark the rest; only one row per node comes back. Nodes that do not fit in one scan's budget take another one.
2. Subtrees. A node of at most ``local_rows`` rows is bounded, so its cells go to one group, packed column-wise, and
   all of its subtree is grown there. A table of no more rows, or of up to ``WHOLE_ROWS`` rows for many forests, has no levels: groups
   get all its rows and grow many trees each. A table of no more cells has none either: a group gets the cells of a tree.

Rows with equal bins are never parted, so both phases work on cells: sums of weights and labels over such rows. Above
``local_rows`` the table is stored in the order of the bins, and what moves for a tree is cells, not rows.

So the number of scans is the depth of the large nodes only, no forest travels with tasks, and depth costs nothing to
schedule. Bootstrap weights (Poisson with mean 1) and column choices are hashes of row, tree and node: a lost
task gives the same again. For 0/1 labels the gain equals that of the Gini index.

Defined results: rows without label or with a missing value are an error of the caller (impute first); an empty table or constant
labels give trees of one leaf; ties go to the earlier column, then the lower bin.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descria.columns import quoted
from descria.errors import DescriaError
from descria.storage import materialise, ship_package

MAX_BINS = 32
#: Rows of a node whose subtree one group grows; about 100 bytes each while it grows.
LOCAL_ROWS = 1_000_000
#: Rows of a table that goes whole to each group where many forests are grown: each group then has whole forests, and sends back
#: errors instead of predictions. About 100 bytes a row while the forest of most cells grows.
WHOLE_ROWS = 6_000_000
#: As ``LOCAL_ROWS``, where rows of the fold left out come with them and all trees are deep.
FOLD_ROWS = 250_000
#: Rows that a task of the clustered table has.
_CLUSTER_ROWS = 500_000
#: Nodes of up to so many cells are split from their cells in order, larger ones from sums by bin.
_WIDTHS = (4, 8, 16)
#: Rows of a block of the clustered table.
_BLOCK_ROWS = 40_000
#: Rows drawn at once, so that intermediate numbers stay in a processor's cache.
_DRAWN_ROWS = 16_384
#: Sums of a column (node, bin) that are searched at once, likewise.
_SPLIT_SUMS = 16_384
#: Levels with no more sums (node, bin) than this are split from these sums alone.
_DENSE_SUMS = 30_000
#: Sums (node, column, bin) that one scan takes.
SCAN_CELLS = 4_000_000
#: Gains below this share of a node's own label sum of squares are rounding errors.
LEAST_GAIN = 1e-10
GROWN = "kind string, forest int, tree int, key long, y double, value double, n long"


@dataclass(frozen=True)
class Plan:
    """What is grown: the columns of each forest, and the rules all trees share."""

    forests: list[list[int]]
    trees: int
    depth: int
    min_leaf: int
    sampled: list[int]  # columns tried at a node, by forest
    bootstrap: bool
    seed: int
    #: By forest, in searches: the fold it does not learn from (rows then have their fold as number), its rows in a leaf at least.
    left_out: list[int] | None = None
    least_rows: list[int] | None = None

    def forest_of(self, tree: int) -> int:
        return tree // self.trees

    def min_leaf_of(self, tree: int) -> int:
        return self.min_leaf if self.least_rows is None else self.least_rows[self.forest_of(tree)]


@dataclass
class Top:
    """The finished levels of one tree; a node without column is a leaf so far."""

    column: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    path: list[int] = field(default_factory=lambda: [1])
    parent: list[int] = field(default_factory=lambda: [-1])
    mean: list[float] = field(default_factory=lambda: [0.0])  # of the labels, of nodes with children

    def split(self, node: int, column: int, bin_: int, mean: float = 0.0) -> tuple[int, int]:
        """Gives a leaf two children and returns their numbers."""
        self.column[node], self.bin[node], self.left[node], self.mean[node] = column, bin_, len(self.column), mean
        for side in (0, 1):
            self.column.append(-1), self.bin.append(0), self.left.append(-1)
            self.path.append(2 * self.path[node] + side), self.parent.append(node), self.mean.append(0.0)
        return self.left[node], self.left[node] + 1

    def means_above(self, node: int) -> list[float]:
        """Mean labels of the nodes above, from the root on."""
        out: list[float] = []
        while (node := self.parent[node]) >= 0:
            out.append(self.mean[node])
        return out[::-1]

    def route(self, bins: np.ndarray) -> np.ndarray:
        column, bin_, left = (np.array(x) for x in (self.column, self.bin, self.left))
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            inner = column[node] >= 0
            if not inner.any():
                return node
            right = bins[rows, np.maximum(column[node], 0)] > bin_[node]
            node = np.where(inner, left[node] + right, node)


#: Deepest trees; stands for "unlimited" (a path has a bit for each level).
DEEPEST = 60
#: Forests whose trees are grown in one go: bounds what the driver lists.
FORESTS_AT_ONCE = 2_000
#: Forests of a unit whose cells are held at once; a draw serves all of them.
_FORESTS_BESIDE = 3
#: Up to so many forests their trees are dealt one by one.
_MANY_FORESTS = 8


def _mixed(h: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = h ^ (h >> np.uint64(33))
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(33))


#: Shares of the draws of a Poisson variable with mean 1 that are at most 0, 1, 2, ...
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))
#: The draw by the first 16 bits of the number it comes from; -1 where the other bits decide.
_DRAWS = np.searchsorted(_POISSON, np.arange(1 << 16) / float(1 << 16), "right").astype(np.int8)
_DRAWS[(np.searchsorted(_POISSON, np.arange(1, (1 << 16) + 1) / float(1 << 16), "right") != _DRAWS)] = -1


def weights(rows: np.ndarray, tree: int, plan: Plan) -> np.ndarray:
    """How often each row is in the tree's sample. Trees of the same number in different forests draw alike."""
    if plan.left_out is not None:
        return (rows != plan.left_out[plan.forest_of(tree)]).astype(np.float64)
    if not plan.bootstrap:
        return np.ones(len(rows))
    salt = _mixed(np.array([plan.seed * 1_000_003 + tree % plan.trees], np.uint64))[0]
    out = np.empty(len(rows))
    for first in range(0, len(rows), _DRAWN_ROWS):
        drawn = _mixed(rows[first : first + _DRAWN_ROWS].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt)
        times = _DRAWS[drawn >> np.uint64(48)]
        unsure = np.flatnonzero(times < 0)
        times[unsure] = np.searchsorted(_POISSON, (drawn[unsure] >> np.uint64(11)) / float(1 << 53), "right")
        out[first : first + _DRAWN_ROWS] = times
    return out


def allowed_columns(plan: Plan, tree: int, paths: np.ndarray) -> np.ndarray:
    """Which of the forest's columns each node may split on: the ones with the smallest hashes."""
    columns, wanted = plan.forests[plan.forest_of(tree)], plan.sampled[plan.forest_of(tree)]
    if wanted >= len(columns):
        return np.ones((len(paths), len(columns)), bool)
    salt = _mixed(np.array([plan.seed * 7_368_787 + tree % plan.trees], np.uint64))[0]
    drawn = _mixed(_mixed(paths.astype(np.uint64) + salt)[:, None] + np.arange(len(columns), dtype=np.uint64)[None, :])
    return drawn.argsort(axis=1).argsort(axis=1) < wanted


def _best_places(w: np.ndarray, s: np.ndarray, bins: list[np.ndarray], allowed: np.ndarray, min_leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """(last bin of the left side, gain) of each node's best split on one column."""
    wl, sl = np.cumsum(w, axis=1)[:, :-1], np.cumsum(s, axis=1)[:, :-1]
    w_all, s_all = w.sum(1, keepdims=True), s.sum(1, keepdims=True)
    wr, sr = w_all - wl, s_all - sl
    fits = (wl >= min_leaf) & (wr >= min_leaf) & allowed
    if bins:
        fits &= bins[0][:, :-1] != bins[0][:, 1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.where(fits, sl * sl / wl + sr * sr / wr - s_all * s_all / w_all, 0.0)
    at = own.argmax(axis=1)
    rows = np.arange(len(own))
    return bins[0][rows, at] if bins else at, own[rows, at]


def best_splits(sums, n_columns: int, allowed: np.ndarray, min_leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column place, bin, gain) of each node's best split; gain 0 where none is worth it.

    ``sums(k)`` gives (weight, sum of labels) by node and bin of the k-th column. Where it adds a third array, that has the
    bins of the places, ascending; a bin ends where the next one differs.
    """
    column = bin_ = gain = None
    for k in range(n_columns):
        w, s, *bins = sums(k)
        at, here = np.zeros(len(w), np.int64), np.zeros(len(w))
        some = max(1, _SPLIT_SUMS // max(1, w.shape[1]))
        for first in range(0, len(w) if w.shape[1] > 1 else 0, some):
            nodes = slice(first, first + some)
            places = [x[nodes] for x in bins]
            at[nodes], here[nodes] = _best_places(w[nodes], s[nodes], places, allowed[nodes, k : k + 1], max(min_leaf, 1))
        if gain is None:
            column, bin_, gain = np.zeros(len(here), np.int64), at, here
        else:
            better = here > gain * (1 + 1e-12)
            column, bin_, gain = np.where(better, k, column), np.where(better, at, bin_), np.where(better, here, gain)
    return column, bin_, gain


def _cells(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each cell, cell of each row): rows with equal bins, which no split can part, are one cell.

    Where that saves less than half of the rows (of a large table: a tenth), each row is its own cell.
    """
    padded = np.zeros((len(bins), -(-bins.shape[1] // 8) * 8), np.uint8)
    padded[:, : bins.shape[1]] = bins
    words = padded.view(np.uint64)
    if words.shape[1] == 1:
        order = np.argsort(words[:, 0], kind="stable")
    else:
        order = np.lexsort(words.T)
    words = words[order]
    fresh = np.ones(len(bins), bool)
    fresh[1:] = (words[1:] != words[:-1]).any(axis=1)
    del words, padded
    if fresh.sum() > (0.5 if len(bins) <= LOCAL_ROWS else 0.9) * len(bins):
        return np.arange(len(bins)), np.arange(len(bins))
    cell = np.empty(len(bins), np.int64)
    cell[order] = np.cumsum(fresh) - 1
    return order[fresh], cell


def _picked(bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The given rows of a table that is stored by column, stored likewise."""
    out = np.empty((len(rows), bins.shape[1]), bins.dtype, order="F")
    for k in range(bins.shape[1]):
        np.take(bins[:, k], rows, out=out[:, k])
    return out


def _dense_sums(bins: np.ndarray, columns: Sequence[int], own: np.ndarray, w: np.ndarray, s: np.ndarray, m: int, n_bins: int):
    first = own * n_bins

    def sums(k: int):
        key = first + bins[:, columns[k]]
        return tuple(np.bincount(key, x, m * n_bins).reshape(m, n_bins) for x in (w, s))

    return sums


def _sorted_sums(bins: np.ndarray, columns: Sequence[int], own: np.ndarray, w: np.ndarray, s: np.ndarray, count: np.ndarray, width: int):
    """Sums of nodes of at most ``width`` cells: a place for each cell, by bin, instead of one for each bin."""
    place = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)  # ``own`` ascends
    ws, ss = (np.zeros((len(count), width)) for _ in range(2))
    ws[own, place], ss[own, place] = w, s

    def sums(k: int):
        # (bin, place) in one number; places without a cell come last.
        both = np.full((len(count), width), 256 * 256 + width, np.int32)
        both[own, place] = bins[:, columns[k]].astype(np.int32) * 256 + place
        both.sort(axis=1)
        at = np.minimum(both & 255, width - 1)
        empty = both >= 256 * 256
        return (
            np.where(empty, 0.0, np.take_along_axis(ws, at, 1)), np.where(empty, 0.0, np.take_along_axis(ss, at, 1)),
            both >> 8,
        )

    return sums


def _splits_of_level(
    bins: np.ndarray, w: np.ndarray, s: np.ndarray, own: np.ndarray, count: np.ndarray, columns: Sequence[int], allowed: np.ndarray, min_leaf: int, n_bins: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best splits of the nodes of a level from their cells; most nodes of deep levels have few."""
    column, bin_, gain = np.zeros(len(count), np.int64), np.zeros(len(count), np.int64), np.zeros(len(count))
    if len(count) * n_bins <= max(_DENSE_SUMS, 4 * len(own)):
        return best_splits(_dense_sums(bins, columns, own, w, s, len(count), n_bins), len(columns), allowed, min_leaf)
    order = np.argsort(own, kind="stable")
    least = 1
    for width in (*[x for x in _WIDTHS if x < n_bins], None):
        nodes = np.flatnonzero((count > least) & (count <= (width or len(own))))
        if len(nodes):
            number = np.full(len(count), -1)
            number[nodes] = np.arange(len(nodes))
            use = order[number[own[order]] >= 0]
            args = (bins[use], columns, number[own[use]], w[use], s[use])
            sums = _dense_sums(*args, len(nodes), n_bins) if width is None else _sorted_sums(*args, count[nodes], width)
            column[nodes], bin_[nodes], gain[nodes] = best_splits(sums, len(columns), allowed[nodes], min_leaf)
        least = width
    return column, bin_, gain


def grow_subtree(
    bins: np.ndarray, w: np.ndarray, s: np.ndarray, q: np.ndarray, plan: Plan, tree: int, path: int, depth: int, n_bins: int,
    stops: Sequence[int] = (),
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(gain of each of the forest's columns, prediction for each cell, predictions of the tree cut at each depth of ``stops``).

    Grown from weight and label sums of cells; cells of weight 0 are only predicted.
    """
    columns = plan.forests[plan.forest_of(tree)]
    paths, gains, value = np.array([path]), np.zeros(len(columns)), np.zeros(len(w))
    own_bins = np.asfortranarray(bins[:, columns])
    del bins
    some, rest = np.flatnonzero(w > 0), np.flatnonzero(~(w > 0))
    grown = [some, np.zeros(len(some), np.int64), _picked(own_bins, some)]  # cells, their nodes and bins
    predicted = [rest, np.zeros(len(rest), np.int64), _picked(own_bins, rest)]
    w, s, q = w[some], s[some], q[some]
    del own_bins, some, rest
    places = list(range(len(columns)))
    cut: dict[int, np.ndarray] = {}
    left = depth
    while len(grown[0]) + len(predicted[0]):
        m, own = len(paths), grown[1]
        total, label, squares = (np.bincount(own, x, m) for x in (w, s, q))
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(total > 0, label / total, 0.0)
            spread = np.maximum(squares - label * mean, 0.0)
        if depth - left in stops:
            cut[depth - left] = value.copy()
            for cells, node, _ in (grown, predicted):
                cut[depth - left][cells] = mean[node]
        splits = np.zeros(m, bool)
        # No split gains more than the whole spread, and none parts a cell.
        least = LEAST_GAIN * np.maximum(squares, spread)
        count = np.bincount(own, minlength=m)
        asked = np.flatnonzero((spread > 0.5 * least) & (count > 1)) if left > 0 else []
        if len(asked):
            if len(asked) < m:
                number = np.full(m, -1)
                number[asked] = np.arange(len(asked))
                to = number[own]
                use = np.flatnonzero(to >= 0)
                args = (_picked(grown[2], use), w[use], s[use], to[use], count[asked])
            else:
                args = (grown[2], w, s, own, count)
            allowed = allowed_columns(plan, tree, paths[asked])
            column, bin_, gain = _splits_of_level(*args, places, allowed, plan.min_leaf_of(tree), n_bins)
            good = gain > least[asked]
            splits[asked[good]] = True
            column, bin_, gain = column[good], bin_[good], gain[good]
        every = splits.all()
        number = np.cumsum(splits) - 1
        for part in (grown, predicted):
            cells, node, own_bins = part
            if not every:
                goes_on = splits[node]
                ends = ~goes_on
                value[cells[ends]] = mean[node[ends]]
                goes_on = np.flatnonzero(goes_on)
                cells, node, own_bins = cells[goes_on], number[node[goes_on]], _picked(own_bins, goes_on)
                if part is grown:
                    w, s, q = w[goes_on], s[goes_on], q[goes_on]
            if len(cells):
                at = column[node] * len(cells) + np.arange(len(cells))
                node = 2 * node + (own_bins.T.ravel()[at] > bin_[node])
            part[:] = cells, node, own_bins
        if not splits.any():
            break
        np.add.at(gains, column, gain)
        paths = np.repeat(2 * paths[splits], 2)
        paths[1::2] += 1
        left -= 1
    return gains, value, [cut.get(k, value) for k in stops]


# --- preparation --------------------------------------------------------------


def bin_edges(df: DataFrame, features: Sequence[str], max_bins: int) -> list[list[float]]:
    """Upper limits of all bins but the last: between the values of a column of few values, else at quantiles."""
    counts = df.agg(*[F.approx_count_distinct(quoted(c), 0.02).alias(f"n{k}") for k, c in enumerate(features)]).first()
    few = [c for k, c in enumerate(features) if counts[k] <= max_bins]
    out: dict[str, list[float]] = {}
    if few:
        sets = df.agg(*[F.array_sort(F.collect_set(quoted(c).cast("double"))) for c in few]).first()  # a few values each
        out = {c: [(a + b) / 2 for a, b in zip(v[:-1], v[1:], strict=True)] for c, v in zip(few, sets, strict=True) if len(v) <= max_bins}
    many = [c for c in features if c not in out]
    if many:
        steps = [k / max_bins for k in range(1, max_bins)]
        out |= {c: sorted(set(q)) for c, q in zip(many, df.approxQuantile(many, steps, 0.001), strict=True)}
    return [out[c] for c in features]


def binned_table(
    df: DataFrame, features: Sequence[str], target: str, held: Column | None, edges: list[list[float]], number: Column | None = None
) -> DataFrame:
    """(row, y, held, bins), written once: every later step reads these few bytes a row. ``row`` is ``number`` if given."""
    plain = df.select(
        *[quoted(c).cast("double").alias(f"x{k}") for k, c in enumerate(features)],
        quoted(target).cast("double").alias("y"), (F.lit(False) if held is None else held.cast("boolean")).alias("held"),
        (F.lit(0) if number is None else number).cast("long").alias("number"),
    )
    limits = [np.array(e) for e in edges]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grid = np.empty((batch.num_rows, len(limits)), np.uint8)
            for k, limit in enumerate(limits):
                grid[:, k] = np.searchsorted(limit, batch.column(k).to_numpy(zero_copy_only=False))
            data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(limits)), len(grid), [None, pa.py_buffer(grid.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[len(limits) :], data.cast(pa.binary())], names=["y", "held", "number", "bins"]
            )

    made = plain.mapInArrow(work, "y double, held boolean, number long, bins binary")
    row = F.monotonically_increasing_id() if number is None else F.col("number")
    return materialise(made.select(row.alias("row"), "y", "held", "bins"), "binned")


def clustered(rows: DataFrame, n_rows: int) -> DataFrame:
    """The same rows with those of a cell side by side, written once more: blocks then hold few cells."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n_rows // _CLUSTER_ROWS))
    order = ("held", "bins", "row")
    return materialise(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order), "clustered")


def _columns(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    row, y, held = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
    packed = batch.column(3)
    limits = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset :]
    bins = np.frombuffer(packed.buffers()[2], np.uint8)[limits[0] : limits[len(row)]]
    return row, y, held, bins.reshape(len(row), width)


# --- levels of large nodes ------------------------------------------------------


def _by_cell(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, y, held, bins of the cells, first row of each cell) of each block; rows of a cell stand together as stored."""
    for some in _blocks(batches):
        row, y, held, bins = (np.concatenate(x) for x in zip(*[_columns(b, width) for b in some], strict=True))
        fresh = np.ones(len(row), bool)
        fresh[1:] = (bins[1:] != bins[:-1]).any(axis=1) | (held[1:] != held[:-1])
        starts = np.flatnonzero(fresh)
        yield row, y, held[starts], bins[starts], starts


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches with rows, a few at a time, so that a block has about ``_BLOCK_ROWS`` rows."""
    some: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            some.append(batch)
        if sum(b.num_rows for b in some) >= _BLOCK_ROWS:
            yield some
            some = []
    if some:
        yield some


def _count_cells(rows: DataFrame, width: int) -> int:
    """Cells of the clustered table; those that blocks part count in each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, starts in _by_cell(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array([len(starts)], pa.int64())], names=["cells"])

    return rows.mapInArrow(count, "cells long").agg(F.sum("cells")).first()[0] or 0


def _cell_sums(row: np.ndarray, y: np.ndarray, starts: np.ndarray, wanted: np.ndarray, tree: int, plan: Plan) -> np.ndarray:
    """Weight, sum of labels and of their squares in the tree's sample, of the wanted cells (all of these have rows)."""
    counts = np.diff(starts, append=len(row))
    if not wanted.all():
        own = np.repeat(wanted, counts)
        row, y, counts = row[own], y[own], counts[wanted]
    w = weights(row, tree, plan)
    wy, first = w * y, np.cumsum(counts) - counts
    return np.stack([np.add.reduceat(x, first) for x in (w, wy, wy * y)])


def _grow_levels(rows: DataFrame, plan: Plan, tops: dict[int, Top], n_bins: int, width: int, local_rows: int, centre: float) -> dict[tuple[int, int], float]:
    """Splits nodes of more than ``local_rows`` rows, a level at a time; returns gains by (tree, column).

    ``tops`` has the trees that begin with more rows than that.
    """
    gains: dict[tuple[int, int], float] = {}
    open_ = [(t, 0) for t in tops]
    depth = 0
    while open_ and depth < plan.depth:
        widest = max(len(c) for c in plan.forests)
        per_scan = max(1, SCAN_CELLS // (widest * n_bins))
        deeper = []
        for first in range(0, len(open_), per_scan):
            part = open_[first : first + per_scan]
            for r in _scan(rows, plan, tops, part, n_bins, width, centre).collect():  # one row a node
                tree, node = part[r.open]
                if r.gain <= LEAST_GAIN * r.squares:
                    continue
                column = plan.forests[plan.forest_of(tree)][r.column]
                gains[tree, r.column] = gains.get((tree, r.column), 0.0) + r.gain
                children = tops[tree].split(node, column, r.bin, r.mean + centre)
                deeper += [(tree, c) for c, n in zip(children, (r.n_left, r.n_right), strict=True) if n > local_rows]
        open_, depth = deeper, depth + 1
    return gains


def _scan(rows: DataFrame, plan: Plan, tops: dict[int, Top], part: list[tuple[int, int]], n_bins: int, width: int, centre: float) -> DataFrame:
    """(open, column, bin, gain, squares, n_left, n_right, mean): the best split of each listed node, from one scan."""
    spark = rows.sparkSession
    slots: dict[int, dict[int, int]] = {}
    for k, (tree, node) in enumerate(part):
        slots.setdefault(tree, {})[node] = k
    state = spark.sparkContext.broadcast(({t: tops[t] for t in slots}, slots))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, wanted = state.value
        cells = {t: np.zeros((3, len(plan.forests[plan.forest_of(t)]), len(wanted[t]), n_bins)) for t in wanted}
        for row, y, held, bins, starts in _by_cell(batches, width):
            for t, own in wanted.items():
                place = np.full(len(trees[t].column), -1)
                place[list(own)] = np.arange(len(own))
                at = place[trees[t].route(bins)]
                asked = (at >= 0) & ~held
                if not asked.any():
                    continue
                at, sums = at[asked], _cell_sums(row, y - centre, starts, asked, t, plan)
                for k, column in enumerate(plan.forests[plan.forest_of(t)]):
                    key = at * n_bins + bins[asked, column]
                    for j, x in enumerate(sums):
                        cells[t][j, k] += np.bincount(key, x, len(own) * n_bins).reshape(len(own), n_bins)
        for t, own in wanted.items():
            column, node, bin_ = np.nonzero(cells[t][0])
            numbers = np.array(list(own.values()), np.int32)[node]
            arrays = [numbers, column.astype(np.int32), bin_.astype(np.int32), *cells[t][:, column, node, bin_]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["open", "column", "bin", "w", "s", "q"])

    def choose(table: pa.Table) -> pa.Table:
        number, column, bin_, w, s, q = (table.column(k).to_numpy() for k in range(6))
        tree, node = part[int(number[0])]
        columns = len(plan.forests[plan.forest_of(tree)])
        weight, label = np.zeros((columns, 1, n_bins)), np.zeros((columns, 1, n_bins))
        weight[column, 0, bin_], label[column, 0, bin_] = w, s
        allowed = allowed_columns(plan, tree, np.array([tops_path[number[0]]]))
        k, b, gain = (x[0] for x in best_splits(lambda k: (weight[k], label[k]), columns, allowed, plan.min_leaf_of(tree)))
        left = weight[k, 0, : b + 1].sum()
        return pa.table(
            {
                "open": pa.array([number[0]], pa.int32()), "column": pa.array([k], pa.int32()), "bin": pa.array([b], pa.int32()),
                "gain": [float(gain)], "squares": [float(q.sum() / columns)], "n_left": [float(left)], "n_right": [float(weight[k].sum() - left)],
                "mean": [float(label[k].sum() / weight[k].sum())],
            }
        )

    tops_path = [tops[t].path[n] for t, n in part]
    summed = rows.mapInArrow(add_up, "open int, column int, bin int, w double, s double, q double")
    summed = summed.groupBy("open", "column", "bin").agg(*[F.sum(x).alias(x) for x in "wsq"])
    return summed.groupBy("open").applyInArrow(choose, "open int, column int, bin int, gain double, squares double, n_left double, n_right double, mean double")


# --- subtrees -------------------------------------------------------------------


def _packed_rows(rows: DataFrame, units: int, width: int) -> DataFrame:
    """(unit, first, row, y, held, bins): all rows for every unit, packed a block at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _blocks(batches):
            columns = [np.concatenate(x) for x in zip(*[_columns(b, width) for b in some], strict=True)]
            first = int(columns[0][0])
            for unit in range(units):
                packs = [pa.array([x.tobytes()], pa.binary()) for x in columns]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([unit], pa.int32()), pa.array([first], pa.int64()), *packs], names=["unit", "first", "row", "y", "held", "bins"]
                )

    return rows.mapInArrow(work, "unit int, first long, row binary, y binary, held binary, bins binary")


_PACKED_CELLS = "unit int, first long, cells binary, cell_bins binary, row binary, y binary, bins binary"


def _packed_cells(rows: DataFrame, plan: Plan, tops: dict[int, Top], units: list[tuple[int, int, int]], width: int, centre: float) -> DataFrame:
    """Cells of each unit with their sums in its tree's sample, and rows kept from growth, packed a batch at a time."""
    state = rows.sparkSession.sparkContext.broadcast((tops, units))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, wanted = state.value
        unit_of = {t: np.full(len(top.column), -1) for t, top in trees.items()}
        for u, (tree, _, node) in enumerate(wanted):
            unit_of[tree][node] = u
        for row, y, held, bins, starts in _by_cell(batches, width):
            y, counts = y - centre, np.diff(starts, append=len(row))
            held_rows = np.repeat(held, counts)
            out: list[tuple] = []
            for t, own in unit_of.items():
                unit = own[trees[t].route(bins)]
                packs: dict[int, list[bytes]] = {}
                grows = ~held & (unit >= 0)
                if grows.any():
                    sums = _cell_sums(row, y, starts, grows, t, plan)
                    some = np.flatnonzero(sums[0] > 0)
                    order = some[np.argsort(unit[grows][some], kind="stable")]
                    numbers, cell_bins, sums = unit[grows][order], bins[grows][order], sums[:, order]
                    cuts = [*np.flatnonzero(np.diff(numbers, prepend=-1)), len(numbers)]
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                        packs[int(numbers[a])] = [sums[:, a:b].T.tobytes(), cell_bins[a:b].tobytes(), b"", b"", b""]
                if held.any():
                    of_rows, all_bins = np.repeat(unit, counts)[held_rows], np.repeat(bins, counts, axis=0)[held_rows]
                    for u in np.unique(of_rows[of_rows >= 0]).tolist():
                        pick = of_rows == u
                        kept = [x[pick].tobytes() for x in (row[held_rows], y[held_rows], all_bins)]
                        packs[u] = [*packs.get(u, [b"", b""])[:2], *kept]
                out += [(u, int(row[0]), *pack) for u, pack in packs.items()]
            kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
            names = ("unit", "first", "cells", "cell_bins", "row", "y", "bins")
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

    return rows.mapInArrow(work, _PACKED_CELLS)


def _joined(table: pa.Table, kinds: Sequence[tuple[str, type]]) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in kinds]


_KINDS = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64())


def _grown(kind: str, forest: int, tree: int, keys: np.ndarray, y: np.ndarray | None, values: np.ndarray, n: int) -> pa.Table:
    size = len(keys)
    columns = [[kind] * size, np.full(size, forest), np.full(size, tree), keys, [None] * size if y is None else y, values, np.full(size, n)]
    names = ("kind", "forest", "tree", "key", "y", "value", "n")
    return pa.table({c: pa.array(x, t) for c, x, t in zip(names, columns, _KINDS, strict=True)})


def _gains(forest: int, tree: int, gains: np.ndarray) -> pa.Table:
    return _grown("gain", forest, tree, np.flatnonzero(gains > 0), None, gains[gains > 0], 1)


def _dealt(plan: Plan, n_rows: int, n_bins: int, most: int, whole: bool) -> list[tuple[int, int, int]]:
    """Units of trees that stand together, of about equal work; ``whole`` keeps the trees of a forest in one."""
    work = [len(c) * min(n_rows, n_bins ** len(c)) + n_rows // 2 + 1 for c in plan.forests]
    step = plan.trees if whole else 1
    total, units, first, own = sum(work) * plan.trees, [], 0, 0
    for t in range(0, len(plan.forests) * plan.trees, step):
        more = work[plan.forest_of(t)] * step
        if own and (own + more) * most > total:
            units.append((first, t, 0))
            first, own = t, 0
        own += more
    return [*units, (first, len(plan.forests) * plan.trees, 0)] if own else units


def _grow_trees(packed: DataFrame, plan: Plan, units: list[tuple[int, int, int]], n_bins: int, width: int, scores_only: bool) -> DataFrame:
    """Whole trees of each unit from all rows. A draw serves the trees of that number in several forests."""
    state = packed.sparkSession.sparkContext.broadcast(units)

    def grown_beside(some, first, last, own_row, own_y, asked_row, asked_y, held, bins, centre) -> list[pa.Table]:
        """What some forests give; a function of its own, so that their cells are gone before those of the next."""
        out = []
        forests = {}
        for forest in some:
            firsts, cell = (x.astype(np.int32) for x in _cells(bins[:, plan.forests[forest]]))
            asked_cell = cell[held]
            predicted = np.bincount(asked_cell, minlength=len(firsts)) > 0
            forests[forest] = (bins[firsts], cell[~held], asked_cell, predicted, np.zeros(len(firsts) if len(asked_y) else 0))
            del firsts, cell
        for number in range(plan.trees):
            trees = [t for t in (f * plan.trees + number for f in forests) if first <= t < last]
            if not trees:
                continue
            w = weights(own_row, number, plan)
            for t in trees:
                cell_bins, own_cell, _, predicted, total = forests[plan.forest_of(t)]
                sums = [np.bincount(own_cell, x, len(cell_bins)) for x in (w, w * own_y)]
                sums.append(np.bincount(own_cell, w * (own_y * own_y), len(cell_bins)))
                use = np.flatnonzero((sums[0] > 0) | predicted)
                for k, x in enumerate(sums):
                    sums[k] = x[use]
                del x
                # Handed over, not kept: growth drops what it has copied.
                gains, value, _ = grow_subtree(cell_bins[use], sums.pop(0), sums.pop(0), sums.pop(0), plan, t, 1, plan.depth, n_bins)
                out.append(_gains(plan.forest_of(t), t, gains))
                if len(asked_y):
                    total[use] += value
                del sums, use, value
        del cell_bins, own_cell, predicted, total
        if len(asked_y):
            for forest, (_, _, asked_cell, _, total) in forests.items():
                n = min(last, (forest + 1) * plan.trees) - max(first, forest * plan.trees)
                if scores_only:
                    error = ((asked_y - total[asked_cell] / n) ** 2).sum()
                    spread = len(asked_y) * asked_y.var()
                    out.append(_grown("score", forest, -1, np.array([len(asked_y)]), np.array([spread]), np.array([error]), n))
                else:
                    out.append(_grown("held", forest, -1, asked_row, asked_y + centre, total[asked_cell] + n * centre, n))
        return out

    def grow(table: pa.Table) -> pa.Table:
        first, last, _ = state.value[table.column("unit")[0].as_py()]
        blocks = np.argsort(table.column("first").to_numpy())  # they arrive in any order
        kinds = (("row", np.int64), ("y", np.float64), ("held", bool), ("bins", np.uint8))
        row, y, held, bins = (np.frombuffer(b"".join([table.column(c)[k].as_buffer() for k in blocks]), t) for c, t in kinds)
        del table
        bins = bins.reshape(len(row), width)
        if (row[1:] < row[:-1]).any():
            order = np.argsort(row)
            row, y, held, bins = row[order], y[order], held[order], bins[order]
        centre = y[~held].mean() if not held.all() else 0.0
        own_row, own_y, asked_row, asked_y = row[~held], y[~held] - centre, row[held], y[held] - centre
        del row, y
        out = [_grown("gain", 0, 0, np.zeros(0), None, np.zeros(0), 0)]
        every = range(plan.forest_of(first), plan.forest_of(last - 1) + 1)
        beside = 1 if len(bins) > _CLUSTER_ROWS and len(plan.forests[every[-1]]) > 3 else _FORESTS_BESIDE
        for k in range(0, len(every), beside):
            out += grown_beside(every[k : k + beside], first, last, own_row, own_y, asked_row, asked_y, held, bins, centre)
        return pa.concat_tables(out)

    return packed.groupBy("unit").applyInArrow(grow, GROWN)


def _grow_units(packed: DataFrame, plan: Plan, tops: dict[int, Top], units: list[tuple[int, int, int]], n_bins: int, width: int, centre: float) -> DataFrame:
    """The subtree of each unit, a node of one tree, from its cells."""
    state = packed.sparkSession.sparkContext.broadcast((tops, units))

    def grow(table: pa.Table) -> pa.Table:
        trees, wanted = state.value
        tree, _, node = wanted[table.column("unit")[0].as_py()]
        table = table.sort_by("first")  # blocks arrive in any order
        kinds = (("cells", np.float64), ("cell_bins", np.uint8), ("row", np.int64), ("y", np.float64), ("bins", np.uint8))
        cells, cell_bins, row, y, bins = _joined(table, kinds)
        del table
        cells = cells.reshape(-1, 3)
        n, every = len(cells), np.concatenate([cell_bins, bins]).reshape(-1, width)
        firsts, cell = _cells(every[:, plan.forests[plan.forest_of(tree)]])
        w, s, q = (np.bincount(cell[:n], cells[:, k], len(firsts)) for k in range(3))
        mean = s.sum() / w.sum() if n else 0.0
        s, q = s - mean * w, np.maximum(q - 2 * mean * s + mean * mean * w, 0.0)
        path = trees[tree].path[node]
        gains, value, _ = grow_subtree(every[firsts], w, s, q, plan, tree, path, plan.depth - (path.bit_length() - 1), n_bins)
        out = [_gains(plan.forest_of(tree), tree, gains)]
        if len(row):
            out.append(_grown("held", plan.forest_of(tree), -1, row, y + centre, value[cell[n:]] + mean + centre, 1))
        return pa.concat_tables(out)

    return packed.groupBy("unit").applyInArrow(grow, GROWN)


# --- one tree for each fold left out ----------------------------------------------

_FOLD_CELLS = "unit int, first long, cells binary, cell_bins binary, others binary, other_bins binary"
_FOLD_ERRORS = "tree long, stop long, seen boolean, error double"


def _packed_folds(rows: DataFrame, plan: Plan, tops: dict[int, Top], units: list[tuple[int, int]], width: int, centre: float) -> DataFrame:
    """Cells of each unit, by the columns of its tree: sums of the rows it learns from, and of those of the fold left out."""
    state = rows.sparkSession.sparkContext.broadcast((tops, units))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, wanted = state.value
        unit_of = {t: np.full(len(top.column), -1) for t, top in trees.items()}
        for u, (tree, node) in enumerate(wanted):
            unit_of[tree][node] = u
        first = TaskContext.get().partitionId() << 32
        for block, (fold, y, _, bins, starts) in enumerate(_by_cell(batches, width), first):
            y = y - centre
            sums_of: dict[int, tuple[np.ndarray, ...]] = {}
            for t, own in unit_of.items():
                out_of = plan.left_out[plan.forest_of(t)]
                if out_of not in sums_of:
                    learnt = weights(fold, t, plan)
                    sums_of[out_of] = tuple(np.stack([np.add.reduceat(x, starts) for x in (w, w * y, w * y * y)]) for w in (learnt, 1.0 - learnt))
                unit, own_bins = own[trees[t].route(bins)], bins[:, plan.forests[plan.forest_of(t)]]
                packs: dict[int, list[bytes]] = {}
                for k, sums in enumerate(sums_of[out_of]):
                    some = np.flatnonzero((sums[0] > 0) & (unit >= 0))
                    order = some[np.argsort(unit[some], kind="stable")]
                    cuts = [*np.flatnonzero(np.diff(unit[order], prepend=-1)), len(order)]
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                        pack = packs.setdefault(int(unit[order[a]]), [b""] * 4)
                        pack[2 * k : 2 * k + 2] = [sums[:, order[a:b]].T.tobytes(), own_bins[order[a:b]].tobytes()]
                kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
                names = ("unit", "first", "cells", "cell_bins", "others", "other_bins")
                out = [(u, block, *pack) for u, pack in packs.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

    return rows.mapInArrow(work, _FOLD_CELLS)


def _fold_units(
    packed: DataFrame, plan: Plan, tops: dict[int, Top], units: list[tuple[int, int]], n_bins: int, centre: float, stops: Sequence[int]
) -> DataFrame:
    """Squared errors in each unit, of the tree cut at each depth of ``stops``, on rows it learnt from and on others."""
    state = packed.sparkSession.sparkContext.broadcast((tops, units))

    def grow(table: pa.Table) -> pa.Table:
        trees, wanted = state.value
        tree, node = wanted[table.column("unit")[0].as_py()]
        table = table.sort_by("first")  # blocks arrive in any order
        cells, others, cell_bins, other_bins = _joined(
            table, (("cells", np.float64), ("others", np.float64), ("cell_bins", np.uint8), ("other_bins", np.uint8))
        )
        del table
        width = len(plan.forests[plan.forest_of(tree)])
        own = replace(plan, forests=[list(range(width))] * len(plan.forests))
        cells, others = cells.reshape(-1, 3), others.reshape(-1, 3)
        n, every = len(cells), np.concatenate([cell_bins, other_bins]).reshape(-1, width)
        firsts, cell = _cells(every)
        sides = [[np.bincount(at, x[:, k], len(firsts)) for k in range(3)] for at, x in ((cell[:n], cells), (cell[n:], others))]
        mean = sides[0][1].sum() / sides[0][0].sum() if n else 0.0
        sides = [(w, s - mean * w, np.maximum(q - 2 * mean * s + mean * mean * w, 0.0)) for w, s, q in sides]
        path, above = trees[tree].path[node], trees[tree].means_above(node)
        depth = path.bit_length() - 1
        below = [k - depth for k in stops if k >= depth]
        _, _, cut = grow_subtree(every[firsts], *sides[0], own, tree, path, plan.depth - depth, n_bins, below)
        values = [np.full(len(firsts), above[k] - centre - mean) for k in stops if k < depth] + cut
        found = [(tree, k, seen, float((q - 2 * v * s + v * v * w).sum())) for k, v in zip(stops, values, strict=True) for seen, (w, s, q) in zip((True, False), sides, strict=True)]
        return pa.table(dict(zip(("tree", "stop", "seen", "error"), map(list, zip(*found, strict=True)), strict=True)))

    return packed.groupBy("unit").applyInArrow(grow, _FOLD_ERRORS)


def fold_errors(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    fold: str,
    folds: int,
    least_rows: Sequence[int],
    depths: Sequence[int],
    max_bins: int = MAX_BINS,
    local_rows: int = FOLD_ROWS,
) -> dict[tuple[int, int, int, bool], tuple[float, float, int]]:
    """(squared error, squares about the mean, rows) by rows in a leaf, depth, fold left out, and whether these rows were learnt from.

    A tree of a smaller depth is the beginning of the deepest one, so there is one tree for each fold and number of rows in a leaf,
    and all of these are grown together. Bins are those of the rows learnt from.
    """
    spark = df.sparkSession
    ship_package(spark)
    d, stops = len(features), sorted(set(depths))
    edges = [e for f in range(folds) for e in bin_edges(df.where(F.col(fold) != f), features, max_bins)]
    chosen = [list(range(f * d, (f + 1) * d)) for f in range(folds) for _ in least_rows]
    plan = Plan(chosen, 1, stops[-1], 1, [d] * len(chosen), False, 0, [f for f in range(folds) for _ in least_rows], list(least_rows) * folds)
    rows = binned_table(df, list(features) * folds, target, None, edges, F.col(fold))
    n_bins, width = max(2, 1 + max(len(e) for e in edges)), len(edges)
    centre = rows.agg(F.avg("y")).first()[0] or 0.0
    from_centre = F.col("y") - centre
    by_fold = rows.groupBy("row").agg(F.count_if(F.col("y").isNotNull() & ~F.isnan("y")).alias("n"), F.count(F.lit(1)).alias("every"), F.sum(from_centre).alias("s"), F.sum(from_centre * from_centre).alias("q")).collect()
    if any(r.n < r.every for r in by_fold):
        raise DescriaError(f"rows without {target!r}")
    rows = clustered(rows, sum(r.n for r in by_fold))
    tops = {t: Top() for t in range(len(chosen))}
    _grow_levels(rows, plan, tops, n_bins, width, local_rows, centre)
    units = [(t, n) for t, top in tops.items() for n, c in enumerate(top.column) if c < 0]
    packed = _packed_folds(rows, plan, tops, units, width, centre).repartition(len(units), "unit")
    errors = _fold_units(packed, plan, tops, units, n_bins, centre, stops).groupBy("tree", "stop", "seen").agg(F.sum("error").alias("error"))
    out = {}
    for r in errors.collect():  # a few numbers a tree
        own = [(x.n, x.s, x.q) for x in by_fold if (x.row != plan.left_out[r.tree]) == r.seen]
        n, s, q = (sum(x[k] for x in own) for k in range(3))
        least = LEAST_GAIN * q  # below it differences of sums are rounding errors
        if n:
            spread = q - s * s / n
            about = (max(r.error, 0.0), spread if spread > least else 0.0, n)
            out[plan.least_rows[r.tree], r.stop, plan.left_out[r.tree], r.seen] = about
    return out


# --- entry points ---------------------------------------------------------------


def grow_forests(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    forests: Sequence[Sequence[int]] | None = None,
    trees: int = 100,
    max_depth: int = DEEPEST,
    min_leaf: int = 1,
    sample_columns: bool = False,
    bootstrap: bool = True,
    held: Column | None = None,
    seed: int = 42,
    max_bins: int = MAX_BINS,
    local_rows: int = LOCAL_ROWS,
    scores_only: bool = False,
) -> DataFrame:
    """Grown trees as a stored table, see :func:`importances` and :func:`held_scores`.

    ``forests`` lists the columns of each forest (by default one forest over all); with ``sample_columns`` a node tries the
    square root of their number. Rows where ``held`` is true are kept from growth and predicted; with ``scores_only`` their predictions
    may be left out, as :func:`held_scores` needs errors only.
    """
    spark = df.sparkSession
    ship_package(spark)
    chosen = [list(f) for f in forests] if forests is not None else [list(range(len(features)))]
    sampled = [max(1, int(np.ceil(np.sqrt(len(f))))) if sample_columns else len(f) for f in chosen]
    plan = Plan(chosen, trees, max_depth, min_leaf, sampled, bootstrap, seed)
    edges = bin_edges(df, features, max_bins)
    rows = binned_table(df, features, target, held, edges)
    n_bins, width = max(2, 1 + max(len(e) for e in edges)), len(features)
    label = F.when(~F.col("held"), F.coalesce("y", F.lit(float("nan"))))
    n_rows, centre = rows.agg(F.count(F.lit(1)), F.avg(label)).first()
    centre = centre or 0.0
    n_trees = len(chosen) * trees
    early = {}
    slots = spark.sparkContext.defaultParallelism
    if n_rows > (max(local_rows, WHOLE_ROWS) if len(chosen) > _MANY_FORESTS else local_rows):
        rows = clustered(rows, n_rows)
        tops = {t: Top() for t in range(n_trees)}
        if _count_cells(rows, width) > local_rows:
            early = _grow_levels(rows, plan, tops, n_bins, width, local_rows, centre)
        units = [(t, t + 1, n) for t, top in tops.items() for n, c in enumerate(top.column) if c < 0]
        packed = _packed_cells(rows, plan, tops, units, width, centre)
        packed = packed.repartition(min(len(units), 32 * slots), "unit")
        grown = _grow_units(packed, plan, tops, units, n_bins, width, centre)
    else:
        scores_only = scores_only and len(chosen) > _MANY_FORESTS
        units = _dealt(plan, n_rows, n_bins, 4 * slots, scores_only)
        # More parts than units where these are large, so that few parts have two.
        parts = min(len(units) * (4 if n_rows > _CLUSTER_ROWS else 1), 4096)
        packed = _packed_rows(rows, len(units), width).repartition(parts, "unit")
        grown = _grow_trees(packed, plan, units, n_bins, width, scores_only)
    if early:
        listed = [("gain", plan.forest_of(t), t, k, None, g, 1) for (t, k), g in early.items()]
        grown = grown.union(spark.createDataFrame(listed, GROWN))
    return materialise(grown, "forests")


def importances(grown: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Share of each column in the gains of the only forest: by tree first, then over trees; all 0 if nothing was split."""
    gains = grown.where("kind = 'gain'").groupBy("tree", "key").agg(F.sum("value").alias("gain"))
    totals = gains.groupBy("tree").agg(F.sum("gain").alias("total"))
    shares = gains.join(totals, "tree").groupBy("key").agg(F.sum(F.col("gain") / F.col("total")).alias("share")).collect()
    by_place = {r["key"]: r["share"] for r in shares}
    total = sum(by_place.values()) or 1.0
    return {f: by_place.get(k, 0.0) / total for k, f in enumerate(features)}


def held_predictions(grown: DataFrame) -> DataFrame:
    """(forest, row, y, prediction) of the rows kept from growth."""
    own = grown.where("kind = 'held'").groupBy("forest", F.col("key").alias("row"))
    return own.agg(F.first("y").alias("y"), (F.sum("value") / F.sum("n")).alias("prediction"))


def held_scores(grown: DataFrame) -> DataFrame:
    """(forest, r2, mse) over the rows kept from growth."""
    error, spread = F.sum((F.col("y") - F.col("prediction")) ** 2), F.var_pop("y") * F.count("y")
    summed = held_predictions(grown).groupBy("forest").agg(error.alias("error"), spread.alias("spread"), F.count("y").alias("rows"))
    summed = summed.union(grown.where("kind = 'score'").select("forest", "value", "y", "key"))
    return summed.select("forest", (1 - F.col("error") / F.col("spread")).alias("r2"), (F.col("error") / F.col("rows")).alias("mse"))


def subset_scores(
    df: DataFrame, features: Sequence[str], target: str, held: Column, subsets: Sequence[Sequence[int]], **params
) -> DataFrame:
    """(num_features, combo, r2, mse) of one forest for each subset of columns; trees of many subsets grow together."""
    out = None
    for first in range(0, len(subsets), FORESTS_AT_ONCE):
        part = [list(c) for c in subsets[first : first + FORESTS_AT_ONCE]]
        scores = held_scores(grow_forests(df, features, target, part, held=held, scores_only=True, **params))
        listed = df.sparkSession.createDataFrame(list(enumerate(part)), "forest int, combo array<int>")
        own = listed.join(scores, "forest").select(F.size("combo").alias("num_features"), "combo", "r2", "mse")
        out = own if out is None else out.union(own)
    return out if out is not None else df.sparkSession.createDataFrame([], "num_features int, combo array<int>, r2 double, mse double")
