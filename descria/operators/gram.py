"""Pairwise second moments of many columns in one pass.

Every map task folds its Arrow batches into one set of d-by-d sums with matrix
products and emits the upper triangle once; a partial ``sum`` keyed by the pair
merges the tasks. Variance, correlation, target correlation and least squares
are all read off this table, so one scan serves them all, and dropping columns
afterwards is a filter on the table instead of another scan.

Rows never leave the executors. The shuffle is (tasks x pairs) rows: the number
of tasks is limited so that it stays bounded however many input splits there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descria.columns import array_sql, finite_sql, name_at, quoted
from descria.functions.numeric import finite_or_null
from descria.operators.moments import cells
from descria.storage import ship_package

# Columns per block: one task holds a few (2 * STRIP)-squared double matrices.
STRIP = 1024
# Upper bound on the bytes of partial sums all tasks together may emit.
_PARTIAL_BYTES = 256 * 1024**3
_ROW_BYTES = 64
# Relative size below which a variance is rounding noise of a constant column.
CONSTANT_EPS = 1e-12

_SCHEMA = "part int, i int, j int, n double, si double, sj double, sii double, sjj double, sij double"


class _Sums:
    """Masked and unmasked sums of one task and one part."""

    def __init__(self, d: int) -> None:
        self.rows = 0.0
        self.s = np.zeros(d)
        self.q = np.zeros(d)
        self.g = np.zeros((d, d))
        self.masked: list[np.ndarray] | None = None

    def add(self, x: np.ndarray) -> None:
        present = ~np.isnan(x)
        if present.all():
            self.rows += len(x)
            self.s += x.sum(axis=0)
            self.q += np.einsum("ij,ij->j", x, x)
            self.g += x.T @ x
            return
        filled = np.where(present, x, 0.0)
        m = present.astype(np.float64)
        if self.masked is None:
            self.masked = [np.zeros_like(self.g) for _ in range(3)]
        self.g += filled.T @ filled
        self.masked[0] += m.T @ m
        self.masked[1] += filled.T @ m
        self.masked[2] += (filled * filled).T @ m

    def rows_out(self, part: int, ordinals: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        zero = np.zeros(len(i))
        n, s, q = self.masked if self.masked is not None else (None, None, None)

        def pick(a: np.ndarray | None, r: np.ndarray, c: np.ndarray) -> np.ndarray:
            return zero if a is None else a[r, c]

        arrays = [
            np.full(len(i), part, dtype=np.int32),
            ordinals[i].astype(np.int32),
            ordinals[j].astype(np.int32),
            self.rows + pick(n, i, j),
            self.s[i] + pick(s, i, j),
            self.s[j] + pick(s, j, i),
            self.q[i] + pick(q, i, j),
            self.q[j] + pick(q, j, i),
            self.g[i, j],
        ]
        names = ["part", "i", "j", "n", "si", "sj", "sii", "sjj", "sij"]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)


def shift_values(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Mean of the present values per column, over all rows: subtracting it keeps the sums well conditioned."""
    out = np.zeros(len(columns))
    for row in cells(df, columns).groupBy("pos").agg(F.avg("v").alias("v")).collect():
        if row["v"] is not None and np.isfinite(row["v"]):
            out[row["pos"]] = row["v"]
    return out


def task_limit(df: DataFrame, pairs: int) -> int:
    floor = 2 * df.sparkSession.sparkContext.defaultParallelism
    return min(1_000_000, max(floor, _PARTIAL_BYTES // (_ROW_BYTES * max(pairs, 1))))


def _block(
    df: DataFrame, columns: Sequence[str], left: Sequence[int], right: Sequence[int], part: Column, shift: np.ndarray
) -> DataFrame:
    """Sums of the pairs (left, right); ``left`` equals ``right`` on the diagonal."""
    ordinals = np.array(sorted({*left, *right}), dtype=np.int64)
    d = len(ordinals)
    in_left, in_right = np.isin(ordinals, left), np.isin(ordinals, right)
    i, j = np.triu_indices(d)
    wanted = in_left[i] & in_right[j]
    i, j = i[wanted], j[wanted]
    moved = shift[ordinals]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, _Sums] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            parts = batch.column(0).to_numpy(zero_copy_only=False)
            # One packed array per row: a single Arrow column however many features there are.
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d) - moved
            for p in np.unique(parts):
                sums.setdefault(int(p), _Sums(d)).add(x if (parts == p).all() else x[parts == p])
        for p, total in sums.items():
            yield total.rows_out(p, ordinals, i, j)

    packed = df.select(
        part.cast("int").alias("part"), F.expr(array_sql(finite_sql(columns[k]) for k in ordinals.tolist())).alias("x")
    )
    ship_package(df.sparkSession)
    return packed.coalesce(task_limit(df, len(i))).mapInArrow(fold, _SCHEMA)


def gram_table(
    df: DataFrame,
    columns: Sequence[str],
    part: Column | None = None,
    shift: np.ndarray | None = None,
    strip: int = STRIP,
) -> DataFrame:
    """``(part, i, j, n, si, sj, sii, sjj, sij)`` for ordinals ``i <= j``, pairwise complete.

    Sums are of values minus ``shift``. ``part`` splits the rows (folds, train and
    held-out). Beyond ``2 * strip`` columns the pairs are computed in blocks that
    read only their own columns.
    """
    shift = shift_values(df, columns) if shift is None else shift
    blocks = _blocks(df, columns, part, shift, strip)
    partials = blocks[0]
    for block in blocks[1:]:
        partials = partials.unionByName(block)
    return _merged(partials, ("n", "si", "sj", "sii", "sjj", "sij"))


def _blocks(df: DataFrame, columns: Sequence[str], part: Column | None, shift: np.ndarray, strip: int) -> list[DataFrame]:
    """Partial sums of all pairs: one table, or beyond ``2 * strip`` columns one for each pair of strips."""
    which = F.lit(0) if part is None else part
    d = len(columns)
    if d <= 2 * strip:
        return [_block(df, columns, range(d), range(d), which, shift)]
    strips = [range(a, min(a + strip, d)) for a in range(0, d, strip)]
    return [
        _block(df, columns, strips[a], strips[b], which, shift) for a in range(len(strips)) for b in range(a, len(strips))
    ]


def _merged(partials: DataFrame, sums: Sequence[str]) -> DataFrame:
    return partials.groupBy("part", "i", "j").agg(*[F.sum(c).alias(c) for c in sums])


def _spread(s: str, q: str) -> Column:
    """n^2 times the population variance; NULL when it is rounding noise."""
    square = F.col("n") * F.col(q)
    raw = square - F.col(s) * F.col(s)
    return F.when(raw > F.lit(CONSTANT_EPS) * square, raw)


def variances(table: DataFrame) -> DataFrame:
    """``(i, n, variance)`` from the diagonal; population variance, 0 for a constant column."""
    diagonal = table.filter(F.col("i") == F.col("j"))
    var = F.coalesce(_spread("si", "sii"), F.lit(0.0)) / (F.col("n") * F.col("n"))
    return diagonal.select("i", "n", F.when(F.col("n") > 0, var).alias("variance"))


def correlations(table: DataFrame) -> DataFrame:
    """``(i, j, n, r)`` for ``i < j``; r is NULL when either side is constant."""
    cov = F.col("n") * F.col("sij") - F.col("si") * F.col("sj")
    r = cov / (F.sqrt(_spread("si", "sii")) * F.sqrt(_spread("sj", "sjj")))
    clipped = F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    return table.filter(F.col("i") < F.col("j")).select("i", "j", "n", clipped.alias("r"))


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(f1, f2, r)`` of every column pair in table order, pairwise complete."""
    pairs = correlations(gram_table(df, columns))
    return pairs.select(name_at(F.col("i"), columns).alias("f1"), name_at(F.col("j"), columns).alias("f2"), "r")


def corr_with_target(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """``(feature, abs_r)``: absolute correlation with the target, 0 when undefined.

    Needs only the d target pairs, so it stays in SQL aggregates over long cells
    instead of paying for the whole matrix.
    """


    y = finite_or_null(quoted(target))
    long = cells(df, columns, y.alias("y")).filter(F.col("v").isNotNull() & F.col("y").isNotNull())
    stats = long.groupBy("pos").agg(
        F.covar_pop("v", "y").alias("c"), F.stddev_pop("v").alias("sv"), F.stddev_pop("y").alias("sy")
    )
    r = F.try_divide(F.abs(F.col("c")), F.col("sv") * F.col("sy"))
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "pos int, feature string")
    return names.join(stats, "pos", "left").select("feature", F.coalesce(r, F.lit(0.0)).alias("abs_r"))


@dataclass(frozen=True)
class Moments:
    """Sums of complete rows on the driver: ``n``, column sums and cross products of shifted values."""

    n: float
    s: np.ndarray
    g: np.ndarray
    shift: np.ndarray

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.s - other.s, self.g - other.g, self.shift)

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.s + other.s, self.g + other.g, self.shift)


def collect_moments(
    df: DataFrame, columns: Sequence[str], part: Column | None = None, strip: int = STRIP
) -> dict[int, Moments]:
    """Complete-row moments per part: d*d numbers each, for any number of columns.

    The driver reads the pairs of one block of columns at a time. The input must be
    imputed; a missing cell would give pairs of unequal counts and is reported.
    """
    d = len(columns)
    shift = shift_values(df, columns)
    rows: dict[int, float] = {}
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for partials in _blocks(df, columns, part, shift, strip):
        for p, block in _merged(partials, ("n", "si", "sij")).toPandas().groupby("part"):
            n = rows.setdefault(int(p), float(block["n"].iloc[0]))
            if (block["n"] != n).any():
                raise ValueError("missing cells present: impute before collecting moments")
            s, g = sums.setdefault(int(p), (np.zeros(d), np.zeros((d, d))))
            i, j = block["i"].to_numpy(), block["j"].to_numpy()
            g[i, j] = block["sij"]
            g[j, i] = block["sij"]
            on = i == j
            s[i[on]] = block["si"].to_numpy()[on]
    return {p: Moments(rows[p], *sums[p], shift) for p in sums}
