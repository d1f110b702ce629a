"""Seeded train / held-out splits and folds of exact size without moving rows.

Every row gets the hash ``md5(seed:key)``. A split takes the rows whose hash is
among the k smallest, so membership is the predicate ``hash <= cutoff``. The
cutoffs are exact order statistics, found from a histogram of hash prefixes and
the few rows in the prefix group that holds the rank. Only the key column is
read for that; the wide rows are never sorted or shuffled.

Keys must be unique: rows with equal keys fall on the same side.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from descria.columns import quoted, require_columns
from descria.errors import DescriaError

# Longest hash prefix, and the counters (prefixes x classes) beyond which it gets shorter.
_PREFIX = 4
_COUNTERS = 1 << 22


def row_hash(key: str, seed: int) -> Column:
    """Hash that orders rows pseudo-randomly but reproducibly."""
    return F.md5(F.concat(F.lit(f"{seed}:"), quoted(key).cast("string")))


def _keyed(df: DataFrame, key: str, seed: int, label: str | None) -> DataFrame:
    hashed = df.select(_group_expr(label).alias("g"), row_hash(key, seed).alias("h"))
    classes = 1
    if label is not None:
        sizes = hashed.groupBy("g").count()
        classes, rows = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("count"), F.lit(0))).first()
        if 2 * classes > rows:
            raise DescriaError(f"{rows} rows in {classes} classes of {label!r}: some class has a single row")
    prefix = _PREFIX
    while prefix > 1 and classes * 16**prefix > _COUNTERS:
        prefix -= 1
    return hashed.withColumn("p", F.substring("h", 1, prefix))


def _histogram(keyed: DataFrame) -> dict[str, list[tuple[str, int]]]:
    """Rows per hash prefix and group: about ``_COUNTERS`` counters, whatever the number of groups."""
    out: dict[str, list[tuple[str, int]]] = {}
    for row in keyed.groupBy("g", "p").count().orderBy("g", "p").collect():
        out.setdefault(row["g"], []).append((row["p"], row["count"]))
    return out


def _cutoffs(
    keyed: DataFrame, histogram: Mapping[str, list[tuple[str, int]]], ranks: Mapping[str, Sequence[int]]
) -> dict[str, list[str]]:
    """Hash of the given one-based ranks per group (rank 0 gives the empty string).

    Rows with equal keys on both sides of a rank can't be told apart: an error, as sizes would not be exact.
    """
    wanted: dict[tuple[str, str], list[tuple[int, int]]] = {}
    out = {g: [""] * len(r) for g, r in ranks.items()}
    for g, targets in ranks.items():
        for slot, rank in enumerate(targets):
            seen = 0
            for prefix, count in histogram.get(g, []):
                if 0 < rank <= seen + count:
                    wanted.setdefault((g, prefix), []).append((slot, rank - seen))
                    break
                seen += count
    if not wanted:
        return out
    probes = [(g, p, slot, r) for (g, p), hits in wanted.items() for slot, r in hits]
    probe = keyed.sparkSession.createDataFrame(probes, "g string, p string, slot int, r int")
    near = keyed.join(F.broadcast(probe.select("g", "p").distinct()), ["g", "p"], "left_semi")
    order = Window.partitionBy("g", "p").orderBy("h")
    ranked = near.select("*", F.row_number().over(order).alias("r"), F.lead("h").over(order).alias("next"))
    for row in ranked.join(F.broadcast(probe), ["g", "p", "r"]).select("g", "slot", "h", "next").collect():
        if row["h"] == row["next"]:
            raise DescriaError("rows with equal keys lie on both sides of a boundary: splits need a unique key")
        out[row["g"]][row["slot"]] = row["h"]
    return out


def proportional_sizes(counts: Mapping[str, int], total: int) -> dict[str, int]:
    """Split ``total`` over groups in proportion; leftovers go to the largest remainders."""
    n = sum(counts.values())
    if n == 0:
        return {g: 0 for g in counts}
    sizes = {g: counts[g] * total // n for g in counts}
    order = sorted(counts, key=lambda g: (-(counts[g] * total % n), g))
    for g in order[: total - sum(sizes.values())]:
        sizes[g] += 1
    return sizes


def _group_expr(label: str | None) -> Column:
    return F.lit("") if label is None else F.coalesce(quoted(label).cast("string"), F.lit(""))


def mark_held_out(
    df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, label: str | None = None, name: str = "is_test"
) -> DataFrame:
    """Add a boolean column that is true on exactly ``ceil(test_size * n)`` rows.

    With ``label`` every class is represented in proportion.
    """
    require_columns(df, [key] if label is None else [key, label])
    keyed = _keyed(df, key, seed, label)
    histogram = _histogram(keyed)
    counts = {g: sum(c for _, c in rows) for g, rows in histogram.items()}
    sizes = proportional_sizes(counts, held_out_size(counts, test_size))
    cut = _cutoffs(keyed, histogram, {g: [k] for g, k in sizes.items()})
    group, h = _group_expr(label), row_hash(key, seed)
    return df.withColumn(name, F.coalesce(h <= F.get(_limits(cut, group), F.lit(0)), F.lit(False)))


def _fold_ranks(n: int, k: int, skip: int = 0) -> list[int]:
    """Last rank of each of the first ``k - 1`` folds of ``n`` rows that follow ``skip`` others."""
    return [skip + (f + 1) * (n // k) + min(f + 1, n % k) for f in range(k - 1)]


def _limits(cut: Mapping[str, Sequence[str]], group: Column) -> Column:
    """Cutoffs of the row's group, as an array."""
    if not cut:
        return F.array().cast("array<string>")
    pairs = [x for g, own in cut.items() for x in (F.lit(g), F.array(*[F.lit(v) for v in own]))]
    return F.create_map(*pairs)[group]


def _numbered(h: Column, limits: Column, count: int, first: int) -> Column:
    """Number of the interval ``h`` falls in; the intervals end at the ``count`` ascending limits."""
    return sum(((h > F.get(limits, F.lit(f))).cast("int") for f in range(count)), F.lit(first))


def mark_split_and_folds(
    df: DataFrame, key: str, test_size: float = 0.2, k: int = 5, seed: int = 42, label: str | None = None
) -> DataFrame:
    """Add ``fold``: -1 on held-out rows, ``0 .. k-1`` on training rows.

    Same sizes as :func:`mark_held_out` followed by :func:`mark_folds` on the rest,
    from one set of order statistics: the key column is read twice instead of four
    times.
    """
    require_columns(df, [key] if label is None else [key, label])
    keyed = _keyed(df, key, seed, label)
    histogram = _histogram(keyed)
    counts = {g: sum(c for _, c in rows) for g, rows in histogram.items()}
    held = proportional_sizes(counts, held_out_size(counts, test_size))
    cut = _cutoffs(
        keyed, histogram, {g: [held[g], *_fold_ranks(counts[g] - held[g], k, held[g])] for g in counts}
    )
    group, h = _group_expr(label), row_hash(key, seed)
    return df.withColumn("fold", _numbered(h, _limits(cut, group), k, -1))


def held_out_size(counts: Mapping[str, int], test_size: float) -> int:
    return math.ceil(test_size * sum(counts.values()) - 1e-9)


def split_random(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, held-out) tables."""
    return _parts(df, mark_held_out(df, key, test_size, seed))


def split_stratified(
    df: DataFrame, key: str, label: str, test_size: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, held-out) tables with the class shares of the whole table."""
    return _parts(df, mark_held_out(df, key, test_size, seed, label))


def _parts(df: DataFrame, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return marked.filter(~F.col("is_test")).drop("is_test"), marked.filter("is_test").drop("is_test")


def mark_folds(
    df: DataFrame, key: str, k: int = 5, seed: int = 42, label: str | None = None, name: str = "fold"
) -> DataFrame:
    """Add a fold number ``0 .. k-1``; fold sizes differ by at most one (per class with ``label``)."""
    require_columns(df, [key] if label is None else [key, label])
    if k < 2:
        raise DescriaError("at least two folds are needed")
    keyed = _keyed(df, key, seed, label)
    histogram = _histogram(keyed)
    counts = {g: sum(c for _, c in rows) for g, rows in histogram.items()}
    cut = _cutoffs(keyed, histogram, {g: _fold_ranks(n, k) for g, n in counts.items()})
    group, h = _group_expr(label), row_hash(key, seed)
    return df.withColumn(name, _numbered(h, _limits(cut, group), k - 1, 0))
