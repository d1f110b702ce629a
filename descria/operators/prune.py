"""Dropping weak and redundant columns.

Decisions are made on statistics (one row per column or column pair) and the
result is a plain ``select`` on the input, so column pruning reaches the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descria.columns import ident, name_at, remaining_columns, require_columns
from descria.errors import EmptySelectionError, NotConvergedError
from descria.operators import gram, moments
from descria.storage import materialise

MODES = ("target_based", "upper", "lower")
# Target correlations that agree to this many digits count as equal.
TIE_DIGITS = 9

Importance = Callable[[Sequence[str]], Mapping[str, float]]


@dataclass(frozen=True)
class Pruned:
    """Reduced table with the kept and removed columns (table order) and notes for the report."""

    table: DataFrame
    kept: list[str]
    removed: list[str]
    notes: list[str] = field(default_factory=list)


def passing_variance(stats: DataFrame, threshold: float) -> DataFrame:
    return stats.filter(F.col("variance") > F.lit(threshold))


def low_variance(df: DataFrame, features: Sequence[str], threshold: float = 0.05) -> Pruned:
    """Keep features whose population variance is strictly above the threshold.

    Missing cells are ignored. No feature left is an error.
    """
    require_columns(df, features)
    rows = passing_variance(moments.column_profile(df, features), threshold).select("feature").collect()
    passed = {r["feature"] for r in rows}
    kept = [c for c in features if c in passed]
    if not kept:
        raise EmptySelectionError(f"no feature has variance above {threshold}")
    removed = remaining_columns(features, kept)
    return Pruned(df.drop(*removed), kept, removed)


def edges(pairs: DataFrame, threshold: float) -> DataFrame:
    """Column pairs with absolute correlation strictly above the threshold."""
    return pairs.filter(F.abs(F.col("r")) > F.lit(threshold))


def _with_target(pairs: DataFrame, target: DataFrame, scores: Mapping[int, float]) -> DataFrame:
    """Attach target correlation and importance of both sides to each edge."""
    spark = pairs.sparkSession
    t = target.select("i", F.round("t", TIE_DIGITS).alias("t"))
    imp = spark.createDataFrame([(int(k), float(v)) for k, v in scores.items()], "i int, m double")
    side = t.join(imp, "i", "left").withColumn("m", F.coalesce("m", F.lit(0.0)))
    left = side.select("i", F.col("t").alias("ti"), F.col("m").alias("mi"))
    right = side.select(F.col("i").alias("j"), F.col("t").alias("tj"), F.col("m").alias("mj"))
    return pairs.join(left, "i").join(right, "j")


def weaker_side(tie_removes_first: bool) -> Column:
    """Ordinal to remove of one edge.

    The side with lower target correlation goes. On a tie, ``tie_removes_first``
    (classification) removes j only when i is more important, else i; otherwise
    (regression) the less important side goes, and j when both are equal.
    """
    i, j = F.col("i"), F.col("j")
    first_wins = F.col("mi") > F.col("mj")
    tie = F.when(first_wins, j).otherwise(i) if tie_removes_first else F.when(F.col("mj") > F.col("mi"), i).otherwise(j)
    return F.when(F.col("ti") > F.col("tj"), j).when(F.col("ti") < F.col("tj"), i).otherwise(tie)


def greedy_removals(scored: DataFrame) -> set[int]:
    """Row-major greedy pass: an edge with an already removed side is skipped.

    Order dependent, hence a fold over the edge list; that list is at most d*d/2
    statistics and never rows.
    """
    ordered = scored.select("i", "j", weaker_side(False).alias("w")).orderBy("i", "j")
    gone: set[int] = set()
    for row in ordered.toLocalIterator():
        if row["i"] not in gone and row["j"] not in gone:
            gone.add(row["w"])
    return gone


def redundant_ordinals(
    table: DataFrame,
    alive: Sequence[int],
    target: int,
    threshold: float,
    mode: str,
    task: str,
    importance: Callable[[list[int]], Mapping[int, float]] | None = None,
) -> set[int]:
    """Ordinals to remove, given the pair table of features plus target."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; choose from {MODES}")
    pairs = gram.correlations(table)
    allowed = [int(a) for a in alive]
    strong = edges(pairs.filter(F.col("i").isin(allowed) & F.col("j").isin(allowed)), threshold)
    if mode == "upper" or (mode == "lower" and task == "classification"):
        return {r["w"] for r in strong.select(F.col("j").alias("w")).distinct().collect()}
    if mode == "lower":
        return {r["w"] for r in strong.select(F.col("i").alias("w")).distinct().collect()}

    with_target = pairs.filter((F.col("i") == target) | (F.col("j") == target)).select(
        F.when(F.col("i") == target, F.col("j")).otherwise(F.col("i")).alias("i"),
        F.coalesce(F.abs("r"), F.lit(0.0)).alias("t"),
    )
    scored = _with_target(strong, with_target, {})
    ties = scored.filter(F.col("ti") == F.col("tj"))
    if importance is not None and not ties.isEmpty():
        scored = _with_target(strong, with_target, importance(allowed))
    if task == "classification":
        return {r["w"] for r in scored.select(weaker_side(True).alias("w")).distinct().collect()}
    return greedy_removals(scored)


def high_correlation(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    threshold: float = 0.95,
    mode: str = "target_based",
    task: str = "classification",
    importance: Importance | None = None,
    centres: Mapping[str, float] | None = None,
) -> Pruned:
    """Remove one side of every feature pair with absolute correlation above the threshold.

    ``importance`` is only evaluated when some pair ties on target correlation; it
    maps feature names to scores. ``centres`` may give a typical value per feature
    when one is known, which saves the look at the first rows.
    """
    return _prune(df, features, target, None, threshold, mode, task, importance, centres)


def optimize_columns(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    variance_threshold: float = 0.05,
    correlation_threshold: float = 0.95,
    mode: str = "target_based",
    task: str = "classification",
    importance: Importance | None = None,
    centres: Mapping[str, float] | None = None,
) -> Pruned:
    """Variance filter, then correlation filter on what is left, from a single scan."""
    return _prune(
        df, features, target, variance_threshold, correlation_threshold, mode, task, importance, centres
    )


def _prune(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    variance_threshold: float | None,
    threshold: float,
    mode: str,
    task: str,
    importance: Importance | None,
    centres: Mapping[str, float] | None,
) -> Pruned:
    require_columns(df, [*features, target])
    names = [*features, target]
    notes: list[str] = []
    # The pair table is small but read several times below: written once, it cannot be
    # lost with an executor and the rows are scanned only once.
    shift = None
    if centres is not None:
        shift = np.array([*[centres[f] for f in features], *gram.shift_values(df, [target])])
    table = materialise(gram.gram_table(df, names, shift=shift), "pairs")
    alive = list(range(len(features)))
    if variance_threshold is not None:
        passed = passing_variance(gram.variances(table), variance_threshold).select("i").collect()
        ok = {r["i"] for r in passed}
        alive = [k for k in alive if k in ok]
        if not alive:
            raise EmptySelectionError(f"no feature has variance above {variance_threshold}")

    def scores(ordinals: list[int]) -> dict[int, float]:
        try:
            got = importance([names[k] for k in ordinals]) if importance else {}
        except NotConvergedError as error:  # such a fit counts as no importance, as documented; other failures are raised
            notes.append(f"importance fit failed: {error}")
            got = {}
        return {k: float(got.get(names[k], 0.0)) for k in ordinals}

    gone: set[int] = set()
    if len(alive) > 1:
        gone = redundant_ordinals(table, alive, len(features), threshold, mode, task, scores)
    kept = [names[k] for k in alive if k not in gone]
    removed = remaining_columns(features, kept)
    return Pruned(df.drop(*removed), kept, removed, notes)


def regression_order(df: DataFrame, target: str = "value") -> DataFrame:
    """``SMILES`` first, target last, everything else in table order."""
    front = [c for c in df.columns if c == "SMILES"]
    middle = [c for c in df.columns if c not in ("SMILES", target)]
    return df.selectExpr(*[ident(c) for c in [*front, *middle, target]])


def edge_report(df: DataFrame, columns: Sequence[str], threshold: float) -> DataFrame:
    """``(f1, f2, r)`` of the pairs above the threshold, earlier column first."""
    strong = edges(gram.correlations(gram.gram_table(df, columns)), threshold)
    return strong.select(name_at(F.col("i"), columns).alias("f1"), name_at(F.col("j"), columns).alias("f2"), "r")
