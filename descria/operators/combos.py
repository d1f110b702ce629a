"""Exhaustive search over small feature subsets.

Subsets are rows of a distributed table. Least squares is scored from two moment
matrices (train and held-out) taken in one scan, so its cost does not depend on
the number of rows. Logistic models are fitted all together: each Newton round is
one scan that returns gradients and Hessians of every unfinished subset.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from itertools import batched, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from descria.columns import quoted
from descria.errors import NotConvergedError, SearchTooLargeError
from descria.functions.numeric import finite_or_null
from descria.operators import forest, gram
from descria.operators.normal import ols_from_moments, score_from_moments
from descria.storage import materialise, ship_package

# Subsets fitted together in one Newton batch: bounds the state sent to each task.
NEWTON_BATCH = 20_000
_ROWS_AT_ONCE = 512


def combo_count(d: int, max_features: int) -> int:
    return sum(math.comb(d, k) for k in range(1, min(max_features, d) + 1))


def check_size(d: int, max_features: int, max_combos: int | None) -> None:
    total = combo_count(d, max_features)
    if max_combos is not None and total > max_combos:
        raise SearchTooLargeError(f"{total} subsets of {d} features exceed max_combos={max_combos}")


def combo_enumerate(spark: SparkSession, d: int, max_features: int = 5, max_combos: int | None = None) -> DataFrame:
    """``(num_features, combo)`` for all index subsets of size 1 to ``max_features``.

    Grown level by level with ``explode`` of the larger indices, so the table is
    produced by the executors and never listed on the driver. There is no limit
    unless ``max_combos`` states one; a search above it is refused rather than cut short.
    """
    check_size(d, max_features, max_combos)
    level = spark.range(d).select(F.array(F.col("id").cast("int")).alias("combo"))
    levels = [level]
    for _ in range(2, min(max_features, d) + 1):
        last = F.element_at("combo", -1)
        grown = level.filter(last < d - 1).select("combo", F.explode(F.sequence(last + 1, F.lit(d - 1))).alias("x"))
        level = grown.select(F.concat("combo", F.array("x")).alias("combo"))
        levels.append(level)
    table = levels[0]
    for extra in levels[1:]:
        table = table.unionByName(extra)
    return table.select(F.size("combo").alias("num_features"), "combo")


def _spread_out(combos: DataFrame, total: int) -> DataFrame:
    """Subsets in enough partitions to use the cluster, about a thousand or more each."""
    slots = combos.sparkSession.sparkContext.defaultParallelism
    return combos.repartition(max(1, min(4 * slots, total // 1000 + 1)))


def combo_eval_lr(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    held_out: Column,
    max_features: int = 5,
    max_combos: int | None = None,
) -> DataFrame:
    """``(num_features, combo, r2, mse)`` of least squares per subset.

    R2 does not depend on the scaling of the columns; ``mse`` is in units of the
    target scaled to [0, 1] over all rows. Subsets of constant columns only, or an
    empty side of the split, give no row. The input must be imputed.
    """
    spark = df.sparkSession
    d = len(features)
    parts = gram.collect_moments(df, [*features, target], held_out.cast("int"))
    combos = combo_enumerate(spark, d, max_features, max_combos)
    schema = "num_features int, combo array<int>, r2 double, mse double"
    if 0 not in parts or 1 not in parts:
        return spark.createDataFrame([], schema)
    train, held = parts[0], parts[1]
    both = train + held
    variance = np.diag(both.g) / both.n - (both.s / both.n) ** 2
    moving = variance > gram.CONSTANT_EPS * np.diag(both.g) / both.n
    bounds = df.agg(F.min(quoted(target)).alias("a"), F.max(quoted(target)).alias("b")).first()
    width = float(bounds["b"] - bounds["a"]) or 1.0
    # d*d numbers: independent of the number of rows.
    ship_package(spark)
    state = spark.sparkContext.broadcast((train, held, moving, width))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fit, test, alive, scale = state.value
        for batch in batches:
            rows = []
            for size, combo in zip(batch["num_features"], batch["combo"], strict=True):
                idx = np.asarray(combo, dtype=np.int64)
                if not alive[idx].any():
                    continue
                beta, b0 = ols_from_moments(fit, idx, d)
                r2, mse = score_from_moments(test, idx, d, beta, b0)
                rows.append((size, list(combo), r2, mse / scale**2))
            yield pd.DataFrame(rows, columns=["num_features", "combo", "r2", "mse"])

    return _spread_out(combos, combo_count(d, max_features)).mapInPandas(solve, schema)


def combo_eval_rf(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    held_out: Column,
    combos: Iterable[Sequence[int]],
    n_estimators: int = 50,
    max_depth: int = 10,
    seed: int = 101,
) -> DataFrame:
    """``(num_features, combo, r2, mse)`` of a forest per listed subset; the trees of all subsets are grown together."""
    return forest.subset_scores(
        df, features, target, held_out, [list(c) for c in combos], trees=n_estimators, max_depth=max_depth, seed=seed
    )


# --- logistic subsets -------------------------------------------------------


def _design(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    return (x - mean) / std


def _chunks(size: int, per: int) -> Iterator[slice]:
    for a in range(0, size, per):
        yield slice(a, min(a + per, size))


def _newton_terms(z: np.ndarray, y: np.ndarray, idx: np.ndarray, beta: np.ndarray):
    """Loss, gradient and Hessian of every subset of one size on one batch of rows."""
    c, k = idx.shape
    loss, grad, hess = np.zeros(c), np.zeros((c, k + 1)), np.zeros((c, k + 1, k + 1))
    per = max(1, 2_000_000 // (_ROWS_AT_ONCE * (k + 1)))
    for rows in _chunks(len(z), _ROWS_AT_ONCE):
        zr, yr = z[rows], y[rows]
        for part in _chunks(c, per):
            x = np.concatenate(
                [np.ones((len(zr), idx[part].shape[0], 1)), zr[:, idx[part]]], axis=2
            ).transpose(1, 0, 2)
            eta = np.einsum("crk,ck->cr", x, beta[part])
            p = 0.5 * (1.0 + np.tanh(0.5 * eta))
            loss[part] += (np.logaddexp(0.0, eta) - yr * eta).sum(axis=1)
            grad[part] += np.einsum("crk,cr->ck", x, p - yr)
            hess[part] += np.matmul((x * (p * (1.0 - p))[:, :, None]).transpose(0, 2, 1), x)
    return loss, grad, hess


def _arrays(batch, d: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(d)]).astype(np.float64)
    return x, batch.column(d).to_numpy(zero_copy_only=False).astype(np.float64)


def _newton_round(train: DataFrame, mean, std, idx: np.ndarray, beta: np.ndarray):
    """Sum of the Newton terms over all rows, one scan."""
    d, (c, k) = len(mean), idx.shape
    state = train.sparkSession.sparkContext.broadcast((mean, std, idx, beta))

    def fold(batches):
        m, s, combos, b = state.value
        total = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, y = _arrays(batch, d)
            terms = _newton_terms(_design(x, m, s), y, combos, b)
            total = terms if total is None else tuple(t + u for t, u in zip(total, terms, strict=True))
        if total is not None:
            flat = np.concatenate([total[0][:, None], total[1], total[2].reshape(c, -1)], axis=1)
            # One row per (subset, slot): summed by Spark, never held by one task.
            slot = np.tile(np.arange(flat.shape[1], dtype=np.int32), c)
            which = np.repeat(np.arange(c, dtype=np.int32), flat.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(which), pa.array(slot), pa.array(flat.ravel())], names=["c", "slot", "v"]
            )

    width = 1 + (k + 1) + (k + 1) ** 2
    partials = train.coalesce(gram.task_limit(train, c * width)).mapInArrow(fold, "c int, slot int, v double")
    pdf = partials.groupBy("c", "slot").agg(F.sum("v").alias("v")).toPandas()
    flat = np.zeros((c, width))
    flat[pdf["c"].to_numpy(), pdf["slot"].to_numpy()] = pdf["v"].to_numpy()
    state.unpersist()
    return flat[:, 0], flat[:, 1 : k + 2], flat[:, k + 2 :].reshape(c, k + 1, k + 1)


def fit_logistic_subsets(
    train: DataFrame, mean: np.ndarray, std: np.ndarray, idx: np.ndarray, c_inverse: float = 1.0,
    max_rounds: int = 50, tol: float = 1e-8,
) -> np.ndarray:
    """L2 logistic coefficients (intercept first, standardised columns) of all subsets of one size.

    ``train`` holds the feature columns in order, then the 0/1 target. A step that
    raises the penalised loss is halved and tried again.
    """
    c, k = idx.shape
    ridge = np.diag([0.0] + [1.0 / c_inverse] * k)
    beta = np.zeros((c, k + 1))
    base, best = np.zeros_like(beta), np.full(c, np.inf)
    step = np.zeros_like(beta)
    live = np.arange(c)
    for _ in range(max_rounds):
        trial = beta[live]
        loss, grad, hess = _newton_round(train, mean, std, idx[live], trial)
        loss = loss + 0.5 * np.einsum("ck,kj,cj->c", trial, ridge, trial)
        grad = grad + trial @ ridge
        worse = loss > best[live] + 1e-9 * np.abs(best[live])
        step[live[worse]] *= 0.5
        good = ~worse
        base[live[good]], best[live[good]] = trial[good], loss[good]
        ridged = hess[good] + ridge + 1e-12 * np.eye(k + 1)
        step[live[good]] = -np.linalg.solve(ridged, grad[good][:, :, None])[:, :, 0]
        beta[live] = base[live] + step[live]
        live = live[np.abs(step[live]).max(axis=1) > tol]
        if len(live) == 0:
            return beta
    raise NotConvergedError(f"{len(live)} of {c} logistic fits did not converge in {max_rounds} rounds")


def combo_eval_logit(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    held_out: Column,
    max_features: int = 5,
    max_combos: int | None = None,
    c_inverse: float = 1.0,
) -> DataFrame:
    """``(num_features, combo, accuracy)`` of an L2 logistic model per subset.

    Columns are standardised by the training rows. Fits of one subset size run in
    batches; each Newton round of a batch is one scan of the training rows.
    """
    spark = df.sparkSession
    d = len(features)
    data = df.select(
        *[finite_or_null(quoted(c)).alias(f"x{k}") for k, c in enumerate(features)],
        quoted(target).cast("double").alias("y"),
        held_out.cast("boolean").alias("held"),
    )
    # Read once per Newton round: store the narrow table instead of repeating its plan.
    data = materialise(data, "subsets")
    ship_package(spark)
    train, held = data.filter(~F.col("held")).drop("held"), data.filter("held").drop("held")
    stats = gram.collect_moments(train, [f"x{k}" for k in range(d)])[0]
    centre = stats.s / stats.n
    mean = centre + stats.shift
    std = np.sqrt(np.maximum(np.diag(stats.g) / stats.n - centre**2, 0.0))
    std[std == 0.0] = 1.0
    check_size(d, max_features, max_combos)
    out: list[DataFrame] = []
    for size in range(1, min(max_features, d) + 1):
        for part in batched(combinations(range(d), size), NEWTON_BATCH):
            idx = np.array(part, dtype=np.int64)
            beta = fit_logistic_subsets(train, mean, std, idx, c_inverse)
            state = spark.sparkContext.broadcast((mean, std, idx, beta))

            def count(batches, state=state, size=size):
                m, s, sub, b = state.value
                right, n = np.zeros(len(sub)), 0
                for batch in batches:
                    if batch.num_rows == 0:
                        continue
                    x, y = _arrays(batch, d)
                    z = _design(x, m, s)
                    for rows in _chunks(len(z), _ROWS_AT_ONCE):
                        eta = np.einsum("rck,ck->rc", z[rows][:, sub], b[:, 1:]) + b[:, 0]
                        right += ((eta > 0) == (y[rows][:, None] == 1)).sum(axis=0)
                    n += len(y)
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(sub), size, dtype=np.int32)),
                            pa.array([r.tolist() for r in sub.astype(np.int32)], pa.list_(pa.int32())),
                            pa.array(right),
                            pa.array(np.full(len(sub), n, dtype=np.int64)),
                        ],
                        names=["num_features", "combo", "hits", "n"],
                    )

            out.append(held.mapInArrow(count, "num_features int, combo array<int>, hits double, n bigint"))
    hits = out[0]
    for extra in out[1:]:
        hits = hits.unionByName(extra)
    return hits.groupBy("num_features", "combo").agg((F.sum("hits") / F.sum("n")).alias("accuracy"))


# --- ranking ----------------------------------------------------------------


def best_per_size(scored: DataFrame, score: str) -> DataFrame:
    """Best row per subset size; the lexicographically first subset wins ties."""
    best = F.max_by(F.struct(*[F.col(c) for c in scored.columns]), F.struct(F.col(score), _earliest())).alias("b")
    return scored.groupBy("num_features").agg(best).select("b.*").orderBy("num_features")


def _earliest() -> Column:
    """Orders subsets so that the lexicographically smallest is the largest key."""
    return F.transform("combo", lambda x: -x)


def combo_topn(scored: DataFrame, score: str, top_n: int = 3) -> DataFrame:
    """The ``top_n`` best subsets with their rank; smaller and earlier subsets win ties."""
    top = scored.orderBy(F.col(score).desc(), "num_features", "combo").limit(top_n)
    # top_n rows only: the window orders a table of that size.
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), "num_features", "combo")))


def named(scored: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add the feature names of each subset."""
    names = F.array(*[F.lit(f) for f in features])
    return scored.withColumn("features", F.transform("combo", lambda k: F.element_at(names, k + 1)))


def combo_project(
    df: DataFrame, features: Sequence[str], combo: Sequence[int], target: str, protected: Sequence[str] = ()
) -> DataFrame:
    """Table reduced to one subset: ``SMILES`` (and other protected columns) first, target last."""
    ids = [c for c in df.columns if c == "SMILES" or c in set(protected)]
    return df.select(*[quoted(c) for c in [*ids, *[features[k] for k in combo], target]])
