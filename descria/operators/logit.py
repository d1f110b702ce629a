"""Many logistic models fitted together: all penalties and all folds of a search, one scan for each Newton round.

A model leaves one fold out (or none) and has an L1 or L2 penalty. In each round every task adds up, for all unfinished
models, loss, gradient and Hessian over its rows; Spark sums them by (model, place). The driver then holds (d + 1)^2
numbers for each model, whatever the number of rows, and takes a damped Newton step: a linear solve for L2, coordinate descent on
the quadratic model with soft thresholds for L1 (proximal Newton), where columns whose gradient stays below the penalty
drop out of the sweeps.

Objective: C * sum(log-loss) + |w|_1 or |w|^2 / 2, the intercept free. With ``scaled`` w belongs to columns
standardised by the model's own training rows (population deviation), otherwise to raw columns; steps are always taken in
standardised columns. Constant columns get coefficient 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descria.columns import quoted
from descria.errors import NotConvergedError
from descria.operators import gram
from descria.storage import materialise, ship_package

#: Fold of rows that every model learns from.
NO_FOLD = -1
#: Numbers that one scan sums up for each task; more models take several scans a round.
SCAN_NUMBERS = 8_000_000
_ROWS_AT_ONCE = 4_096


@dataclass(frozen=True)
class Spec:
    """One model: inverse strength, penalty ("l1" or "l2"), and the fold it doesn't learn from."""

    c: float
    penalty: str = "l2"
    left_out: int = NO_FOLD


@dataclass(frozen=True)
class Fitted:
    """Coefficients of raw columns and the intercept; ``size`` is |w| in the columns the penalty acts on."""

    coefficients: np.ndarray
    intercept: float
    size: np.ndarray

    def margin(self, features: Sequence[str]) -> Column:
        """Log-odds of a row as a Spark expression."""
        total = F.lit(float(self.intercept))
        for name, b in zip(features, self.coefficients.tolist(), strict=True):
            if b != 0.0:
                total = total + quoted(name).cast("double") * F.lit(b)
        return total


def training_rows(df: DataFrame, features: Sequence[str], target: str, fold: str | None) -> DataFrame:
    """(x0, x1, ..., y, fold), written once; read by every round."""
    own = F.lit(NO_FOLD) if fold is None else quoted(fold).cast("int")
    columns = [quoted(c).cast("double").alias(f"x{k}") for k, c in enumerate(features)]
    return materialise(df.select(*columns, quoted(target).cast("double").alias("y"), own.alias("fold")), "logistic")


def _sums(rows: DataFrame, d: int, groups: list[tuple[int, np.ndarray, np.ndarray]], which: np.ndarray, beta: np.ndarray):
    """Loss, gradient and Hessian of each model at its ``beta``; ``which``: the group (fold left out) of each model."""
    m, width = len(beta), 1 + (d + 1) + (d + 1) ** 2
    state = rows.sparkSession.sparkContext.broadcast((groups, which, beta))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_groups, own_which, b = state.value
        total = np.zeros((len(b), width))
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS_AT_ONCE):
                part = batch.slice(first, _ROWS_AT_ONCE)
                x = np.column_stack([part.column(k).to_numpy(zero_copy_only=False) for k in range(d)])
                y, fold = (part.column(d + k).to_numpy(zero_copy_only=False) for k in (0, 1))
                for g, (left_out, mean, std) in enumerate(own_groups):
                    models = np.flatnonzero(own_which == g)
                    use = (fold != left_out) | (left_out == NO_FOLD)
                    if not len(models) or not use.any():
                        continue
                    z = np.column_stack([np.ones(use.sum()), (x[use] - mean) / std])
                    eta = z @ b[models].T
                    p = 0.5 * (1.0 + np.tanh(0.5 * eta))
                    total[models, 0] += (np.logaddexp(0.0, eta) - y[use][:, None] * eta).sum(axis=0)
                    total[models, 1 : d + 2] += (p - y[use][:, None]).T @ z
                    for k, model in enumerate(models):
                        total[model, d + 2 :] += ((z * (p[:, k] * (1.0 - p[:, k]))[:, None]).T @ z).ravel()
        model, place = np.divmod(np.arange(total.size), width)
        yield pa.RecordBatch.from_arrays([pa.array(model.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total.ravel())], names=["m", "place", "v"])

    partials = rows.coalesce(gram.task_limit(rows, m * width)).mapInArrow(add_up, "m int, place int, v double")
    got = partials.groupBy("m", "place").agg(F.sum("v").alias("v")).toPandas()
    flat = np.zeros((m, width))
    flat[got["m"].to_numpy(), got["place"].to_numpy()] = got["v"].to_numpy()
    state.unpersist()
    return flat[:, 0], flat[:, 1 : d + 2], flat[:, d + 2 :].reshape(m, d + 1, d + 1)


def proximal_step(w: np.ndarray, grad: np.ndarray, hess: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Minimiser of the quadratic model plus ``weight`` * |w|; place 0 is the free intercept."""
    diagonal = np.diag(hess)
    new, slope = w.copy(), grad.copy()  # slope: gradient of the quadratic model at ``new``
    active = np.ones(len(w), bool)
    for sweep in range(10_000):
        moved = 0.0
        for j in np.flatnonzero(active):
            if diagonal[j] <= 0.0:
                continue
            goal = new[j] - slope[j] / diagonal[j]
            value = np.sign(goal) * max(abs(goal) - weight[j] / diagonal[j], 0.0)
            if value != new[j]:
                slope += hess[:, j] * (value - new[j])
                moved, new[j] = max(moved, abs(value - new[j])), value
        quiet = moved <= 1e-12 * (1.0 + np.abs(new).max())
        if quiet and active.all():
            return new
        # Zero columns whose slope can't overcome the penalty rest until the others have settled, then all are checked.
        active = np.ones(len(w), bool) if quiet else (new != 0.0) | (np.abs(slope) > weight)
        active[0] = True
    raise NotConvergedError("coordinate descent did not converge in 10000 sweeps")


def fit_together(
    rows: DataFrame, d: int, specs: Sequence[Spec], scaled: bool = True, max_iter: int = 100, tol: float = 1e-8
) -> list[Fitted]:
    """Fits all models on ``training_rows``; labels are 0 or 1 and both occur in every training set."""
    ship_package(rows.sparkSession)
    parts = gram.collect_moments(rows, [f"x{k}" for k in range(d)], F.col("fold") - NO_FOLD)
    everything = None
    for own in parts.values():
        everything = own if everything is None else everything + own
    left_out = sorted({s.left_out for s in specs})
    groups = []
    for fold in left_out:
        m = everything if fold == NO_FOLD else everything - parts[fold - NO_FOLD]
        centre = m.s / m.n
        std = np.sqrt(np.maximum(np.diag(m.g) / m.n - centre**2, 0.0))
        std[std <= np.sqrt(gram.CONSTANT_EPS) * np.sqrt(np.diag(m.g) / m.n)] = np.inf
        groups.append((fold, centre + m.shift, std))
    which = np.array([left_out.index(s.left_out) for s in specs])
    deviation = np.array([groups[g][2] for g in which])
    # The penalty's weight on each standardised coefficient, for a loss that isn't multiplied by C.
    per = np.where(np.isfinite(deviation), 1.0 if scaled else 1.0 / deviation, 0.0)
    c = np.array([s.c for s in specs])[:, None]
    lasso = np.array([s.penalty == "l1" for s in specs])
    weight = np.concatenate([np.zeros((len(specs), 1)), np.where(lasso[:, None], per / c, 0.0)], axis=1)
    ridge = np.concatenate([np.zeros((len(specs), 1)), np.where(lasso[:, None], 0.0, per**2 / c)], axis=1)
    base, best = np.zeros((len(specs), d + 1)), np.full(len(specs), np.inf)
    step, live = np.zeros_like(base), np.arange(len(specs))
    at_once = max(1, SCAN_NUMBERS // (d + 2) ** 2)
    for _ in range(max_iter):
        trial = base[live] + step[live]
        scans = [slice(a, a + at_once) for a in range(0, len(live), at_once)]
        loss, grad, hess = (np.concatenate(x) for x in zip(*[_sums(rows, d, groups, which[live[s]], trial[s]) for s in scans], strict=True))
        loss = loss + (weight[live] * np.abs(trial)).sum(1) + 0.5 * (ridge[live] * trial**2).sum(1)
        worse = loss > best[live] + 1e-10 * np.abs(best[live])
        for k, model in enumerate(live):
            if worse[k]:
                step[model] *= 0.5
                continue
            base[model], best[model] = trial[k], loss[k]
            slope, curve = grad[k] + ridge[model] * trial[k], hess[k] + np.diag(ridge[model])
            if lasso[model]:
                step[model] = proximal_step(trial[k], slope, curve, weight[model]) - trial[k]
            else:
                step[model] = -np.linalg.solve(curve + np.diag(np.where(np.diag(curve) > 0, 0.0, 1.0)), slope)
        live = live[np.abs(step[live]).max(axis=1) > tol]
        if not len(live):
            break
    else:
        raise NotConvergedError(f"{len(live)} of {len(specs)} logistic fits did not converge in {max_iter} rounds")
    final = base + step
    out = []
    for model, g in enumerate(which):
        _, mean, std = groups[g]
        raw = np.where(np.isfinite(std), final[model, 1:] / std, 0.0)
        out.append(Fitted(raw, float(final[model, 0] - raw @ mean), np.abs(final[model, 1:] if scaled else raw)))
    return out
