"""Small models fitted on a bounded, documented sample of labelled rows."""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descria.llm.common import map_arrow, narrow


def known_labels(labels: DataFrame, label: str, usable: Column | None = None) -> DataFrame:
    """(doc_id, label); rows without id or label are skipped, an id labelled twice takes the smaller label."""
    known = narrow(labels, "doc_id", label).withColumnRenamed(label, "label").where("doc_id is not null and label in (0, 1)")
    if usable is not None:
        known = known.where(usable)
    return known.groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))


def label_counts(known: DataFrame) -> tuple[int, int]:
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    return counts.get(0, 0), counts.get(1, 0)


def labelled_sample(docs: DataFrame, known: DataFrame, per_class: int) -> DataFrame:
    """At most ``per_class`` documents of each label, as (doc_id, text, label).

    Which ones is decided by a hash of doc_id, so every size of input behaves alike; of repeated documents one is used.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(11))
    picked = known.where("label = 0").orderBy(order, "doc_id").limit(per_class)
    picked = picked.union(known.where("label = 1").orderBy(order, "doc_id").limit(per_class))
    # At most 2 * per_class rows of 12 bytes: the bound is the parameter.
    found = narrow(docs, "doc_id", "text").join(F.broadcast(picked), "doc_id")
    return found.dropDuplicates(["doc_id"])


def fit_in_one_task(sample: DataFrame, fit: Callable[[list[str], np.ndarray], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Runs ``fit(texts, labels)`` over a bounded sample inside one task and returns its arrays.

    Rows are put in order of doc_id first, so the result doesn't depend on how the sample was dealt out. Without
    documents of both labels there is nothing to learn and the result is empty; all scores are then 0.5.
    """

    def work(batches):
        rows = []
        for batch in batches:
            rows += zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
        rows.sort(key=lambda r: r[0])
        texts, labels = [r[1] or "" for r in rows], [r[2] for r in rows]
        out = io.BytesIO()
        if len(set(labels)) == 2:
            np.savez(out, **fit(texts, np.array(labels)))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["model"])

    rows = map_arrow(sample.select("doc_id", "text", "label").repartition(1), work, "model binary").collect()
    blobs = [bytes(r[0]) for r in rows if r[0]]
    return dict(np.load(io.BytesIO(blobs[0]))) if blobs else {}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def fit_sparse_logistic(
    row: np.ndarray, slot: np.ndarray, value: np.ndarray, target: np.ndarray, weight: np.ndarray, width: int,
    l2: float = 1e-6, rounds: int = 60, rate: float = 0.5,
) -> tuple[np.ndarray, float]:
    """Logistic regression on (row, slot, value) triples, ``target`` in 0..1; full gradients with Adam steps."""
    n, row, value = len(target), row.astype(np.int64), value.astype(np.float64)
    used, slot = np.unique(slot, return_inverse=True)
    full, width = width, len(used)
    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    weight = weight / weight.sum()
    for t in range(1, rounds + 1):
        score = np.bincount(row, w[slot] * value, n) + b
        error = (sigmoid(score) - target) * weight
        g = np.append(np.bincount(slot, error[row] * value, width) + l2 * w, error.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        w, b = w - step[:-1], b - step[-1]
    out = np.zeros(full)
    out[used] = w
    return out, float(b)


def fit_platt(score: np.ndarray, label: np.ndarray, counts: tuple[int, int], rounds: int = 100) -> tuple[float, float]:
    """Slope and intercept that turn scores into probabilities (Newton steps, smoothed targets, light ridge).

    ``counts``: labelled rows of label 0 and 1 altogether; they weigh the sample, which may hold other shares.
    """
    n1, n0 = (label == 1).sum(), (label == 0).sum()
    share = np.where(label == 1, counts[1] / max(n1, 1), counts[0] / max(n0, 1)) * len(label) / max(sum(counts), 1)
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(float(np.std(score)), 1e-9)
    x = np.column_stack([score / scale, np.ones(len(score))])
    beta = np.zeros(2)
    for _ in range(rounds):
        p = sigmoid(x @ beta)
        gradient = x.T @ (share * (p - target)) + 1e-3 * beta
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        beta = beta - step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])
