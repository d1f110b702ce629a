"""Quality rules: hashed n-gram logistic regression behind fixed count rules.

Features are word unigrams, word bigrams and byte 4-grams, each hashed into its own range of slots and averaged over
the text, so a score is a sum of three means and a text of any length costs one pass over its bytes. Weights come
from a bounded sample of labelled rows; a disjoint quarter of that sample calibrates scores to probabilities.
Documents are scored in Arrow batches where they lie: no shuffle, no state between rows.

Defined results: a null or empty text has no words and fails the base rules; other nulls and extra columns are
ignored or passed through; repeated rows are judged each; empty tables give empty tables; without labels of both kinds
quality is 0.5.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from descria.llm.common import filter_arrow, map_arrow, narrow, position, sums_between, text_chunks
from descria.llm.training import (
    fit_in_one_task,
    fit_platt,
    fit_sparse_logistic,
    known_labels,
    label_counts,
    labelled_sample,
    sigmoid,
)
from descria.llm.words import Words, count_per_text, is_blank, prefix_hash, span_hash, split_words, word_grams

#: Labelled rows a model is fitted on, for each label.
SAMPLE_PER_CLASS = 1200
SLOT_BITS = 17
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
#: A document stays if its calibrated probability of good quality is at least this.
MIN_QUALITY = 0.2

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEW_LINE = 10
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, quality double"
)


def _equal_to_earlier(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: is there an earlier one, and any other one, of the same group and key."""
    order = np.lexsort((key, group))
    same = (group[order][1:] == group[order][:-1]) & (key[order][1:] == key[order][:-1])
    later, any_other = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    any_other[order[1:]] = same
    any_other[order[:-1]] |= same
    return later, any_other


def base_counts(raw: np.ndarray, offsets: np.ndarray, words: Words, running: np.ndarray) -> dict[str, np.ndarray]:
    texts = len(offsets) - 1
    blank = is_blank(raw)
    out = {
        "n_words": np.diff(words.first),
        "word_chars": count_per_text(~blank & ((raw & 0xC0) != 0x80), offsets),
        "n_symbols": count_per_text(_SYMBOL[raw], offsets),
    }
    breaks = np.flatnonzero(raw == _NEW_LINE)
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_text = np.searchsorted(offsets, line_starts, "right") - 1
    # A break that ends its text opens an empty line there, which holds no word; drop it with all other empty ones.
    line_ends = np.append(line_starts[1:], len(raw))
    at_break = np.zeros(len(raw) + 1, bool)
    at_break[breaks + 1] = True
    line_ends = line_ends - at_break[line_ends]
    with_word = np.searchsorted(words.starts, line_ends) > np.searchsorted(words.starts, line_starts)
    line_starts, line_ends, line_text = line_starts[with_word], line_ends[with_word], line_text[with_word]
    later, _ = _equal_to_earlier(line_text, span_hash(running, line_starts, line_ends))
    out["n_dup_lines"] = np.bincount(line_text[later], minlength=texts)

    grams, ends = word_grams(words, REPEAT_WINDOW)
    gram_text = np.repeat(np.arange(texts), np.diff(ends))
    _, twice = _equal_to_earlier(gram_text, grams)
    # Windows of a text are numbered from its first word on.
    first_word = words.first[:-1][gram_text] + np.arange(len(grams)) - ends[:-1][gram_text]
    cover = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(cover, first_word[twice], 1)
    np.add.at(cover, first_word[twice] + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = count_per_text(np.cumsum(cover)[:-1] > 0, words.first)
    return out


def _slots(raw: np.ndarray, offsets: np.ndarray, words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(slot of each n-gram, ends by text) for each family of n-grams."""
    shift = np.uint64(64 - SLOT_BITS)
    pairs, pair_ends = word_grams(words, 2)
    families = [((words.hashes >> shift).astype(np.int64), words.first), ((pairs >> shift).astype(np.int64), pair_ends)]
    n = len(raw)
    if n >= 4:
        wide = raw.astype(np.uint32)
        code = wide[:-3] | (wide[1:-2] << np.uint32(8)) | (wide[2:-1] << np.uint32(16)) | (wide[3:] << np.uint32(24))
        slot = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)).astype(np.int64)
        fits = np.ones(n - 3, bool)
        for back in (1, 2, 3):
            over = offsets[1:-1] - back
            fits[over[(over >= 0) & (over < n - 3)]] = False
        slot = slot[fits]
    else:
        slot = np.zeros(0, np.int64)
    families.append((slot, np.concatenate([[0], np.cumsum(np.maximum(np.diff(offsets) - 3, 0))])))
    width = 1 << SLOT_BITS
    return [(slot + k * width, ends) for k, (slot, ends) in enumerate(families)]


def _raw_score(weights: np.ndarray, families) -> np.ndarray:
    return sum(sums_between(weights[slot], ends) / np.maximum(np.diff(ends), 1) for slot, ends in families)


def _fit(texts: list[str], labels: np.ndarray, counts: tuple[int, int]) -> dict[str, np.ndarray]:
    width = 3 << SLOT_BITS
    rows, slots, values = [], [], []
    for i, text in enumerate(texts):
        raw = np.frombuffer(text.encode(), np.uint8)
        offsets = np.array([0, len(raw)])
        for slot, _ in _slots(raw, offsets, split_words(raw, offsets)):
            if len(slot):
                found, count = np.unique(slot, return_counts=True)
                rows.append(np.full(len(found), i, np.int32))
                slots.append(found.astype(np.int32))
                values.append((count / len(slot)).astype(np.float32))
    row, slot, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, slots, values))
    part = np.arange(len(texts)) % 4
    learn = part != 0
    if len(set(labels[learn])) < 2 or len(set(labels[~learn])) < 2:
        learn = np.ones(len(texts), bool)
    weight = learn / np.where(labels == 1, max((labels[learn] == 1).sum(), 1), max((labels[learn] == 0).sum(), 1))
    w, _ = fit_sparse_logistic(row, slot, value, labels.astype(float), weight, width)
    score = np.bincount(row, w[slot] * value, len(texts))
    rest = ~learn if not learn.all() else learn
    return {"weights": w.astype(np.float32), "platt": np.array(fit_platt(score[rest], labels[rest], counts))}


def fit_quality_model(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> dict[str, np.ndarray]:
    """Weights and calibration from at most ``per_class`` labelled documents of each label."""
    known = known_labels(labels, "quality")
    return fit_in_one_task(labelled_sample(docs, known, per_class), partial(_fit, counts=label_counts(known)))


def _judge(model: dict[str, np.ndarray], raw: np.ndarray, offsets: np.ndarray, least: float) -> dict[str, np.ndarray]:
    running = prefix_hash(raw)
    words = split_words(raw, offsets, running)
    out = base_counts(raw, offsets, words, running)
    if model:
        slope, intercept = model["platt"]
        out["quality"] = sigmoid(slope * _raw_score(model["weights"], _slots(raw, offsets, words)).astype(float) + intercept)
    else:
        out["quality"] = np.full(len(offsets) - 1, 0.5)
    n = out["n_words"]
    out["base_failed"] = (n < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
    out["kept"] = ~out["base_failed"] & (out["quality"] >= least)
    return out


def judge_quality(docs: DataFrame, model: dict[str, np.ndarray], least: float = MIN_QUALITY) -> DataFrame:
    """One row per document with its counts, calibrated quality and verdict."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 3 * 2**17 weights, whatever the data

    def work(batches):
        for batch, raw, offsets in text_chunks(batches, 1):
            got = _judge(shared.value, raw, offsets, least)
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
            arrays = [batch.column(0), *(pa.array(got[c], pa.int64()) for c in names)]
            arrays += [pa.array(got["base_failed"]), pa.array(got["kept"]), pa.array(got["quality"], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *names, "base_failed", "kept", "quality"])

    rows = narrow(docs, "doc_id", "text")
    return map_arrow(rows.select(rows.doc_id.cast("long").alias("doc_id"), "text"), work, SCHEMA)


def keep_quality(docs: DataFrame, model: dict[str, np.ndarray], least: float = MIN_QUALITY) -> DataFrame:
    """The documents that pass, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at = position(docs, "text")

    def work(batches):
        for batch, raw, offsets in text_chunks(batches, text_at):
            yield batch.filter(pa.array(_judge(shared.value, raw, offsets, least)["kept"]))

    return filter_arrow(docs, work)
