"""Toxicity by weak supervision.

Voters are lexicons (fixed ones of words, and some of words and word starts learnt from labelled rows) and patterns over
a text's plain words. A generative
label model is fitted to their votes without labels: per class it has each voter's rate of firing (its accuracy), and
the covariance of the votes around those rates (their correlations), so voters that repeat each other count less. Its
posterior probabilities train a linear classifier over the votes and hashed words, whose score is calibrated on
labelled rows. All fitting uses a bounded sample of rows outside the held-out fold; all documents are scored.

Defined results: a null or empty text fires no voter; null ids are carried; repeated rows are scored each; extra columns are
ignored; empty tables give empty tables; without labels of both kinds the score is 0.5.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descria.llm.common import held_out, map_arrow, narrow, sums_between, text_chunks
from descria.llm.training import (
    fit_in_one_task,
    fit_platt,
    fit_sparse_logistic,
    known_labels,
    label_counts,
    labelled_sample,
    sigmoid,
)
from descria.llm.words import Words, hash_words, plain_words, prefix_hash, span_hash, split_words

#: Labelled rows a model is fitted on, for each label.
SAMPLE_PER_CLASS = 1500
#: Documents with crc32(doc_id) mod FOLDS = HELD_FOLD are never learnt from.
FOLDS, HELD_FOLD = 3, 1
THRESHOLD = 0.7
SLOT_BITS = 16
#: Learnt lexicons hold whole words and word starts of so many bytes, which also know inflected and compound forms.
STARTS = (4, 5, 6)
LEARNT_TERMS = 400
LEARNT_GROUPS = 4
LEAST_SUPPORT = 3
LEAST_LOG_ODDS = 3.0

# Common insults in English, by kind, and words of address; none is a common word of another language.
LEXICONS = (
    ("idiot", "moron", "stupid", "dumb", "imbecile", "fool", "dumbass"),
    ("loser", "pathetic", "worthless", "useless", "failure", "nobody"),
    ("scum", "trash", "garbage", "filth", "vermin", "pig"),
    ("disgusting", "vile", "ugly", "revolting", "repulsive"),
    ("clown", "joke", "freak", "creep", "weirdo"),
    ("bastard", "bitch", "asshole", "jerk", "shit", "fuck", "crap", "damn"),
    ("hate", "despise", "loathe"),
)
ADDRESS = ("you", "your", "u", "ur", "he", "she", "they")


def plain_terms(column: pa.Array) -> tuple[Words, np.ndarray]:
    """Words of lower-cased texts without punctuation; per word a row of its hash and those of its starts."""
    raw, offsets = plain_words(column)
    running = prefix_hash(raw)
    words = split_words(raw, offsets, running)
    starts = [span_hash(running, words.starts, np.minimum(words.starts + n, words.ends)) for n in STARTS]
    return words, np.column_stack([words.hashes, *starts])


def _is_in(own: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(own):
        return np.zeros(hashes.shape, bool)
    return own[np.minimum(np.searchsorted(own, hashes), len(own) - 1)] == hashes


def votes(words: Words, terms: np.ndarray, groups: list[np.ndarray], address: np.ndarray) -> np.ndarray:
    """1 where a voter fires. Lexicon voters first (fixed, then learnt), then patterns over their hits."""
    first, n = words.first, np.maximum(np.diff(words.first), 1)
    fixed, learnt = groups[: len(LEXICONS)], groups[len(LEXICONS) :]
    hits = [_is_in(own, words.hashes) for own in fixed] + [_is_in(own, terms).any(axis=1) for own in learnt]
    counts = np.column_stack([sums_between(h.astype(np.int64), first) for h in hits])
    hit = np.logical_or.reduce(hits)
    total = sums_between(hit.astype(np.int64), first)
    near = np.zeros(len(hit) + 3, bool)
    for back in (1, 2, 3):  # a word of address at most three words before
        near[back : len(hit) + back] |= _is_in(address, words.hashes)
    addressed = sums_between((hit & near[: len(hit)]).astype(np.int64), first)
    patterns = [total >= 2, (counts > 0).sum(axis=1) >= 2, total >= 4, 1000 * total >= 5 * n, addressed > 0]
    return np.column_stack([counts > 0, *patterns]).astype(float)


def fit_label_model(x: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior of the hidden label for rows of votes, by expectation maximisation.

    The first rounds treat voters as independent given the label; then the covariance within classes joins in. The start
    is whether any lexicon fires.
    """
    post = np.where(x[:, : len(LEXICONS) + LEARNT_GROUPS].any(axis=1), 0.9, 0.1)
    rate = [None, None]
    for _ in range(rounds):
        prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        rate = [((w[:, None] * x).sum(axis=0) + 0.5) / (w.sum() + 1) for w in (1 - post, post)]
        logit = np.log(prior / (1 - prior)) + x @ np.log(rate[1] / rate[0]) + (1 - x) @ np.log((1 - rate[1]) / (1 - rate[0]))
        post = sigmoid(logit)
    spread = sum((w[:, None] * (x - r)).T @ (x - r) for w, r in zip((1 - post, post), rate, strict=True)) / len(x)
    spread += 0.02 * np.eye(x.shape[1])
    weight = np.linalg.solve(spread, rate[1] - rate[0])
    prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
    return sigmoid((x - (rate[0] + rate[1]) / 2) @ weight + np.log(prior / (1 - prior)))


def _slots(terms: np.ndarray) -> np.ndarray:
    return (terms.reshape(-1) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _learnt_groups(words: Words, terms: np.ndarray, labels: np.ndarray, use: np.ndarray) -> list[np.ndarray]:
    """Terms that speak for label 1, dealt to a few voters by rank."""
    text = np.repeat(words.text_of, terms.shape[1])
    flat = terms.reshape(-1)
    flat, text = flat[use[text]], text[use[text]]
    order = np.lexsort((text, flat))
    flat, text = flat[order], text[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (text[1:] != text[:-1])
    found, place = np.unique(flat[new], return_inverse=True)
    toxic = labels[text[new]] == 1
    n1, n0 = np.bincount(place[toxic], minlength=len(found)), np.bincount(place[~toxic], minlength=len(found))
    odds = np.log((n1 + 0.5) / ((labels[use] == 1).sum() + 1)) - np.log((n0 + 0.5) / ((labels[use] == 0).sum() + 1))
    usable = np.flatnonzero((odds > LEAST_LOG_ODDS) & (n1 >= LEAST_SUPPORT))
    best = usable[np.argsort(-odds[usable], kind="stable")][:LEARNT_TERMS]
    return [np.sort(found[best[k::LEARNT_GROUPS]]) for k in range(LEARNT_GROUPS)]


def _features(words: Words, terms: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    cuts = model["cuts"]
    groups = [model["groups"][a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return votes(words, terms, groups, model["address"])


def _fit(texts: list[str], labels: np.ndarray, counts: tuple[int, int]) -> dict[str, np.ndarray]:
    words, terms = plain_terms(pa.array(texts, pa.string()))
    learn = np.arange(len(texts)) % 3 != 0
    if len(set(labels[learn])) < 2 or len(set(labels[~learn])) < 2:
        learn = np.ones(len(texts), bool)
    groups = [np.sort(hash_words(list(g))) for g in LEXICONS] + _learnt_groups(words, terms, labels, learn)
    cuts = np.concatenate([[0], np.cumsum([len(g) for g in groups])])
    model = {"groups": np.concatenate(groups), "cuts": cuts, "address": np.sort(hash_words(list(ADDRESS)))}
    x = _features(words, terms, model)
    post = fit_label_model(x)
    text = np.repeat(words.text_of, terms.shape[1])
    code, count = np.unique(text * (1 << SLOT_BITS) + _slots(terms), return_counts=True)
    row, slot = code >> SLOT_BITS, code & ((1 << SLOT_BITS) - 1)
    value = count / np.maximum(np.diff(words.first), 1)[row]
    own = np.nonzero(x)
    row, slot = np.concatenate([row, own[0]]), np.concatenate([slot, own[1] + (1 << SLOT_BITS)])
    value = np.concatenate([value, x[own]])
    w, _ = fit_sparse_logistic(row, slot, value, post, learn.astype(float), (1 << SLOT_BITS) + x.shape[1], l2=1e-4, rate=0.1)
    score = np.bincount(row, w[slot] * value, len(texts))
    rest = ~learn if not learn.all() else learn
    return model | {"weights": w, "platt": np.array(fit_platt(score[rest], labels[rest], counts))}


def fit_toxicity_model(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> dict[str, np.ndarray]:
    known = known_labels(labels, "toxic", ~held_out(F.col("doc_id"), FOLDS, HELD_FOLD))
    return fit_in_one_task(labelled_sample(docs, known, per_class), partial(_fit, counts=label_counts(known)))


def score_toxicity(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, held_out, score, predicted) per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # lexicons and 2**16 weights

    def work(batches):
        own = shared.value
        for batch, _, _ in text_chunks(batches, 1):
            if not own:
                score = np.full(batch.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])
                continue
            words, terms = plain_terms(batch.column(1))
            fired = _features(words, terms, own) @ own["weights"][1 << SLOT_BITS :]
            mean = sums_between(own["weights"][_slots(terms)], words.first * terms.shape[1]) / np.maximum(np.diff(words.first), 1)
            score = sigmoid(own["platt"][0] * (fired + mean) + own["platt"][1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    rows = narrow(docs, "doc_id", "text")
    scored = map_arrow(rows.select(rows.doc_id.cast("long").alias("doc_id"), "text"), work, "doc_id long, score double")
    flag = held_out(F.col("doc_id"), FOLDS, HELD_FOLD).alias("held_out")
    return scored.select("doc_id", flag, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
