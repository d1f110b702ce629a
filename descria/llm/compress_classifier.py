"""Quality classifier by compression: which of two zstandard dictionaries shortens a text more.

One dictionary is built from good and one from bad labelled text. A text is cut into blocks of fixed size (all of
it, so that long texts don't outgrow the dictionary), each block is compressed with both, and the difference of the
summed sizes over the plain size is calibrated to a probability on a disjoint part of the sample.

Defined results: a null or empty text scores like a difference of 0; nulls elsewhere and extra columns are ignored
or passed through; repeated rows are scored each; empty tables give empty tables; without labels of both
kinds the score is 0.5.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descria.llm.common import filter_arrow, held_out, map_arrow, narrow, position
from descria.llm.training import fit_in_one_task, fit_platt, known_labels, label_counts, labelled_sample, sigmoid

#: Labelled rows a model is fitted on, for each label.
SAMPLE_PER_CLASS = 1500
#: Documents with crc32(doc_id) mod FOLDS = HELD_FOLD are never learnt from.
FOLDS, HELD_FOLD = 5, 0
DICTIONARY_BYTES = 256 * 1024
BLOCK_BYTES = 512
LEVEL = 3
THRESHOLD = 0.3
SCHEMA = "doc_id long, score double"


class Scorer:
    """Both dictionaries, digested once for a process."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.compressors = []
        for name in ("good", "bad") if model else ():
            known = zstandard.ZstdCompressionDict(model[name].tobytes())
            known.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False))
        self.slope, self.intercept = model.get("platt", np.zeros(2))

    def difference(self, text: str) -> float:
        """Above 0 if the good dictionary fits better."""
        data = text.encode()
        if not data or not self.compressors:
            return 0.0
        good, bad = (
            sum(len(c.compress(data[i : i + BLOCK_BYTES])) for i in range(0, len(data), BLOCK_BYTES)) for c in self.compressors
        )
        return (bad - good) / len(data)

    def probability(self, texts: list[str | None]) -> np.ndarray:
        return sigmoid(self.slope * np.array([self.difference(t or "") for t in texts], float) + self.intercept)


def _dictionary(texts: list[str]) -> np.ndarray:
    blocks = [b for t in texts for data in [t.encode()] for i in range(0, len(data), 1024) if (b := data[i : i + 1024])]
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: the text itself is the dictionary
        trained = b"".join(blocks)[-DICTIONARY_BYTES:]
    return np.frombuffer(trained, np.uint8)


def _fit(texts: list[str], labels: np.ndarray, counts: tuple[int, int]) -> dict[str, np.ndarray]:
    learn = np.arange(len(texts)) % 3 != 0
    if len(set(labels[learn])) < 2 or len(set(labels[~learn])) < 2:
        learn = np.ones(len(texts), bool)
    model = {
        name: _dictionary([t for t, y, use in zip(texts, labels, learn, strict=True) if use and y == label])
        for name, label in (("good", 1), ("bad", 0))
    }
    rest = ~learn if not learn.all() else learn
    scorer = Scorer(model)
    scores = np.array([scorer.difference(t) for t, use in zip(texts, rest, strict=True) if use])
    return model | {"platt": np.array(fit_platt(scores, labels[rest], counts))}


def fit_compression_model(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> dict[str, np.ndarray]:
    """Dictionaries and calibration from at most ``per_class`` labelled documents of each label, held-out ones excluded."""
    usable = ~held_out(F.col("doc_id"), FOLDS, HELD_FOLD)
    known = known_labels(labels, "quality", usable)
    return fit_in_one_task(labelled_sample(docs, known, per_class), partial(_fit, counts=label_counts(known)))


def score_quality(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, held_out, score, predicted) per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES

    def work(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            score = scorer.probability(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    rows = narrow(docs, "doc_id", "text")
    scored = map_arrow(rows.select(rows.doc_id.cast("long").alias("doc_id"), "text"), work, SCHEMA)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), FOLDS, HELD_FOLD).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_scored(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """The documents that are predicted good, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at = position(docs, "text")

    def work(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer.probability(batch.column(text_at).to_pylist()) >= THRESHOLD))

    return filter_arrow(docs, work)
