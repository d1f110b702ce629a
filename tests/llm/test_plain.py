"""Registered queries of the training-text operators against plain versions, held-out labels and odd tables."""

from __future__ import annotations

import base64
import collections
import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from descria.llm import (
    compress_classifier,
    decontaminate,
    jaccard_join,
    packing,
    quality_rules,
    sharding,
    token_files,
    toxicity,
    url_filter,
    warc,
)
from descria.llm.queries import QUERIES

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def read(name: str, folder: str = SF) -> pd.DataFrame:
    return pd.read_parquet(f"{folder}/{name}.parquet")


def texts() -> dict[int, str]:
    docs = read("documents")
    return {int(i): t if isinstance(t, str) else "" for i, t in zip(docs.doc_id, docs.text, strict=True)}


@lru_cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def plain_ids(path: str, text: str, end: int) -> list[int]:
    return [*tokenizer(path).encode(text, add_special_tokens=False).ids, end]


def digest(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def plain_components(rows: dict[int, str], size: int = 3) -> dict[int, tuple[int, int]]:
    """(set size, smallest reachable id) of each document."""
    sets = {}
    for i, text in rows.items():
        words = WORDS.findall(text.encode().lower())
        short = [tuple(words)] if words else []
        sets[i] = frozenset([tuple(words[k : k + size]) for k in range(len(words) - size + 1)] or short)
    ids = collections.defaultdict(list)
    for i, own in sets.items():
        ids[own].append(i)
    nodes = [own for own in ids if own]
    root = list(range(len(nodes)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    holders = collections.defaultdict(list)
    for k, own in enumerate(nodes):
        shared = collections.Counter(j for gram in own for j in holders[gram])
        for j, n in shared.items():
            if 100 * n >= 90 * (len(own) + len(nodes[j]) - n):
                root[top(k)] = top(j)
        for gram in own:
            holders[gram].append(k)
    least = collections.defaultdict(lambda: float("inf"))
    for k, own in enumerate(nodes):
        least[top(k)] = min(least[top(k)], *ids[own], float("inf"))
    found = {i: (0, i) for i in rows}
    for k, own in enumerate(nodes):
        found |= {i: (len(own), least[top(k)]) for i in ids[own]}
    return found


def plain_leaks(rows: dict[int, str], items: dict[int, str]) -> set[tuple[int, int]]:
    """(document, item): every passage scored against every item, without index or bounds."""

    def words(text):
        return "".join(" " if 33 <= ord(c) < 127 and not c.isalnum() else c for c in text.lower()).encode().split()

    def grams(own, size):
        return {tuple(own[k : k + size]) for k in range(len(own) - size + 1)}

    step, width = decontaminate.STRIDE, decontaminate.PASSAGE
    units = [(i, own[k : k + width]) for i, t in items.items() for own in [words(t)] for k in range(0, len(own), width)]
    df = collections.Counter(w for _, own in units for w in set(own))
    average = np.mean([len(own) for _, own in units])
    impacts = []
    for _, own in units:
        tf = collections.Counter(own)
        norm = decontaminate.K1 * (1 - decontaminate.B + decontaminate.B * len(own) / average)
        raw = {w: np.log(1 + (len(units) - df[w] + 0.5) / (df[w] + 0.5)) * n * (decontaminate.K1 + 1) / (n + norm) for w, n in tf.items()}
        impacts.append({w: x / sum(raw.values()) for w, x in raw.items()})
    found = set()
    for doc, text in rows.items():
        own = words(text)
        for start in range(0, max(len(own) - width + step, 1) if own else 0, step):
            there = set(own[start : start + width])
            for (item, _), impact in zip(units, impacts, strict=True):
                if sum(x for w, x in impact.items() if w in there) < decontaminate.THRESHOLD - 1e-9:
                    continue
                asked = words(items[item])
                near = own[max(0, start - len(asked)) : min(start + width, len(own)) + len(asked)]
                cut = decontaminate.answer_start(items[item])
                parts = [(p, min(decontaminate.GRAM, max(len(p), 1))) for p in (asked[:cut], asked[cut:])]
                shares = [len(grams(p, n) & grams(near, n)) / len(grams(p, n)) if p else 1.0 for p, n in parts]
                if min(shares) >= decontaminate.LEAST_OVERLAP:
                    found.add((doc, item))
    return found


def area_under_curve(score: pd.Series, label: pd.Series) -> float:
    rank, n1 = score.rank(), (label == 1).sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_rules_query(spark):
    got = QUERIES["op1_quality_rules"](spark, SF).toPandas().set_index("doc_id")
    rows = texts()
    assert set(got.index) == set(rows) and len(got) == len(rows)
    for i, text in rows.items():
        words = WORDS.findall(text.encode())
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        seen = collections.Counter(grams)
        repeated = len({k + j for k, g in enumerate(grams) if seen[g] > 1 for j in range(5)})
        lines = [x for x in text.split("\n") if WORDS.search(x.encode())]
        symbols = sum(c in "#*$%&|<>" for c in text)
        r = got.loc[i]
        want = (len(words), sum(len(w.decode()) for w in words), symbols, len(lines) - len(set(lines)), repeated)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 10 or 100 * repeated > 20 * len(words))
        assert not (r.base_failed and r.kept)


def test_join_query(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op4_jaccard_join"](spark, SF).collect()}
    assert got == plain_components(texts())


def test_join_around_the_threshold(spark):
    """Chains of small edits, so that similarities lie on both sides of the limit, for short and long sets."""
    rng = np.random.default_rng(5)
    rows, n = {}, 0
    for length in (3, 4, 9, 12, 19, 30, 60, 200, 700):
        for _ in range(4):
            words = [f"w{x}" for x in rng.integers(0, 5000, length)]
            for _ in range(8):
                rows[n], n = " ".join(words), n + 1
                words = list(words)
                for at in rng.integers(0, length, rng.integers(0, max(2, length // 60) + 1)):
                    words[at] = f"v{rng.integers(0, 5000)}"
                words += [f"u{rng.integers(0, 5000)}"] * int(rng.integers(0, 2))
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    want = plain_components(rows)
    assert got == want and 1 < len({c for _, c in want.values()}) < len(rows)


def test_leaks_query(spark):
    bench = read("benchmark")
    items = dict(zip(bench.item_id.astype(int), bench.text, strict=True))
    got = {(r.doc_id, r.item_id) for r in QUERIES["op3_bm25_decontamination"](spark, SF).collect()}
    assert got == plain_leaks(texts(), items)


def test_packing_query(spark):
    got = QUERIES["op2_best_fit_packing"](spark, SF).toPandas().sort_values(["doc_id", "piece"])
    want = []
    for i, text in sorted(texts().items()):
        ids = plain_ids(WORD, text, 1)
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want.append((i, piece, start, len(part), digest(part)))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert list(got[names].itertuples(index=False, name=None)) == want
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 4096


def test_shards_query(spark):
    got = QUERIES["op5_sampled_splitters"](spark, SF).toPandas().sort_values(["shard", "slot"])
    rows = texts()
    assert sorted(got.doc_id) == sorted(rows) and got["shard"].between(0, 23).all()
    for r in got.itertuples():
        data = rows[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
    assert (got.groupby("shard").cumcount() == got["slot"]).all() and got.law.nunique() == 1


def test_token_files_query(spark):
    got = QUERIES["op8_simple8b_files"](spark, SF).toPandas().sort_values("doc_id")
    start, want = 0, []
    for i, text in sorted(texts().items()):
        ids = plain_ids(BYTE, text, 2)
        want.append((i, start, len(ids), digest(ids)))
        start += len(ids)
    assert list(got[["doc_id", "start", "n_tokens", "ids_crc32"]].itertuples(index=False, name=None)) == want


def test_archive_query(spark):
    pages = read("pages")
    payload = {int(i): (t if isinstance(t, str) else "").encode() for i, t in zip(pages.page_id, pages.html, strict=True)}
    last = {}
    for i in sorted(payload):
        last[payload[i]] = i
    want = {
        (i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), *(("response", None) if last[data] == i else ("revisit", last[data])))
        for i, data in payload.items()
    }
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    got = [tuple(r[c] for c in names) for r in QUERIES["op9_warc_index"](spark, SF).collect()]
    assert len(got) == len(payload) and set(got) == want


@pytest.mark.parametrize(
    "name, label, folds, fold, least", [("op6_compression_classifier", "quality", 5, 0, 0.3), ("op10_weak_toxicity", "toxic", 3, 1, 0.7)]
)
def test_held_out_accuracy(spark, name, label, folds, fold, least):
    got = QUERIES[name](spark, LARGER).toPandas()
    assert len(got) == len(read("documents", LARGER)) and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= least)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % folds == fold for i in got.doc_id]).all()
    known = got[got.held_out].merge(read("labels", LARGER)[["doc_id", label]], on="doc_id").dropna()
    assert area_under_curve(known.score, known[label]) > 0.9


SCHEMA = "doc_id long, text string, Text string, lang string, source string"
LONG = "one two three four five six seven eight nine ten " * 4000
ODD = [
    (1, "", None, None, None), (2, None, "x", "en", None), (3, LONG, None, None, "s"), (None, "a b c d", "", None, None),
    (4, "a b c d", None, None, None), (4, "a b c d", None, None, None), (5, "  \n\t ", None, None, None),
]
ITEMS = [(1, None), (None, "what is this thing here? It is a plain thing of its own."), (2, "")]


def bench(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


EACH_ROW = {
    "rules": lambda spark, d: quality_rules.judge_quality(d, {}),
    "classifier": lambda spark, d: compress_classifier.score_quality(d, {}),
    "classifier keeps without model": lambda spark, d: compress_classifier.keep_scored(d, {}),
    "toxicity": lambda spark, d: toxicity.score_toxicity(d, {}),
    "join": lambda spark, d: jaccard_join.jaccard_components(d),
    "shards": lambda spark, d: sharding.shard_by_bytes(d),
    "token files": lambda spark, d: token_files.round_trip(d, BYTE),
    "no leaks": lambda spark, d: decontaminate.drop_leaks(d, bench(spark)),
}
OTHERS = {
    "rules keep": lambda spark, d: quality_rules.keep_quality(d, {}),
    "leaks": lambda spark, d: decontaminate.find_leaks(d, bench(spark)),
    "first of group": lambda spark, d: jaccard_join.keep_first(d),
    "packing": lambda spark, d: packing.pack_documents(d, WORD),
}


@pytest.mark.parametrize("name", EACH_ROW)
def test_odd_rows_come_back_each(spark, name):
    assert EACH_ROW[name](spark, spark.createDataFrame(ODD, SCHEMA)).count() == len(ODD)


@pytest.mark.parametrize("name", EACH_ROW | OTHERS)
def test_empty_table(spark, name):
    assert (EACH_ROW | OTHERS)[name](spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_odd_rows_elsewhere(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    assert OTHERS["rules keep"](spark, docs).count() == 0  # too few words, or all of them repeated
    assert OTHERS["leaks"](spark, docs).count() == 0
    kept = OTHERS["first of group"](spark, docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5]
    packed = OTHERS["packing"](spark, docs).toPandas()
    assert packed[packed.piece == 0].shape[0] == len(ODD)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    for rows in ([], [(1, None, None)], [(1, 1, 1), (2, 1, 1)], [(None, 0, 1), (77, 0, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        assert quality_rules.fit_quality_model(docs, labels) == {}
        assert compress_classifier.fit_compression_model(docs, labels) == {}
        assert toxicity.fit_toxicity_model(docs, labels) == {}


def test_odd_and_empty_benchmark(spark):
    text = "what is this thing here? It is a plain thing of its own."
    docs = spark.createDataFrame([(1, text), (2, "other"), (None, text)], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.drop_leaks(docs, bench(spark)).collect()] == [2]
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench(spark)).collect()} == {(1, None), (None, None)}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_leaks(docs, none).count() == 3 and decontaminate.find_leaks(docs, none).count() == 0


def test_odd_and_empty_pages(spark):
    schema = "page_id long, url string, html string, Html string"
    rows = [(1, None, None, "x"), (1, None, None, "x"), (None, "http://a.org/de/", LONG, None), (2, "", "", None)]
    for some in (rows, []):
        pages = spark.createDataFrame(some, schema)
        rules = url_filter.rule_table(spark, [("org", "/", "block")])
        assert url_filter.judge_urls(pages, rules).count() == len(some)
        archived = warc.round_trip(pages).toPandas()
        assert len(archived) == len(some)
    assert url_filter.judge_urls(spark.createDataFrame(rows, schema), url_filter.rule_table(spark, [])).count() == len(rows)
