"""Operators for training text on small tables: brute force, round trips, and odd rows."""

from __future__ import annotations

import base64
import collections
import hashlib
import os
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from check_twins import compare, connect
from descria.llm import decontaminate, jaccard_join, packing, quality_rules, sharding, simple8b, token_files, tokens, url_filter, warc
from descria.llm.queries import QUERIES, TWINS
from descria.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
ODD = ["", "one", "a b", "x y z w", "x y z w", "don't  stop\n\nnow", "x́ é 日本 語 <|endoftext|>", " lead", "tab\tx ", None]
LONG = "word " * 30_000 + "end"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns that differ in case only."""
    rows = [(i, t, "en", t) for i, t in enumerate([*ODD, LONG])] + [(3, "x y z w", "en", "q"), (None, "x y z w", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, Text string")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_tokenizers(name):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    texts = [t or "" for t in ODD] + ["The cat sat, the cat.\nNew line it's 12 b3c a_b ÀÖ×÷", "a <|endoftext|> b", "<|startoftext|>x <|ENDOFTEXT|> y", LONG]
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    own = Encoder(path)
    assert own.encode(pa.array(texts)) == want == own.encode(pa.array(texts))


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for values in (rng.integers(0, 50_000, 5000), rng.integers(0, 2, 3000), [2**63 + 5, 1, 2**60, 2**60 - 1, 0xF << 60], [], [5]):
        values = np.array(values, np.uint64)
        assert (simple8b.decode(*simple8b.encode(values)) == values).all()


def test_base_counts_equal_brute_force(spark, odd):
    got = quality_rules.judge_quality(odd, {}).collect()
    assert len(got) == odd.count()
    texts = {i: t or "" for i, t in enumerate([*ODD, LONG])}
    for r in got:
        text = texts.get(r.doc_id, "x y z w")
        words = text.encode().split()
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        seen = collections.Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(words), len(covered), len(lines) - len(set(lines)))
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))


def test_packing_places_all_pieces_without_gaps(odd):
    rows = packing.pack_documents(odd, public_tokenizers.path("word_bpe_49k.json")).toPandas()
    assert len(set(rows.doc_id.dropna())) == len(ODD) + 1 and rows.length.max() <= packing.CAPACITY
    rows = rows.sort_values(["sequence_id", "offset"])
    assert (rows.groupby("sequence_id").length.cumsum() - rows.length == rows.offset).all()


def test_jaccard_on_odd_rows(odd):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(odd).collect()}
    assert {(0, 0, 0), (9, 0, 9), (1, 1, 1), (2, 1, 2), (3, 2, 3), (4, 2, 3), (None, 2, 3)} <= got
    kept = [r.doc_id for r in jaccard_join.keep_first(odd).select("doc_id").collect()]
    assert kept.count(3) == 1 and 4 not in kept and 0 in kept


def test_leaks(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta. Iota kappa lambda mu nu."
    bench = spark.createDataFrame([(7, item), (8, None), (9, "other words stand here in another item. Yes they do.")], "item_id long, text string")
    filler = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(1, f"{filler} {item.upper()} {filler}"), (2, filler), (3, None), (4, item[:30])], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()] == [(1, 7)]
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()) == [2, 3, 4]


def test_shards_are_gapless(odd):
    rows = sharding.shard_by_bytes(odd).toPandas().sort_values(["shard", "slot"])
    assert len(rows) == odd.count() and (rows.groupby("shard").cumcount() == rows.slot).all()


def test_token_files_round_trip(odd):
    got = token_files.round_trip(odd, public_tokenizers.path("byte_bpe_50k.json")).toPandas().sort_values("start")
    assert len(got) == odd.count() and (got.n_tokens.cumsum() - got.n_tokens == got.start).all()
    empty = got[got.doc_id == 0].iloc[0]
    assert (empty.n_tokens, empty.ids_crc32) == (1, zlib.crc32(np.array([2], "<u4").tobytes()))


def test_archive_round_trip_and_revisits(spark):
    rows = [(1, "http://a.org/x", "same"), (2, "http://a.org/x", "same"), (3, None, None), (None, "b", "own"), (5, "http://B.org/é?q#f", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert (got[1].record_type, got[1].refers_to, got[2].record_type) == ("revisit", 2, "response")
    assert (got[3].record_type, got[3].refers_to) == ("revisit", 5) and got[None].payload_bytes == 3
    assert got[1].payload_digest == base64.b32encode(hashlib.sha1(b"same").digest()).decode()


def test_url_rules_nest(spark):
    rules = url_filter.rule_table(spark, [("org", "/", "block"), ("a.org", "/x/", "allow"), ("a.org", "/x/y", "block")])
    urls = ["http://A.org/x/yz", "http://a.org/x/z", "http://b.a.org/x/z?k", "http://c.org", "http://c.org/", "none", None, "http://a.org/x/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.rule for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {0: "a.org/x/y", 1: "a.org/x/", 2: "a.org/x/", 3: None, 4: "org/", 5: None, 6: None, 7: "a.org/x/"}


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, name):
    assert compare(spark, connect(SF), SF, QUERIES[name], TWINS[name])[0] == "ok"


def test_url_sweeps_are_dealt_by_place_and_sweep(spark):
    """A host with many URLs is swept in several tasks."""
    urls = spark.createDataFrame([(i, f"http://a{i % 7}.com/{'fr' if i % 3 else 'de'}/{i}") for i in range(9000)], "page_id long, url string")
    rules = url_filter.rule_table(spark, [("com", "/fr/", "allow"), ("com", "/de/", "block"), ("com", "/de/1", "allow")])
    judged = url_filter.judge_urls(urls, rules)
    assert re.search(r"hashpartitioning\(place#\d+, sweep#\d+", judged._jdf.queryExecution().executedPlan().toString())
    for r in judged.collect():
        want = "com/fr/" if r.page_id % 3 else "com/de/1" if str(r.page_id).startswith("1") else "com/de/"
        assert (r.rule, r.verdict) == (want, "block" if want == "com/de/" else "allow")


def test_encoder_starts_no_threads():
    """Each task of an executor had as many threads as the machine has cores; see the CPU seconds of ``op8_simple8b_files``."""
    code = (
        "import os, sys; sys.path.insert(0, sys.argv[1])\n"
        "import pyarrow as pa\n"
        "from descria.llm.tokens import Encoder\n"
        "before = len(os.listdir('/proc/self/task'))\n"
        "own = Encoder(sys.argv[2])\n"
        "own.encode(pa.array([f'word{k} and others  {k}' for k in range(5000)] + [f'a{k} b{k}' for k in range(5000)]))\n"
        "print(len(os.listdir('/proc/self/task')) - before)"
    )
    root = str(Path(__file__).resolve().parents[2])
    run = [sys.executable, "-c", code, root, public_tokenizers.path("byte_bpe_50k.json")]
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    assert int(subprocess.run(run, check=True, capture_output=True, text=True, env=env, timeout=120).stdout) == 0


def test_simple8b_words_equal_one_by_one_coding():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(0, 50_000, 2500), rng.integers(0, 2, 900), [2**63 + 5, 2**60, 0, 2**53 + 1]]).astype(np.uint64)
    words, offsets = simple8b.encode(values)
    want, starts = [], [0]
    for first in range(0, len(values), simple8b.BLOCK):
        block = values[first : first + simple8b.BLOCK].tolist()
        while block:
            fits = [s for s, (n, w) in enumerate(zip(simple8b.COUNTS, simple8b.WIDTHS, strict=True)) if n <= len(block) and max(block[:n]) < 1 << w]
            if not fits:
                want += [simple8b.ESCAPE << 60, block.pop(0)]
                continue
            n, w = simple8b.COUNTS[fits[0]], simple8b.WIDTHS[fits[0]]
            want.append(fits[0] << 60 | sum(v << k * w for k, v in enumerate(block[:n])))
            block = block[n:]
        starts.append(len(want))
    assert words.tolist() == want and offsets.tolist() == starts


def test_workers_keep_no_pieces_after_packing(spark):
    """Kept pieces of idle workers took the memory of the pipeline's other tasks."""
    docs = spark.createDataFrame([(k, f"some word{k} here x{k}y") for k in range(400)], "doc_id long, text string").repartition(8)
    assert packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 400

    def kept(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([sum(e.pieces.size for e in tokens._encoders.values())], pa.int64())], names=["n"])

    assert [r.n for r in spark.range(800).repartition(8).mapInArrow(kept, "n long").collect()] == [0] * 8
