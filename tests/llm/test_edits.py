"""Fill-in-the-middle, line dedup and collocations against plain versions, SQL twins and odd tables."""

from __future__ import annotations

import collections
import hashlib
import re

import numpy as np
import pytest

from check_twins import compare, connect
from descria.errors import DescriaError
from descria.llm import collocations, cuckoo, fill_middle, line_dedup
from descria.llm.queries import QUERIES, TWINS

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, Text string, lang string"
ODD = [
    (1, "", None, None), (2, None, "x", "en"), (3, "one two.\n" * 30000 + "ü\nlast", None, "de"), (None, "a b c\n\nd é", "", None),
    (4, "a <S> b", None, ""), (4, "a <S> b", None, ""), (5, "  \n\t \n", None, "und"), (6, "\n", None, "en"), (7, "x" * 5000 + "\n漢字\n", None, "ja"),
]


@pytest.mark.parametrize("name", ["op11_fill_middle", "op12_line_dedup", "op13_collocations"])
def test_twin(spark, name):
    verdict, rows, _ = compare(spark, connect(SF), SF, QUERIES[name], TWINS[name])
    assert verdict == "ok" and rows


def plain_middle(doc_id, text, seed=7, fim=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return (doc_id, len(units), "plain", None, None, text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, len(units), "spm" if h[3] % 100 < spm else "psm", len(p), len(m), out)


def test_middles_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    for seed, fim in ((7, 100), (8, 40)):
        made = fill_middle.fill_in_middle(docs, seed, fim)
        got = sorted(map(tuple, made.collect()), key=str)
        assert got == sorted([plain_middle(r[0], r[1], seed, fim) for r in ODD], key=str)
    back = made.select("doc_id", fill_middle.restored(made.output, made.form).alias("text")).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((r[0], r[1] or "") for r in ODD), key=str)


def test_block_tree_finds_every_line_end():
    rng = np.random.default_rng(1)
    for size in (0, 1, 255, 256, 257, 5000, 70_000):
        raw = rng.choice(np.frombuffer("ab\né".encode(), np.uint8), size)
        tree = fill_middle.BlockTree(raw)
        ends = np.flatnonzero(raw == 10) + 1
        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        if len(ends):
            at, before = tree.unit_ends(np.arange(1, len(ends) + 1))
            assert (at == ends).all() and (before == points[ends]).all()
        places = np.arange(0, size + 1, max(1, size // 300))
        units, chars = tree.before(places)
        assert (units == np.searchsorted(ends, places, "right")).all() and (chars == points[places]).all()


def test_filter_holds_what_was_inserted_and_not_deleted():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 63, (20_000, 2)).astype(np.uint64)
    made = cuckoo.CuckooFilter.of(keys[:10_000])
    assert made.contains(keys[:10_000]).all() and made.contains(keys[10_000:]).mean() < 0.002
    made.delete(keys[:5000])
    assert made.contains(keys[5000:10_000]).all() and made.contains(keys[:5000]).mean() < 0.002
    again = cuckoo.CuckooFilter.from_bytes(made.to_bytes())
    assert (again.contains(keys) == made.contains(keys)).all()
    small = cuckoo.CuckooFilter.sized(10)
    assert not small.insert(keys[:500])  # no room: to be rebuilt
    with pytest.raises(ValueError):
        made.delete(np.array([[1, 2]], np.uint64))


def plain_dedup(counted, cleaned, least):
    """Rows of ``cleaned`` without the lines that ``least`` rows of ``counted`` share."""

    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip("\t\n\x0b\x0c\r "))

    n = collections.Counter(k for _, t in counted for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in cleaned:
        lines = (t or "").split("\n")
        kept = [x for x in lines if n[key(x)] < least or not key(x)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def lines_table(n, seed):
    rng = np.random.default_rng(seed)
    common = ["Read MORE", " read more\t", "all rights", "\x0ball Rights\r", "", "ÄÖ x", "äö x"]
    return [(int(rng.integers(0, 9999)), "\n".join(rng.choice([*common, *(f"line {k}" for k in rng.integers(0, 30, 4))], 6))) for _ in range(n)]


def test_store_is_reversible(spark, tmp_path):
    first, second = lines_table(40, 1), lines_table(25, 2)
    a, b = (spark.createDataFrame(x, "doc_id long, text string") for x in (first, second))
    store = line_dedup.LineStore.create(spark, str(tmp_path / "store"), 3, least_docs=8)
    store.insert(a)
    before = sorted(map(tuple, store.counts().collect()))

    def cleaned(some):
        return sorted(map(tuple, store.clean(some).collect()), key=str)

    assert cleaned(a) == plain_dedup(first, first, 8)
    store.insert(b)
    assert cleaned(b) == plain_dedup(first + second, second, 8)
    store = line_dedup.LineStore.open(spark, str(tmp_path / "store"))
    store.compact()
    assert cleaned(a) == plain_dedup(first + second, first, 8)
    store.delete(b)
    assert cleaned(a) == plain_dedup(first, first, 8)
    assert sorted(map(tuple, store.counts().collect())) == before
    with pytest.raises(DescriaError):
        store.delete(b)
    assert cleaned(a) == plain_dedup(first, first, 8)
    store.delete(a)
    assert cleaned(a) == plain_dedup([], first, 8) and store.counts().isEmpty()


def test_line_dedup_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD * 4, SCHEMA)
    for least, points in ((2, 1), (8, 1), (4, 6), (1, 1)):
        got = sorted(map(tuple, line_dedup.drop_shared_lines(docs, least, points).collect()), key=str)
        if points == 1:
            assert got == plain_dedup([r[:2] for r in ODD * 4], [r[:2] for r in ODD * 4], least)
        assert len(got) == 4 * len(ODD)


def plain_collocations(rows, longest=4, least=3, top=50, scale=2_000_000, inside=80):
    count, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        total[lang] += 0
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, longest + 1):
                count[lang].update(tuple(words[k : k + m]) for k in range(len(words) - m + 1))
    out = set()
    for lang, f in count.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            longer = (b for q, b in f.items() if len(q) > len(p) and b >= least and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1)))
            if any(100 * b >= inside * a for b in longer):
                continue
            score, _, left, right = min((scale * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return out


@pytest.mark.parametrize("dense_ids", [collocations.DENSE_IDS, 8, 0])
def test_collocations_equal_plain(spark, monkeypatch, dense_ids):
    """Also with few or no direct addresses, so that most or all pairs are counted as sorted runs."""
    rng = np.random.default_rng(4)
    words = np.array(["of", "the", "New", "york", "ü", "in", "it's", "a-b", "x", "Über"])
    rows = [(None if k % 7 == 0 else ("en", "de", "und")[k % 3], "".join(w + s for w, s in zip(rng.choice(words, 60), rng.choice([" ", "\t ", ". ", " ", "\n"], 60), strict=True))) for k in range(40)]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, lang string, text string")
    got = collocations.mine_collocations(docs, least=3, top=50, dense_ids=dense_ids).collect()
    assert {tuple(r) for r in got} == plain_collocations(rows) and len({tuple(r) for r in got}) == len(got)


def test_tiles_count_dense_and_sparse_alike(monkeypatch):
    monkeypatch.setattr(collocations, "BUFFER", 5000)
    monkeypatch.setattr(collocations, "DENSE_SHARE", 1 << 10)  # a tile is dense from 1024 pairs on
    rng = np.random.default_rng(6)
    a, b = (np.minimum(rng.zipf(1.2, 60_000), 20_000).astype(np.int64) - 1 for _ in range(2))
    tiles, got = collocations.PairTiles(), collections.Counter()
    for k in range(0, len(a), 700):
        for pairs, n in tiles.add(a[k : k + 700], b[k : k + 700]):
            got.update(dict(zip(pairs.tolist(), n.tolist(), strict=True)))
    assert tiles.dense
    for pairs, n in tiles.rest():
        got.update(dict(zip(pairs.tolist(), n.tolist(), strict=True)))
    assert got == collections.Counter((a << 32 | b).tolist())


def test_odd_and_empty_tables(spark):
    docs, none = spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame([], SCHEMA)
    got = collocations.mine_collocations(docs, least=2).collect()
    assert {tuple(r) for r in got} == plain_collocations([(r[3], r[1]) for r in ODD], least=2, top=2000)
    assert fill_middle.digests(none).isEmpty() and line_dedup.digests(none).isEmpty()
    assert collocations.mine_collocations(none).isEmpty()
