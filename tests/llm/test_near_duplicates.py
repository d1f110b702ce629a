"""The near-duplicates stage of the pipeline against a plain version with a rule of its own: five words, 0.8."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from descria.llm import jaccard_join
from test_plain import SF, WORD, WORDS, plain_ids, plain_leaks, read, texts
from descria.llm.queries import QUERIES


def plain_first(rows: dict[int, str]) -> set[int]:
    """The smallest id of each component, by comparing all pairs."""
    sets = {}
    for i, text in sorted(rows.items()):
        words = WORDS.findall(text.encode().lower())
        short = [tuple(words)] if words else []
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or set(short)
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((top(i), top(j)))
                root[high] = low
    return {i for i in root if root[i] == i}


def test_stage_drops_copies_with_two_percent_edited(spark):
    rng = np.random.default_rng(7)
    rows, n = {}, 0
    for length in (4, 5, 9, 14, 24, 60, 150, 400, 1000):
        for edits in (0, 0.01, 0.018, 0.022, 0.03, 0.05):
            words = [f"w{x}" for x in rng.integers(0, 5000, length)]
            for _ in range(4):
                rows[n], n = " ".join(words), n + 1
                words = [f"v{rng.integers(0, 5000)}" if rng.random() < edits else w for w in words]
    rows |= {n: "x " * 200, n + 1: "", n + 2: "  "}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.near_duplicates_stage(spark, docs, SF).collect()]
    want = plain_first(rows)
    assert sorted(got) == sorted(want) and 9 * 6 < len(want) < len(rows)


def test_long_texts_whose_sketches_differ_in_length(spark):
    rng = np.random.default_rng(5)
    rows, n = {}, 0
    for length in (1000, 1020, 1040, 1500, 2040, 2060, 4090, 4110, 9000):
        for edits in (0.01, 0.02, 0.024, 0.05):
            words = [f"w{x}" for x in rng.integers(0, 5000, length)]
            for _ in range(4):
                rows[n], n = " ".join(words), n + 1
                words = [f"v{rng.integers(0, 5000)}" if rng.random() < edits else w for w in words]
                words += [f"u{x}" for x in rng.integers(0, 5000, length // 40)]
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.near_duplicates_stage(spark, docs, SF).collect()]
    want = plain_first(rows)
    assert sorted(got) == sorted(want) and 9 * 4 < len(want) < len(rows)


def test_sketches_refuse_unrelated_sets_and_keep_linked_ones(spark):
    rng = np.random.default_rng(9)
    threshold, pairs = corpus_pipeline.LEAST_SHARED, []
    for n in (300, 1023, 1025, 2047, 2049, 5000, 20_000):
        a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in "ab")
        near = np.concatenate([a[n // 10 :], b[: n // 10]])[: n - n // 50]
        shared = len(np.intersect1d(a, near))
        assert shared >= threshold * (len(a) + len(near) - shared)
        sets = [np.unique(x) for x in (a, near, b)]
        wide = [jaccard_join.parities(x, jaccard_join.wide_longs(len(x))).tolist() for x in sets]
        pairs += [(n, len(sets[0]), wide[0], len(sets[k]), wide[k], k == 1) for k in (1, 2)]
    rows = spark.createDataFrame(pairs, "size long, n long, wide array<long>, m long, other array<long>, linked boolean")
    longs = jaccard_join._sketch_longs(threshold)

    def sketch(df, name, to):
        df = df.withColumnRenamed(name, "wide") if name != "wide" else df
        df = df.withColumn(to, F.transform(F.sequence(F.lit(0), longs - 1), lambda place: jaccard_join._folded_long(place, longs)))
        return df.drop("wide")

    rows = sketch(sketch(rows, "wide", "x"), "other", "y")
    got = rows.select("size", "linked", jaccard_join._within_parity_bound("x", "n", "y", "m", threshold).alias("passed")).collect()
    assert len(got) == 14 and all(r.passed == r.linked for r in got)


def test_pipeline_equals_plain_with_its_own_rule(spark):
    rows = texts()
    good = {r.doc_id for r in QUERIES["op1_quality_rules"](spark, SF).collect() if r.kept}
    good &= {r.doc_id for r in QUERIES["op6_compression_classifier"](spark, SF).collect() if r.predicted}
    first = plain_first({i: rows[i] for i in good})
    bench = read("benchmark")
    leaks = plain_leaks({i: rows[i] for i in first}, dict(zip(bench.item_id.astype(int), bench.text, strict=True)))
    want = {i: len(plain_ids(WORD, rows[i], 1)) for i in first - {i for i, _ in leaks}}
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert got.groupby("doc_id").length.sum().to_dict() == want


def test_one_id_on_several_texts(spark):
    a, b, c, e = (" ".join(f"{x}{k}" for k in range(80)) for x in "abce")
    near = e + " more"
    rows = [(5, a, 1), (5, b, 2), (6, a, 3), (7, b, 4), (2, c, 5), (5, c, 6), (9, e, 7), (9, near, 8), (9, e, 7), (5, "", 9), (8, None, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place int")
    got = [tuple(r) for r in jaccard_join.keep_first(docs).collect()]
    assert {r for r in got if r[0] != 9} == {(5, a, 1), (5, b, 2), (2, c, 5), (5, "", 9), (8, None, 10)}
    assert len([r for r in got if r[0] == 9]) == 1 and len(got) == 6


def test_sets_too_small_for_a_link_give_no_signatures(spark):
    grams = np.sort(np.random.default_rng(3).integers(0, 1 << 63, 40).astype(np.uint64))
    for threshold in (jaccard_join.THRESHOLD, corpus_pipeline.LEAST_SHARED):
        # A set of n links at best with one that has a shingle more.
        least = next(n for n in range(1, 40) if n >= threshold * (n + 1))
        counts = [len(jaccard_join.signatures(grams[:n], threshold)) for n in range(1, 41)]
        assert counts[0] == 0 and all(counts[least - 1 :])
    docs = spark.createDataFrame([(i, f"w{i % 300}") for i in range(600)], "doc_id long, text string")
    got = jaccard_join.jaccard_components(docs).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, i % 300) for i in range(600)}


def test_rows_of_several_nodes_over_batch_borders():
    rng = np.random.default_rng(11)
    for step in (1, 2, 3, 7, 1000):
        rows = sorted((int(a), int(b), 5) for a, b in zip(rng.integers(0, 90, 300), rng.integers(0, 4, 300), strict=True))
        batches = [
            pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + step]], pa.int64()) for k in range(3)], names=["signature", "node", "n"])
            for i in range(0, len(rows), step)
        ]
        got = [tuple(r.values()) for b in jaccard_join._of_several_nodes(iter(batches)) for r in b.to_pylist()]
        nodes = {a: {r[1] for r in rows if r[0] == a} for a in {r[0] for r in rows}}
        assert got == [r for r in sorted(set(rows)) if len(nodes[r[0]]) > 1]


def test_unrelated_sets_share_next_to_no_signature():
    """Ranges without a shingle agree in unrelated sets; signatures of them alone are left out."""
    rng = np.random.default_rng(11)
    given = [np.unique(rng.integers(0, 1 << 64, n, np.uint64)) for n in rng.integers(620, 961, 300)]
    lists = [np.unique(jaccard_join.signatures(grams, corpus_pipeline.LEAST_SHARED)) for grams in given]
    _, times = np.unique(np.concatenate(lists), return_counts=True)
    assert (times > 1).sum() < 5


def test_linked_sets_share_a_signature_wherever_they_differ():
    """Sets as far apart as a link allows, the differences dealt to as many runs as they can spoil."""
    rng = np.random.default_rng(12)
    for size in (*range(5, 80), 160, 251, 252, 390, 393, 394, 615, 950, 962, 963):
        for threshold in (corpus_pipeline.LEAST_SHARED, jaccard_join.THRESHOLD):
            grams = np.unique(rng.integers(0, 1 << 64, size, np.uint64))
            least, most = threshold.numerator, threshold.denominator
            gone = int(size * (1 - threshold))
            swapped = int(size * (1 - threshold) / (1 + threshold))
            runs = jaccard_join._runs(threshold, jaccard_join._bands(threshold, size)) or 1
            # Every other shingle in order of ranges, so that each run loses two where the number allows it.
            near = np.argsort(((grams >> np.uint64(32)) * np.uint64(runs) >> np.uint64(32)).astype(np.int64), kind="stable")
            for places in (near[:gone], near[:: max(1, size // max(1, gone))][:gone], rng.permutation(size)[:gone]):
                other = np.delete(grams, places)
                if len(other) * most >= size * least and len(other) < size:
                    assert np.intersect1d(jaccard_join.signatures(grams, threshold), jaccard_join.signatures(other, threshold)).size
            for places in (near[:swapped], rng.permutation(size)[:swapped]):
                if not swapped:
                    continue
                other = np.unique(np.append(np.delete(grams, places), rng.integers(0, 1 << 64, swapped, np.uint64)))
                shared = np.intersect1d(grams, other).size
                assert shared * most >= (2 * size - shared) * least
                assert np.intersect1d(jaccard_join.signatures(grams, threshold), jaccard_join.signatures(other, threshold)).size


def test_buckets_of_the_same_nodes_are_one(spark):
    rows = [(s, node, 50, node) for s in range(40) for node in ((1, 2, 3) if s % 2 else (2, 3))] + [(99, 4, 50, 1), (99, 5, 50, 1)]
    members = spark.createDataFrame(rows, "signature long, node long, n long, root long")
    got = jaccard_join._open_buckets(members).collect()
    assert sorted((r.signature, r.members, r.first) for r in got) == [(0, 2, 2), (1, 3, 1)]


def test_a_pair_of_many_buckets_is_made_a_few_times(spark):
    """Ten similar sets in 100 buckets, no two of the same nodes."""
    rng = np.random.default_rng(13)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    wide = [jaccard_join.parities(np.unique(np.append(base, rng.integers(0, 1 << 63, 5).astype(np.uint64))), 16).tolist() for _ in range(10)]
    longs = jaccard_join._sketch_longs(corpus_pipeline.LEAST_SHARED)
    sketch = F.transform(F.sequence(F.lit(0), longs - 1), lambda place: jaccard_join._folded_long(place, longs))
    sketches = spark.createDataFrame(list(enumerate(wide)), "set_key long, wide array<long>").select("set_key", sketch.alias("sketch"))
    rows = [(s, node, 305, node, node < 2) for s in range(100) for node in range(10) if node < 2 or rng.random() < 0.8]
    members = spark.createDataFrame(rows, "signature long, node long, n long, root long, pivot boolean")
    got = [tuple(r) for r in jaccard_join._meetings(members, sketches, 8, corpus_pipeline.LEAST_SHARED).collect()]
    assert set(got) == {(p, x) for p in (0, 1) for x in range(p + 1, 10)}
    assert len(got) <= 2 * len(set(got))


def test_rows_that_surely_stay_are_not_moved(spark):
    def moved(plan):
        texts_too = plan.getClass().getSimpleName() == "ShuffleExchangeExec" and "c1#" in plan.output().mkString(",")
        own = plan.metrics().apply("shuffleRecordsWritten").value() if texts_too else 0
        below = [plan.executedPlan()] if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else []
        below += [plan.plan()] if plan.getClass().getSimpleName() == "ShuffleQueryStageExec" else []
        children = plan.children()
        return own + sum(map(moved, below + [children.apply(i) for i in range(children.size())]))

    texts = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), (300, texts[7]), (301, texts[8] + " more")], "doc_id long, text string")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        kept = jaccard_join.keep_first(docs)
        rows = kept.collect()
    finally:
        spark.conf.set(key, before)
    assert sorted(r.doc_id for r in rows) == list(range(300))
    assert moved(kept._jdf.queryExecution().executedPlan()) <= 8
