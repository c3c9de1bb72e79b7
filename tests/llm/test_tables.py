"""Licence scans, token totals, vector search, the classifier and the pipeline."""

import math
import itertools
import zlib

import numpy as np
import pytest
from compare import compare, duck
from pyspark.sql import functions as F

import corpus_pipeline
from lotwatch.llm import licences, quality, token_counts, vectors
from lotwatch.llm.queries import BYTE_BPE, QUERIES
from lotwatch.session import fresh_folder

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op3_licences", "op4_token_counts", "op6_topk"])
def test_query_equals_its_sql(spark, name):
    assert compare(spark, duck(FOLDER), FOLDER, name) == ""


def test_licences_survive_layout_and_spelling(spark):
    mit = licences.MIT.replace("Copyright (c) <year> <copyright holders>", "© 2020 A. Nobody\nCOPYRIGHT (C) 2021, B").upper().replace(", ", " ,\t").replace(" OF ", "  of\r ")
    rows = [
        (1, mit), (2, "Licenced under the Apache Licence; version 2.0\nText.\nLICENSED under CC-BY-NC 4.0!"), (3, None), (4, ""), (5, "text"), (5, "text"), (5, "Released under the MIT license"),
        (None, "text\n\nReleased under the MIT license"), (6, "Licensed under the Apache License, Version 2.1."), (7, "x " * 50_000 + "\n" + "Licensed under CC BY 4.0\n" * 2),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licence", F.lit(1)).withColumn("lines", F.lit("x"))
    known = licences.known_digests(spark)
    found = licences.scan(docs, known).collect()
    got = sorted((r["doc_id"] or 0, r["licence"] or "", r["notices"], r["notice_lines"]) for r in found)
    assert got == [
        (0, "", "MIT", 1), (1, "MIT", "", 0), (2, "", "Apache-2.0,CC-BY-NC-4.0", 2), (3, "", "", 0), (4, "", "", 0),
        (5, "", "", 0), (5, "", "", 0), (5, "MIT", "MIT", 1), (6, "", "", 0), (7, "", "CC-BY-4.0", 2),
    ]
    assert licences.scan(docs.limit(0), known).count() == 0
    assert licences.known_digests(spark, [("a", "Copyright (c) X"), ("b", "!"), ("c", "Y"), ("b", "y")]).collect()[0]["licence"] == "b"


CHANGES = "doc_id long, source string, lang string, text string, deleted boolean, tokens string"


def _totals(rollup):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["documents"], r["tokens"]) for r in rollup.totals().collect()}


def test_totals_follow_inserts_revisions_and_deletes(spark):
    rollup = token_counts.TokenRollup(spark, fresh_folder(spark, "tokens"))
    words = token_counts.pattern_counter(token_counts.WORDS)
    assert rollup.totals().count() == 0
    first = [(1, "a", "en", "x y z", False, "c"), (2, "a", "en", "x", None, "c"), (2, "a", "en", "x", None, "c"), (3, None, None, None, False, "c"), (4, "b", "de", "", False, "c"),
             (None, "a", "en", "x x", False, "c"), (9, "a", "en", None, True, "c"), (5, "a", "fr", "q", True, "c"), (5, "a", "fr", "q r", False, "c")]
    batch = spark.createDataFrame(first, CHANGES)
    assert rollup.apply("one", batch, "w", words)
    one = {("a", "en", "w"): (2, 4), (None, None, "w"): (1, 0), ("b", "de", "w"): (1, 0), ("a", "fr", "w"): (1, 2)}
    assert _totals(rollup) == one
    assert not rollup.apply("one", batch, "w", words) and _totals(rollup) == one
    second = spark.createDataFrame([(1, "b", "en", "x y", False, ""), (2, None, None, None, True, ""), (3, None, None, "t " * 50_000, False, ""), (4, "b", "de", "", True, "")], CHANGES)
    assert rollup.apply("two", second, "w", words)
    two = {("b", "en", "w"): (1, 2), (None, None, "w"): (1, 50_000), ("a", "fr", "w"): (1, 2)}
    assert _totals(rollup) == two
    assert rollup.apply("three", batch, "bpe", token_counts.bpe_counter(BYTE_BPE)) and rollup.apply("none", batch.limit(0), "w", words)
    assert {k: v for k, v in _totals(rollup).items() if k[2] == "w"} == two
    assert {k: v[0] for k, v in _totals(rollup).items() if k[2] == "bpe"} == {("a", "en", "bpe"): 2, (None, None, "bpe"): 1, ("b", "de", "bpe"): 1, ("a", "fr", "bpe"): 1}


def test_a_batch_that_died_before_its_commit_leaves_nothing(spark, monkeypatch):
    rollup = token_counts.TokenRollup(spark, fresh_folder(spark, "tokens"))
    words = token_counts.pattern_counter(token_counts.WORDS)
    batch = spark.createDataFrame([(1, "a", "en", "x y", False, "")], CHANGES)
    make = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        rollup.apply("one", batch, "w", words)
    monkeypatch.setattr(type(spark), "createDataFrame", make)
    assert rollup.totals().count() == 0 and rollup.apply("one", batch, "w", words)
    assert _totals(rollup) == {("a", "en", "w"): (1, 2)}


def _nearest(rows, k=10):
    exact = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in exact if i % 100 == 0}):
        own = min(v for i, v in exact if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in exact if i != q and len(v) == len(own))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return out


@pytest.mark.parametrize("blocks", [(7, 2), (4096, 512)])
def test_nearest_with_ties_repeats_and_odd_vectors(spark, blocks):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(1, 240)]
    rows += [(0, [0.0] * 4), (100, [9.0, -9.0, 0.5, 0.0]), (300, [1.0, 2.0]), (301, [2.0, 1.0]), (400, [1.0, 2.0, 3.0]), (500, []), (600, None)]
    rows += [(700, [1.0, None, 0.0, 0.0]), (701, [float("nan")] * 4), (702, [float("inf"), 0.0, 0.0, 0.0]), (None, [5.0] * 4), (800, [1e6, -1e6, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("c")).withColumn("rank", F.lit(0)).withColumn("exact", F.lit(0))
    found = vectors.top_k(df, F.col("vec_id") % 100 == 0, block_vectors=blocks[0], block_queries=blocks[1])
    assert sorted(map(tuple, found.collect())) == _nearest(rows)
    assert vectors.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_queries_come_in_passes_and_are_not_multiplied_by_shares(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(0, 900, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for size in (None, 100):
        if size:
            monkeypatch.setattr(vectors, "PASS_BYTES", size)
        found = vectors.top_k(df, F.col("vec_id") % 100 == 0, block_vectors=16, block_queries=1)
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, found.collect())) == _nearest(rows)


def test_bounds_hold_for_every_cell():
    rng = np.random.default_rng(0)
    exact = rng.integers(-5000, 5000, (300, 8))
    cells, low, width = vectors.cells_of(exact)
    assert ((low + cells * width <= exact) & (exact <= low + cells * width + width - 1)).all()
    queries, ids = rng.integers(-900, 900, (5, 8)), np.arange(300)
    for (best, scores), q in zip(vectors.search_block(queries, np.array([3, 4, 5, 900, 901]), ids, exact, cells, low, width, 7), queries, strict=True):
        assert (exact[best] @ q == scores).all() and (np.diff(scores) <= 0).all()


def test_op8_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in QUERIES["op8_quality"](spark, folder).collect()}
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in rows.items())
    marked = [(rows[r["doc_id"]]["predicted"], r["quality"]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    assert np.mean([a == b for a, b in marked]) > 0.95


def test_the_risk_stays_non_negative_and_learns_from_positives_alone():
    rng = np.random.default_rng(0)
    good, bad = np.zeros((400, quality.SIZE), np.float32), np.zeros((150, quality.SIZE), np.float32)
    good[:, 0], bad[:, 1] = 1, 1
    mixed = np.vstack([good[:350], bad])
    model = quality.minimise(good[rng.permutation(400)[:200]], mixed, 0.7)
    assert 1 / (1 + np.exp(-(good[0] @ model.weights + model.bias))) > 0.9
    assert 1 / (1 + np.exp(-(bad[0] @ model.weights + model.bias))) < 0.1


def _plain_features(text):
    """The features of a text anew, as a mapping from number to value."""
    kind = lambda c: "a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else "x" if c.isalpha() else c
    words, lines, found = text.split(), text.split("\n"), {}
    for w in words:
        shape = "".join(k if k in "aA9x" else k * len(list(g)) for k, g in itertools.groupby(map(kind, w)))
        place = zlib.crc32(shape.encode()) % quality.SHAPES
        found[place] = found.get(place, 0) + 1 / len(words)
    n, size = max(1, len(words)), max(1, len(text))
    triples = list(zip(words, words[1:], words[2:], strict=False))
    values = [1 - len(set(lines)) / len(lines), 1 - len(set(triples)) / len(triples) if triples else 0, min(1, len(set(words)) / n * (n / 1000) ** 0.15), sum(w.isupper() for w in words) / n,
              sum(c in "0123456789" for c in text) / size, sum(c in "!*$%&#@|{}<>=_~^+\\" for c in text) / size, sum(map(len, words)) / n, len(words)]
    at = quality.SHAPES
    for (_, bounds), value in zip(quality.MEASURES, values, strict=True):
        found[at + sum(b <= value for b in bounds)] = 1
        at += len(bounds) + 1
    return found


def test_op8_scores_by_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()} | {-1: "", -2: "日本" * 300 + "x1" * 30 + "A-b" * 50, -3: "word " * 5 + "\n\n"}
    asked = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in quality.score(asked, model).collect():
        z = sum(model.weights[i] * x for i, x in _plain_features(texts[r["doc_id"]]).items()) + model.bias
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-4


def test_shapes_read_the_whole_word():
    ends = ["a1" * 30 + end for end in ("b", "-", "B")]
    assert len({quality._shape(w) for w in ends}) == 3 and quality._shape("a" * 1000 + "Z") == quality._shape("bZ")


@pytest.mark.parametrize("prior", [0.2, 0.9])
def test_gradient_by_differences(prior):
    rng = np.random.default_rng(1)
    positive, unlabelled = rng.random((30, 6)).astype(np.float32), rng.random((50, 6)).astype(np.float32)
    for scale in (0.3, 4):
        w = rng.normal(0, scale, 7).astype(np.float32).astype(float)

        def bracket(w):
            return np.logaddexp(0, unlabelled @ w[:-1] + w[-1]).mean() - prior * np.logaddexp(0, positive @ w[:-1] + w[-1]).mean()

        def risk(w):
            return prior * np.logaddexp(0, -(positive @ w[:-1] + w[-1])).mean() + bracket(w)

        aim = risk if bracket(w) >= 0 else lambda w: -bracket(w)
        steps = [(aim(w + d) - aim(w - d)) / 2e-3 for d in np.eye(7) * 1e-3]
        assert np.allclose(quality.gradient(w, positive, unlabelled, prior), steps, atol=1e-3)


def test_classifier_takes_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "word " * 100_000), (3, "a b")], "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("__score", F.lit(0.0))
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (None, 1), (99, 1), (3, None), (3, 7)], "doc_id long, quality int")
    for marks in (labels, labels.limit(0)):
        model = quality.fit(docs, marks)
        rows = quality.score(docs, model, keep=["doc_id"]).collect()
        assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert model.prior == 0.5
    kept = quality.keep_good(docs, model, least=0.0)
    assert kept.dtypes == docs.dtypes and kept.count() == 5
    model = quality.fit(docs.limit(0), labels)
    assert quality.score(docs.limit(0), model).count() == 0 and np.isfinite(model.bias)


def test_pipeline_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "simhash near-dedup", "best-fit packing"]
    model = quality.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    good = [r for r in docs.collect() if model.scores([r["text"]])[0] >= corpus_pipeline.LEAST_QUALITY]
    largest = {}
    for r in good:
        largest[r["text"]] = max(r["doc_id"], largest.get(r["text"], -1))
    kept = {r["doc_id"]: r["text"] for r in good if largest[r["text"]] == r["doc_id"]}

    from test_near_copies import _expected

    left, links = _expected(sorted(kept.items()))
    assert links
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"] for r in rows} == set(left)
    assert {r["doc_id"]: r["length"] for r in rows if r["piece"] == 0}.keys() == set(left)


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, FOLDER)
        assert made.columns == docs.columns and made.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == 0
