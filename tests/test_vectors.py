"""Nearest neighbours, gate, search and encoders against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwatch.functions.vectors import cosine_distance, unit
from lotwatch.operators import embedding, inverted, neighbours
from lotwatch.plans.star_queries import QUERIES


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    corpus = rng.normal(size=(300, 16)).astype("float32")
    corpus[200:] = corpus[0]  # a third of the corpus are copies
    corpus[5] = 0
    return corpus, rng.normal(size=(11, 16)).astype("float32")


def brute(corpus, queries, k, skip=None):
    norm = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) > 0, np.linalg.norm(m, axis=1, keepdims=True), 1)
    distance = np.round(1 - norm(queries.astype(float)) @ norm(corpus.astype(float)).T, 9)
    found = set()
    for q, row in enumerate(distance):
        order = sorted((d, i) for i, d in enumerate(row) if skip is None or i != skip[q])[:k]
        found |= {(q, i, rank) for rank, (_, i) in enumerate(order, 1)}
    return found


def frames(spark, corpus, queries):
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "id long, embedding array<float>").repartition(7)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, embedding array<float>")
    return c, q


@pytest.mark.parametrize("block", [4096, 4])
@pytest.mark.parametrize("k", [1, 5, 120])
def test_exact_neighbours(spark, vectors, k, block):
    c, q = frames(spark, *vectors)
    hits = neighbours.nearest_neighbours(c, q, k, block=block)
    assert {(r.query_id, r.id, r.rank) for r in hits.collect()} == brute(*vectors, k)


def test_a_query_does_not_find_itself(spark, vectors):
    corpus, _ = vectors
    c, q = frames(spark, corpus, corpus[:20])
    hits = neighbours.nearest_neighbours(c, q, 3, own_id=F.col("query_id"))
    assert {(r.query_id, r.id, r.rank) for r in hits.collect()} == brute(corpus, corpus[:20], 3, list(range(20)))


def test_gate_is_inclusive_and_context_keeps_rank_order(spark):
    hits = spark.createDataFrame([(1, 9, 0.2, 2, "far"), (1, 8, 0.1, 1, "near"), (1, 7, 0.21, 3, "out"), (2, 9, 0.5, 1, "far")],
                                 "query_id long, id long, distance double, rank int, document string")
    gate = {r.query_id: (r.n_relevant, r.decision) for r in neighbours.gate(hits).collect()}
    assert gate == {1: (2, "answer"), 2: (0, "refuse")}
    assert [(r.query_id, r.context) for r in neighbours.context_per_query(hits).collect()] == [(1, "near\n---\nfar")]


def test_search_over_embedded_texts(spark):
    texts = ["дрони для розвідки", "медичні матеріали", "генератор дизельний", "дрони FPV"]
    corpus = spark.createDataFrame([(str(i), t, f'{{"tender_number":"UA-{i}","title":"{t}"}}') for i, t in enumerate(texts)], "id string, document string, metadata string")
    corpus = corpus.withColumn("embedding", embedding.embed_passages(F.col("document")))
    queries = spark.createDataFrame([("q", "дрони для розвідки"), ("z", "весілля")], "query_id string, text string")
    queries = queries.select("query_id", embedding.embed_queries(F.col("text")).alias("embedding"))
    got = {r.query_id: r for r in neighbours.semantic_search(corpus, queries, "u/", k=2).collect()}
    assert got["q"].decision == "answer" and got["q"].context == texts[0]
    assert got["q"].sources == "  - [UA-0](u/UA-0) (dist=0.0000): дрони для розвідки"
    assert got["z"].decision == "refuse" and got["z"].context is None


def test_encoder_is_exchangeable_and_output_has_unit_length(spark):
    class Lengths:
        def __call__(self, texts):
            return np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([("ab",), ("",), (None,)], "t string")
    rows = df.select("t", embedding.embed(F.col("t"), Lengths, prefix="p:").alias("e")).collect()
    assert all(abs(np.linalg.norm(r.e) - 1) < 1e-6 for r in rows)
    assert rows[0].e[0] / rows[0].e[1] == pytest.approx(4, rel=1e-6)
    assert df.limit(1).select(embedding.embed(F.col("t")).alias("e")).first().e.count(0.0) == embedding.DEFAULT_DIM - 1


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    rows = df.select(unit(F.col("a")).alias("u"), cosine_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert rows[0].u == pytest.approx([0.6, 0.8]) and rows[0].d == pytest.approx(0.04)
    assert rows[1].u == [0.0, 0.0] and rows[1].d is None


@pytest.mark.parametrize("own", [False, True])
def test_approximate_neighbours_of_all_lists_are_exact(spark, vectors, own):
    corpus, queries = vectors
    queries = np.vstack([corpus[:20], np.zeros((1, 16), "float32")] if own else [queries, np.zeros((1, 16), "float32")])
    c, q = frames(spark, corpus, queries)
    hits = inverted.approximate_neighbours(c, q, 5, own_id=F.col("query_id") if own else None, probes=10**6)
    assert {(r.query_id, r.id, r.rank) for r in hits.collect()} == brute(corpus, queries, 5, list(range(21)) if own else None)


def test_approximate_neighbours_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.1]), (4, None), (5, []), (6, [float("nan"), 1.0]), (7, [1.0]), (8, [None, 1.0])]
    c = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0]), (3, None), (4, [1.0, 2.0, 3.0])], "query_id long, embedding array<double>")
    hits = inverted.approximate_neighbours(c, q, 2, probes=10)
    assert sorted((r.query_id, r["rank"], r.id) for r in hits.collect()) == [(1, 1, 1), (1, 2, 3), (2, 1, 7)]
    for some, others in ((c.limit(0), q), (c, q.limit(0))):
        assert inverted.approximate_neighbours(some, others, 2).count() == 0


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_of_approximate_neighbours(spark, folder):
    c = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    q = c.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.id) for r in neighbours.nearest_neighbours(c, q, 5, own_id=F.col("query_id")).collect()}
    near = QUERIES["vector_knn_approx"](spark, f"/root/testdata/{folder}").collect()
    found = {(r.query_id, r.id) for r in near}
    print(folder, "recall", len(exact & found) / len(exact))
    assert len(found) == len(exact) and len(exact & found) >= 0.9 * len(exact)


def test_lists_grow_with_the_corpus_and_few_are_read_where_vectors_cluster(spark):
    rng = np.random.default_rng(5)
    sizes, read = [], []
    for n in (400, 1600):
        centres = rng.normal(size=(n // 20, 16))
        corpus = (np.repeat(centres, 20, axis=0) + 0.05 * rng.normal(size=(n, 16))).astype("float32")
        index = inverted.build_index(frames(spark, corpus, corpus[:1])[0], 5)
        cells, lists = inverted.lists_to_read(index, 5)
        sizes.append(index.n_lists)
        read.append(lists / index.n_lists)
        assert index.members.select("id").distinct().count() == n
    assert sizes[1] > 1.7 * sizes[0] and max(read) < 0.3
