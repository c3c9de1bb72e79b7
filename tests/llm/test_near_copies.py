"""The pipeline's near-duplicate stage against all pairs compared by brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lotwatch.llm import near_copies


def _shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def _expected(rows):
    """Keys that stay, where null keys come last."""
    sets = [_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = []
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 5 * common >= 4 * len(sets[i] | sets[j]):
                pairs.append(common / len(sets[i] | sets[j]))
                root[find(i)] = find(j)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(key)
    return sorted(min((k for k in g if k is not None), default=-1) for g in groups.values()), pairs


def _corpus(seed, short):
    """Copies with a few words changed, chains of them, a line that many share, and texts without a key."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(5000)}"
    line = [word() for _ in range(12)]
    rows = []
    for _ in range(60):
        base = [word() for _ in range(rnd.randrange(20, 60 if short else 400))] + line * rnd.randrange(2)
        rows.append(base)
        for _ in range(rnd.randrange(4)):
            base = list(base)
            for _ in range(rnd.randrange(1, max(2, len(base) // 40))):
                base[rnd.randrange(len(base))] = word()
            rows.append(base)
    hub = [word() for _ in range(100)]
    for _ in range(60):
        near = list(hub)
        for _ in range(rnd.randrange(3)):
            near[rnd.randrange(100)] = word()
        rows.append(near)
    texts = [" ".join(r) for r in rows] + ["", None, " ", "one two", "One  TWO", "three"]
    rnd.shuffle(texts)
    return [(None if i % 9 == 0 else i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("short", [True, False])
def test_every_link_of_similarity_0_8_is_found(spark, short):
    rows = _corpus(7 + short, short)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).repartition(5)
    want, pairs = _expected(rows)
    assert sum(0.8 <= p < 0.95 for p in pairs) > 100
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.dtypes == docs.dtypes
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == want
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def test_recall_by_similarity(spark):
    """Pairs of all similarities from 0.8 on: of those that nothing else connects, how many are found."""
    rnd = random.Random(3)
    rows, pairs = [], {}
    for i in range(600):
        base = [f"w{rnd.randrange(9000)}" for _ in range(rnd.randrange(60, 300))]
        near = list(base)
        for _ in range(rnd.randrange(1, max(2, len(base) // 40))):
            near[rnd.randrange(len(base))] = f"w{rnd.randrange(9000)}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
        x, y = _shingles(rows[-2][1]), _shingles(rows[-1][1])
        pairs[2 * i] = len(x & y) / len(x | y)
    found = near_copies.similar_rows(spark.createDataFrame(rows, "row long, text string").repartition(4)).collect()
    found = {min(r["node"], r["root"]) for r in found}
    assert all(pairs[i] >= 0.8 for i in found)
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.01)):
        band = [i for i, p in pairs.items() if low <= p < high]
        assert len(band) > 20 and sum(i in found for i in band) >= 0.98 * len(band)


def test_large_meetings_are_split(spark, monkeypatch):
    """Blocks and finer bands find what one comparison of all finds."""
    rows = _corpus(11, True)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = _expected(rows)[0]
    monkeypatch.setattr(near_copies, "MEET", 7)
    monkeypatch.setattr(near_copies, "TRIALS", 3)
    kept = near_copies.keep_one(docs)
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == want


def test_a_very_long_text(spark):
    rnd = random.Random(5)
    words = [f"w{rnd.randrange(50_000)}" for _ in range(200_000)]
    near = words[:-9000] + [f"v{k}" for k in range(9000)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[:150_000])), (4, "w1 w2")]
    assert {r["doc_id"] for r in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1, 3, 4}


def test_cells_that_cross_batches():
    rng = np.random.default_rng(1)
    cell = np.sort(rng.integers(0, 9, 60))
    sign = rng.integers(0, 2, (3, near_copies.PLACES), np.uint8)[rng.integers(0, 3, 60)]
    root = rng.integers(0, 4, 60)
    names = ["key", "cell", "row", "root", "sign"]
    columns = [pa.array(c) for c in (cell, np.zeros(60, np.int64), np.arange(60), root, [s.tobytes() for s in sign])]
    fits = np.array([[cell[i] == cell[j] and root[i] != root[j] and (sign[i] == sign[j]).sum() >= 66 for j in range(60)] for i in range(60)])
    label = list(range(60))
    for _ in range(60):
        label = [min([label[i], *(label[j] for j in np.flatnonzero(fits[i]))]) for i in range(60)]
    want = {(label[i], i) for i in range(60) if label[i] != i}
    for n in (1, 3, 7, 60):
        cut = iter([pa.RecordBatch.from_arrays([c.slice(a, n) for c in columns], names=names) for a in range(0, 60, n)])
        made = [p for b in near_copies._likely_stars(0.8)(cut) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert set(made) == want and want


def test_common_shingles():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 90, rng.integers(0, 60)).astype(np.uint64)) for _ in range(25)]
    want = [[len(set(x.tolist()) & set(y.tolist())) for y in sets] for x in sets]
    for columns in (1, 7, 4096):
        assert (near_copies.common_shingles(sets, columns) == want).all()
