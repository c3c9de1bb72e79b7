"""Exact and near copies against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lotwatch.llm import exact_dedup, simhash
from lotwatch.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
ROWS = [
    (1, "same", 1), (2, "same", 1), (2, "same", 1), (3, "other", 2), (4, None, 3), (5, "", 3), (None, "", 3), (None, "nobody", 4), (None, "nobody", 4),
    (7, "long " * 40_000, 5), (8, "long " * 40_000, 5), (9, "Same", 6),
]


def _docs(spark, rows=ROWS):
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string")
    return df.withColumn("keep_id", F.lit("clash")).withColumn("h", F.lit(1.5)).withColumn("fingerprint", F.lit("x"))


@pytest.mark.parametrize("weak", [False, True])
def test_groups_of_equal_texts(spark, weak):
    how = {"hash_text": lambda t: F.pmod(F.length(t), F.lit(2)).cast("long"), "bucket_keys": 1} if weak else {"bucket_keys": 2}
    found = exact_dedup.duplicates(_docs(spark), **how).collect()
    assert len(found) == len(ROWS)
    got = sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in found)
    want = []
    for a, b, _ in ROWS:
        group = [x for x, y, _ in ROWS if (y or "") == (b or "")]
        keep = max((x for x in group if x is not None), default=None)
        want.append((a or 0, keep or 0, len(group), a == keep))
    assert got == sorted(want)


def test_one_of_each_text_stays_with_all_columns(spark):
    docs = _docs(spark)
    kept = exact_dedup.keep_one(docs)
    # Rows come from the index's files, where every column may be null.
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in kept.collect()) == [(0, 6), (2, 4), (3, 5), (5, 0), (8, 200_000), (9, 4)]
    assert exact_dedup.keep_one(docs.limit(0)).count() == 0 == exact_dedup.duplicates(docs.limit(0)).count()


def test_directory_splits_only_overfull_buckets(spark):
    keys = spark.range(4000).select(F.xxhash64("id").alias("h"))
    low = keys.select(F.shiftrightunsigned("h", 3).alias("h"))  # all below one eighth of the space
    for frame in (keys, keys.unionByName(low)):
        rows = exact_dedup.directory(frame, bucket_keys=100, max_depth=16).collect()
        depth = {r["cell"]: (r["depth"], r["bucket"]) for r in rows}
        count = {}
        for r in frame.collect():
            bucket = depth[(r["h"] % (1 << 64)) >> 48][1]
            count[bucket] = count.get(bucket, 0) + 1
        assert max(count.values()) <= 100
        # A bucket and its buddy together were too many for one.
        for cell, (d, bucket) in depth.items():
            parent = cell >> (16 - d + 1)
            assert sum(n for b, n in count.items() if b >> (16 - d + 1) == parent) > 100


def test_documents_are_found_through_the_directory(spark, monkeypatch):
    """A directory that names wrong buckets loses documents."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 100).cast("string")).alias("text"))
    assert exact_dedup.duplicates(docs, bucket_keys=10).count() == 300
    build = exact_dedup.build_index

    def misled(*args, **how):
        index = build(*args, **how)
        return index.withColumn("bucket", F.col("bucket") + 1)

    monkeypatch.setattr(exact_dedup, "build_index", misled)
    assert exact_dedup.duplicates(docs, bucket_keys=10).count() < 300


def test_rows_that_repeat_the_key_that_stays(spark):
    rows = [(7, "a", x) for x in "pqr"] + [(3, "a", "z"), (None, "b", "n"), (None, "b", "m")]
    kept = lambda parts: sorted(map(str, exact_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, x string").repartition(parts)).collect()))
    assert len(kept(1)) == 2 and kept(1) == kept(3) == kept(5)


def test_the_index_has_an_entry_per_text_and_chains_collisions(spark):
    index = exact_dedup.build_index(_docs(spark), hash_text=lambda t: F.lit(7).cast("long"))
    rows = index.collect()
    assert sorted(r["chain"] for r in rows) == list(range(1, 7)) and len({bytes(r["digest"]) for r in rows}) == 6


def _fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _roots(values):
    values = np.array(sorted(set(values)), np.uint64)
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 3) + i + 1:
            root[find(int(j))] = find(i)
    return {int(v): int(values[find(i)]) for i, v in enumerate(values)}


def test_op10(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    prints = {k: _fingerprint(t) for k, t in docs.items()}
    roots = _roots(prints.values())
    least = {}
    for k, f in prints.items():
        least[roots[f]] = min(k, least.get(roots[f], k))
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op10_simhash"](spark, FOLDER).collect()}
    assert found == {k: (f"{f:016x}", least[roots[f]]) for k, f in prints.items()}


@pytest.mark.parametrize("meet", [3, 30, 256])
def test_links_in_dense_clusters(spark, meet):
    rnd = random.Random(meet)
    prints = set()
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(100):
            x = base
            for _ in range(rnd.randint(0, 5)):
                x ^= 1 << rnd.randrange(64)
            prints.add(x)
    signed = {simhash._signed(x): x for x in prints}
    df = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    root = dict(map(tuple, simhash.components(simhash.links(df, meet)).collect()))
    groups, want = {}, {}
    for s, x in signed.items():
        groups.setdefault(root.get(s, s), set()).add(x)
    for x, r in _roots(prints).items():
        want.setdefault(r, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_every_close_pair_has_a_chain_and_a_shared_choice():
    rnd = random.Random(0)
    for _ in range(3000):
        a = rnd.getrandbits(64)
        b = a
        for _ in range(rnd.randint(0, 3)):
            b ^= 1 << rnd.randrange(64)
        pair = np.array([a], np.uint64), np.array([b], np.uint64)
        meets = [c for c, m in enumerate(simhash.COARSE) if a & m == b & m and simhash.linked(*pair, np.array([c // 4]))[0]]
        assert meets and any(a & m == b & m for c in meets for m in simhash.FINE[c])


def test_chains_of_links_make_one_component(spark):
    path = spark.range(1, 300).selectExpr("id as u", "id - 1 as v")
    star = spark.range(1000, 1400).selectExpr("id as u", "5000L as v")
    root = dict(map(tuple, simhash.components(path.unionByName(star)).collect()))
    assert root == {**{i: 0 for i in range(1, 300)}, **{i: 1000 for i in [*range(1001, 1400), 5000]}}


def test_near_copies_with_nulls_repeats_and_no_words(spark):
    docs = _docs(spark, [(1, " ", 0), (2, None, 0), (3, "", 0), (4, "Aa b", 0), (5, "aA B", 0), (5, "aA B", 0), (None, "aa b", 0), (None, "x y z", 0), (6, "É", 0), (7, "é", 0)])
    found = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in simhash.near_duplicates(docs).collect())
    assert found == [(0, 0), (0, 4), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (6, 6), (7, 7)]
    kept = simhash.keep_one(docs)
    assert kept.schema == docs.schema
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 1, 4, 6, 7]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 == simhash.keep_one(docs.limit(0)).count()
