"""SimHash links are candidates of the near-duplicate stage by themselves."""

import random

from lotwatch.llm import near_copies, simhash


def test_simhash_links_connect_without_any_band(spark, monkeypatch):
    rnd = random.Random(5)
    texts = []
    for _ in range(20):
        words = [f"w{rnd.randrange(3000)}" for _ in range(500)]
        texts += [" ".join(words), " ".join([*words, "more"])]
    prints = [int(p) for p in simhash.fingerprints_of(texts, 5)]
    expected = {(i, i + 1) for i in range(0, len(texts), 2) if ((prints[i] ^ prints[i + 1]) & (2**64 - 1)).bit_count() <= 3}
    assert len(expected) > 5
    monkeypatch.setattr(near_copies, "_meetings", lambda signed: signed.selectExpr("0L key", "row", "2L n").filter("false"))
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    assert {(r["root"], r["node"]) for r in near_copies.similar_rows(rows).collect()} == expected
