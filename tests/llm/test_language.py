"""Language filters: sets as the reference of the bits, held-out accuracy of the decision."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lotwatch.llm import language
from lotwatch.llm.queries import QUERIES


def _model(sets):
    """Filters of one set of n-gram hashes per language, filled in plain Python."""
    filters = np.zeros((1, language.CELLS), np.uint8)
    for place, grams in enumerate(sets):
        for cells in language.cells_of(np.array(sorted(grams), np.uint64)):
            filters[0, cells] |= np.uint8(1 << place)
    return language.Model.of([f"l{i}" for i in range(len(sets))], filters)


def _grams(text):
    return [g for block in language.grams_of(text) for g in block.tolist()]


def test_n_grams_are_those_of_plain_python():
    for text in ("Ab, cd-éfg!", "x", "", "1 2", "a  b", "straße Ünder", "日本 語"):
        words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
        plain = f" {' '.join(words)} "
        want = [plain[i : i + n] for n in language.ORDERS for i in range(len(plain) - n + 1) if " " not in plain[i + 1 : i + n - 1] and plain[i : i + n] != "  "]
        assert len(_grams(text)) == len(want) and len(set(_grams(text))) == len(set(want))


def test_blocks_do_not_change_the_n_grams(monkeypatch):
    text = " ".join(random.Random(1).choices(["one", "two", "thrée", "4", "fünf"], k=500))
    whole = sorted(_grams(text))
    monkeypatch.setattr(language, "BLOCK", 37)
    assert sorted(_grams(text)) == whole


def test_bits_are_those_of_sets_but_for_the_stated_rate():
    rng = np.random.default_rng(0)
    sets = [set(rng.integers(0, 2**64, 300_000, np.uint64).tolist()) for _ in range(3)]
    model = _model(sets)
    asked = np.concatenate([np.array(sorted(s), np.uint64)[:2000] for s in sets] + [rng.integers(0, 2**64, 100_000, np.uint64)])
    cells = list(language.cells_of(asked))
    has = model.slices[0][cells[0]] & model.slices[0][cells[1]] & model.slices[0][cells[2]]
    for place, grams in enumerate(sets):
        bits = (has >> place & 1).astype(bool)
        true = np.array([g in grams for g in asked.tolist()])
        assert bits[true].all()
        wrong = bits[~true].mean()
        assert 0.01 < model.rates[place] < 0.1 and abs(wrong - model.rates[place]) < 0.004
        corrected = (bits.sum() - len(asked) * model.rates[place]) / (1 - model.rates[place])
        assert abs(corrected - true.sum()) < 400


def test_decision_by_corrected_counts():
    words = {"l0": ["alpha", "beta", "gamma"], "l1": ["uno", "due", "tre"], "l2": ["eins", "zwei", "drei"]}
    model = _model([{g for w in ws for g in _grams(w)} for ws in words.values()])
    for name, ws in words.items():
        got, score = model.predict(" ".join(ws * 5) + " 12!")
        assert got == name and score > 0.5
    assert model.predict("uno due alpha")[0] == "l1"
    for nothing in (None, "", " 12 ?! ", "́"):
        assert model.predict(nothing) == ("und", 0.0)
    assert model.predict("ж") == ("l0", 1 / 3)


def test_op11_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op11_language"](spark, folder).collect()
    given = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(given)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    asked = [r for r in rows if r["held_out"]]
    assert len(asked) > 150 and np.mean([r["lang_pred"] == given[r["doc_id"]]["lang"] for r in asked]) > 0.98


def test_odd_rows_and_many_languages(spark):
    rnd = random.Random(3)
    names = [f"lang{i:02}" for i in range(70)]
    stems = {n: ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for n in names}
    text = lambda n: " ".join(rnd.choices(stems[n], k=40))
    rows = [(i, text(names[i % 70]), names[i % 70]) for i in range(700)]
    rows += [(None, "words of no key", "lang00"), (900, None, "lang01"), (901, "", "lang01"), (902, text("lang05") * 500, None), (3, text("lang03"), "lang03")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("place", F.lit(1)).repartition(4)
    model = language.fit(docs)
    assert model.languages == tuple(names) and model.slices.shape[0] == 2
    made = language.predict(docs, model).collect()
    assert len(made) == len(rows) and sum(r["lang_pred"] == r["lang"] for r in made) >= 690
    odd = {r["doc_id"]: r for r in made}
    assert odd[900]["lang_pred"] == odd[901]["lang_pred"] == "und" and odd[902]["lang_pred"] == "lang05"
    none = language.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert none.languages == () and {r["lang_pred"] for r in language.predict(docs, none).collect()} == {"und"}
    assert language.predict(docs.limit(0), language.fit(docs.limit(0))).count() == 0
    assert len(language.fit(docs, learnt=1).languages) == 70
