"""What a Python worker keeps when one operator follows another."""

import subprocess
import sys

import corpus_pipeline
from lotwatch.llm import pack

SCRIPT = """
import re
from lotwatch.llm import rows

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

kept = {}
rows.remembering("one", kept.clear)
before = held()
kept.update((f"{i:040d}", bytes(700)) for i in range(150_000))
# A few late values at the top of the heap keep what lies below from being given back unasked.
late = [bytes(1000) for _ in range(1000)]
full = held()
rows.remembering("two", lambda: None)
assert not kept and full - before > 60, (before, full)
assert held() - before < 0.2 * (full - before), (before, full, held())
"""


def test_a_worker_gives_back_what_the_operator_before_it_held():
    subprocess.run([sys.executable, "-c", SCRIPT], check=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0])


def test_packing_after_other_stages_remembers_less(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(corpus_pipeline, "packed", lambda docs, remembered=pack.REMEMBERED_PARTS: asked.append(remembered))
    corpus_pipeline.pack_sequences(spark, None, "")
    assert asked == [pack.REMEMBERED_AFTER_STAGES] and pack.REMEMBERED_AFTER_STAGES <= pack.REMEMBERED_PARTS // 10


def test_pieces_do_not_depend_on_what_is_remembered(spark):
    from lotwatch.llm.queries import BYTE_BPE

    texts = [" ".join(f"w{i * j}" for j in range(40)) for i in range(60)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    few, many = (sorted(pack.token_pieces(df, BYTE_BPE, remembered=n).collect()) for n in (5, 100_000))
    assert few == many and len(few) == len(texts)
