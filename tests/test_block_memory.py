"""Packing sorted rows holds one list at a time."""

import inspect

import numpy as np

from lotwatch.operators import inverted, neighbours


def test_blocks_end_with_their_part(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, i // 7, rnd.normal(size=4 + (i % 7 == 3)).tolist()) for i in range(70)]
    df = spark.createDataFrame(rows, "id long, part int, vector array<double>").coalesce(1).sortWithinPartitions("part")
    blocks = neighbours.packed(df, 512, ["id"]).collect()
    assert [b["part"] for b in blocks] == sorted(b["part"] for b in blocks)
    found = {i: v for b in blocks for i, v in zip(b["id"], np.frombuffer(b["matrix"]).reshape(-1, b["dim"]), strict=True)}
    assert len(found) == 70 and all(np.allclose(found[i], neighbours.unit_rows([v])[0]) for i, _, v in rows)
    assert "sortWithinPartitions" in inspect.getsource(inverted.search)
