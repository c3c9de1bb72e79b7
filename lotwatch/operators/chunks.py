"""Cutting long texts at line ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwatch import fixed_values as fixed

# Python holds the pieces of texts of about so many bytes at a time.
SLICE_BYTES = 4_000_000


def _slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive slices of about ``limit`` bytes of a column; a longer value is alone."""
    start = held = 0
    for i, size in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def _cut(text: str, limit: int) -> list[str]:
    """Pieces of at most ``limit`` characters.

    Each piece ends at the last line end within the limit, unless that would
    waste more than half of it.  Line ends at the start of a later piece go.
    """
    pieces = []
    start = 0
    while len(text) - start > limit:
        end = text.rfind("\n", start, start + limit)
        if end - start < limit // 2:
            end = start + limit
        pieces.append(text[start:end])
        start = end
        while start < len(text) and text[start] == "\n":
            start += 1
    pieces.append(text[start:])
    return pieces


def split_texts(df: DataFrame, text: str = "text", limit: int = fixed.MESSAGE_LIMIT) -> DataFrame:
    """One row per piece: the other columns, ``position`` from zero, ``piece``.

    Texts within the limit never leave the JVM; only longer ones go to Python.
    They are cut there slice by slice, so a worker never holds a whole batch's pieces.
    A null text is one null piece.
    """
    others = [c for c in df.columns if c != text]
    at = len(others)
    schema = T.StructType([*(df.schema[c] for c in others), T.StructField("position", T.IntegerType()), T.StructField("piece", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, at, SLICE_BYTES):
                pieces = [_cut(t, limit) for t in part.column(at).to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(pieces)), [len(p) for p in pieces]))
                carried = [c.take(rows) for c in part.columns[:at]]
                position = pa.array([i for p in pieces for i in range(len(p))], pa.int32())
                yield pa.RecordBatch.from_arrays([*carried, position, pa.array([x for p in pieces for x in p], pa.string())], names=schema.names)

    size = F.length(text)
    short = df.filter((size <= limit) | size.isNull()).select(*others, F.lit(0).alias("position"), F.col(text).alias("piece"))
    long = df.filter(size > limit).select(*others, text).mapInArrow(cut, schema)
    return short.unionByName(long)
