"""Row-wise Python stages over Arrow batches, and small helpers the operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Python works through a batch in slices of about so many characters or bytes.
SLICE_BYTES = 4_000_000


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive slices of about ``limit`` bytes of a column; a longer value is alone."""
    start = held = 0
    for i, size in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if i > start and held + (size or 0) > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size or 0
    if start < batch.num_rows:
        yield batch.slice(start)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession, limit: int = 2 * SLICE_BYTES) -> Iterator[None]:
    """What is computed inside sends Arrow batches of about ``limit`` bytes, unless the session names a limit itself.

    With rows of megabytes a task fills Spark's 64 MB, outside the heap, and
    while it grows its buffers there are three times as many.
    """
    if spark.conf.get(BATCH_BYTES, None) is not None:
        yield
        return
    spark.conf.set(BATCH_BYTES, str(limit))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_BYTES)


def give_back() -> None:
    """Hand what this worker has freed to the system; its allocators would keep it while other workers need room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    # Not every C library can.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_remembered: dict[str, Callable[[], None]] = {}


def remembering(name: str, forget: Callable[[], None]) -> None:
    """A Python worker is used by one operator after another: what it remembers for others than ``name`` goes.

    Within an operator it stays from task to task.  Only memory depends on it, no result.
    """
    others = [n for n in _remembered if n != name]
    for other in others:
        _remembered.pop(other)()
    if others:
        give_back()
    _remembered[name] = forget


def map_column(
    df: DataFrame,
    column: str,
    make: Callable[[list], list[Sequence]],
    outputs: dict[str, tuple[T.DataType, pa.DataType]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Replace ``column`` by columns that Python computes from it, slice by slice.

    ``make`` takes the values of a slice and returns one sequence per output.
    Columns named in ``keep`` (all others, if not given) pass through; where
    one has the name of an output, the output replaces it.
    """
    carried = [c for c in (df.columns if keep is None else keep) if c != column and c not in outputs]
    source = df.select(*(F.col(f"`{c}`") for c in carried), F.col(f"`{column}`").alias("__in"))
    fields = [source.schema[c] for c in carried]
    schema = T.StructType([*fields, *(T.StructField(n, spark_type) for n, (spark_type, _) in outputs.items())])
    names, kinds = list(outputs), [arrow for _, arrow in outputs.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = len(carried)
        for batch in batches:
            for part in slices(batch, at):
                made = make(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:at], *(pa.array(m, k) for m, k in zip(made, kinds, strict=True))], names=[*carried, *names]
                )

    return source.mapInArrow(run, schema)
