"""Best-fit packing of token pieces into sequences of bounded length.

Packing is hierarchical.  Partitions of items are packed best-fit (longest
first) by one task each, and nearly full bins are final.  The underfull bins
that are left go up a tree as items: the bins of eight tasks meet in one task
for the next best-fit round, until one task has seen what is left.

Two bins can share a sequence only if one of them is at most half full, and a
best-fit round leaves at most one such bin.  So a task hands up its half-empty
bin and no more others than there are half-empty bins in all: what moves is
bounded by the number of tasks, and no possible merge is lost.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lotwatch.llm.bpe import tree_encoder
from lotwatch.llm.rows import SLICE_BYTES, give_back, remembering, slices
from lotwatch.session import stored

# Parts of texts an encoding worker remembers; it has a core to itself, so more than a chain of workers may.
REMEMBERED_PARTS = 500_000
# After other stages an executor's JVM has grown and leaves its workers less room.
REMEMBERED_AFTER_STAGES = 50_000
# Bytes of text encoded at once for each part that may be remembered; the more, the fewer look-ups of parts.
TEXT_PER_PART = 24
# Items packed by one task of the first round: about 100 MB with what they carry.
ITEMS_PER_TASK = 250_000
# Tasks whose bins meet in the next round.
FAN_IN = 8
# Bins with no more room than this are final at once.
NEARLY_FULL = 16


def token_pieces(
    df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, text: str = "text", keep: Sequence[str] | None = None,
    remembered: int = REMEMBERED_PARTS,
) -> DataFrame:
    """Token ids of each text and ``end_id``, cut into pieces of at most ``capacity``.

    Adds ``piece`` (from 0), ``start`` (ids of the document before it),
    ``length`` and ``ids`` (binary, unsigned 32-bit, little-endian).  Only
    longer documents are cut, and only their first piece may be shorter.  A
    null or empty text is the end id alone.  Repeated rows give repeated
    pieces; columns in ``keep`` (all but the text, if not given) stay, save
    those named like an output.  ``remembered`` bounds memory only.
    """
    outputs = ["piece", "start", "length", "ids"]
    carried = [c for c in (df.columns if keep is None else keep) if c != text and c not in outputs]
    source = df.select(*(F.col(f"`{c}`") for c in carried), F.col(f"`{text}`").alias("__in"))
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.BinaryType()]
    schema = T.StructType([*(source.schema[c] for c in carried), *map(T.StructField, outputs, kinds)])
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembering("bpe", tree_encoder.cache_clear)
        encoder = tree_encoder(path, remembered)
        for batch in batches:
            for part in slices(batch, len(carried), max(SLICE_BYTES, TEXT_PER_PART * remembered)):
                ids = encoder.encode(part.column(len(carried)), end)
                ends = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1).astype(np.int64) // 4
                n = np.diff(ends)
                counts = -(-n // capacity)
                rows = np.arange(len(n)).repeat(counts)
                pieces = np.arange(len(rows)) - (np.cumsum(counts) - counts).repeat(counts)
                firsts = (n - (counts - 1) * capacity)[rows]
                starts = np.where(pieces > 0, firsts + (pieces - 1) * capacity, 0)
                # Pieces lie one after another in the ids of their documents.
                cuts = np.append(ends[rows] + starts, ends[-1]) * 4
                parts = pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(cuts.astype(np.int32)), ids.buffers()[2]])
                at = pa.array(rows)
                made = [pa.array(x, pa.int64()) for x in (pieces, starts, np.where(pieces > 0, capacity, firsts))]
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in part.columns[:-1]), *made, parts], names=[*carried, *outputs])
        give_back()

    return source.mapInArrow(run, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, longest first into the fullest bin that has room; and the number of bins."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has just room r
    n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room, n = n, capacity, n + 1
        bins[i], offsets[i] = b, capacity - room
        room -= size
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins, offsets, n


def _pack_partition(carried: Sequence[str], length: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        sizes = table.column(length).to_numpy()
        if sizes.max(initial=0) > capacity:
            raise ValueError(f"an item of {sizes.max()} does not fit into {capacity}")
        bins, offsets, n = best_fit(sizes, capacity)
        fill = np.bincount(bins, sizes, n).astype(np.int64)
        task = TaskContext.get().partitionId()
        table = table.select(list(carried))
        for name, column in (("__bin", bins + (task << 40)), ("__offset", offsets), ("__fill", fill[bins]), ("__task", np.full(len(bins), task))):
            table = table.append_column(name, pa.array(column, pa.int64()))
        yield from table.to_batches(max_chunksize=50_000)

    return run


def _merge_group(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__bin", ignore_index=True)
        own = pdf["__bin"].to_numpy()
        bins, offsets, n = best_fit(pdf["__fill"].to_numpy(), capacity)
        # A merged bin takes the name of the item that lies first in it.
        name = np.zeros(n, np.int64)
        name[bins[offsets == 0]] = own[offsets == 0]
        fill = np.bincount(bins, pdf["__fill"], n).astype(np.int64)
        return pd.DataFrame({"__bin": own, "__into": name[bins], "__base": offsets, "__total": fill[bins], "__task": pdf["__group"]})

    return run


def pack(df: DataFrame, length: str = "length", capacity: int = 2048, items_per_task: int = ITEMS_PER_TASK, fan_in: int = FAN_IN, nearly_full: int = NEARLY_FULL) -> DataFrame:
    """Add ``sequence_id`` and ``offset``: a place for each item in as few sequences as best-fit finds.

    Sequences have no gaps and at most ``capacity``.  Items whose length is
    null or not positive take no place (null in both columns); one longer than
    ``capacity`` is an error.  Equal and repeated rows are items of their own.
    Columns of ``df`` named like the outputs are replaced.
    """
    spark = df.sparkSession
    carried = [c for c in df.columns if c not in ("sequence_id", "offset")]
    # Read twice: once to be counted, once to be packed.
    items = stored(df.select(*(F.col(f"`{c}`") for c in carried)), "pieces")
    size = F.col(f"`{length}`")
    sized = items.filter(size > 0)
    n_tasks = -(-sized.count() // items_per_task) or 1
    schema = T.StructType([*items.schema.fields, *(T.StructField(c, T.LongType()) for c in ("__bin", "__offset", "__fill", "__task"))])
    packed = sized.withColumn(length, size.cast("long")) if dict(items.dtypes)[length] != "bigint" else sized
    schema[length].dataType = T.LongType()
    placed = stored(packed.repartition(n_tasks).mapInArrow(_pack_partition(carried, length, capacity), schema), "placed")

    moves = None
    level = placed.filter(F.col("__fill") < capacity - nearly_full).groupBy("__bin").agg(F.first("__fill").alias("__fill"), F.first("__task").alias("__task"))
    while n_tasks > 1:
        level = stored(level, "bins")
        half_empty = level.filter(F.col("__fill") <= capacity // 2).count()
        by_room = Window.partitionBy("__task").orderBy("__fill", "__bin")
        going = level.withColumn("__rank", F.row_number().over(by_room)).filter(F.col("__rank") <= half_empty + 1)
        n_tasks = -(-n_tasks // fan_in)
        merged = stored(
            going.withColumn("__group", F.expr(f"__task div {fan_in}"))
            .groupBy("__group")
            .applyInPandas(_merge_group(capacity), "__bin long, __into long, __base long, __total long, __task long"),
            "merged",
        )
        moved = merged.filter("__bin <> __into").select("__bin", "__into", "__base")
        if moves is None:
            moves = moved
        else:
            then = moved.select(F.col("__bin").alias("__into"), F.col("__into").alias("__last"), F.col("__base").alias("__more"))
            moves = (
                moves.join(then, "__into", "left")
                .select("__bin", F.coalesce("__last", "__into").alias("__into"), (F.col("__base") + F.coalesce("__more", F.lit(0))).alias("__base"))
                .unionByName(moved.join(moves.select("__bin"), "__bin", "left_anti"))
            )
        level = (
            merged.filter((F.col("__bin") == F.col("__into")) & (F.col("__total") < capacity - nearly_full))
            .select("__bin", F.col("__total").alias("__fill"), "__task")
        )

    kept = [F.col(f"`{c}`") for c in carried]
    if moves is None:
        done = placed.select(*kept, F.col("__bin").alias("sequence_id"), F.col("__offset").alias("offset"))
    else:
        done = placed.join(moves, "__bin", "left").select(
            *kept, F.coalesce("__into", "__bin").alias("sequence_id"), (F.col("__offset") + F.coalesce("__base", F.lit(0))).alias("offset")
        )
    none = F.lit(None).cast("long")
    unsized = items.filter(size.isNull() | (size <= 0)).withColumn(length, size.cast("long"))
    return done.unionByName(unsized.select(*kept, none.alias("sequence_id"), none.alias("offset")))


def packed_sequences(pieces: DataFrame, ids: str = "ids") -> DataFrame:
    """The ids of each sequence of packed pieces, in order: ``sequence_id``, ``n_ids``, ``ids``.

    A sequence's pieces are bounded by its capacity.  Pieces without a place are left out.
    """
    placed = pieces.filter(F.col("sequence_id").isNotNull())
    parts = F.sort_array(F.collect_list(F.struct(F.col("offset"), F.hex(F.col(f"`{ids}`")).alias("h"))))
    joined = placed.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(parts, lambda x: x["h"]), "")).alias("ids"))
    return joined.select("sequence_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), "ids")
