"""Exact top-k inner products by a vector-approximation file.

Vectors lie in blocks, each with two parts: cells, one byte per component, and
the exact integers.  A query block meets a vector block; the cells give bounds
on all its scores.  Exact vectors are then read in order of their best possible
score, until the kth exact score is no lower than what the next one can reach.

Vector blocks stay where they are stored and queries come to them, as many in
one pass as a bounded number of bytes holds.  A task keeps the k best of each
query from block to block, so that later blocks read fewer exact vectors, and
passes on k rows per query.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotwatch.session import stored

BLOCK_VECTORS = 4096
BLOCK_QUERIES = 512
# Exact vectors read per query and step.
STEP = 32
# Bound of memory only: of the queries that are sent to all tasks in one pass, with what a task keeps of them.
PASS_BYTES = 32_000_000


def usable(vector: Column) -> Column:
    """Vectors that are not null or empty and hold only finite numbers."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & good, F.lit(False))


def scaled(vector: Column, scale: int = 1024) -> Column:
    """Each component as floor(scale * x), computed in double."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def cells_of(exact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of a block's vectors, and per component the lowest value and the cells' width."""
    low = exact.min(axis=0)
    width = np.maximum(1, -(-(exact.max(axis=0) - low + 1) // 256))
    return ((exact - low) // width).astype(np.uint8), low, width


def search_block(
    queries: np.ndarray, own: np.ndarray, ids: np.ndarray, exact: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray, k: int, step: int = STEP, least: np.ndarray | None = None
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions and scores of each query's k best vectors of a block, its own (by id) left out.

    ``ids`` ascend, so the earlier of two equal scores has the smaller id.
    Vectors that cannot reach ``least``, a score of each query, may be left out.
    """
    q = queries.astype(np.float64)
    # A component of cell c lies in [low + c * width, low + c * width + width - 1].
    reach = (q * width) @ cells.T.astype(np.float64)
    most = q @ low.astype(np.float64) + np.maximum(q * (width - 1), 0).sum(axis=1)
    # Rounding of the sums must not cut anything off.
    most += 1e-9 * (np.abs(q) @ (np.abs(low) + 256.0 * width)) + 1
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
    asking = np.arange(len(q)) if least is None else np.flatnonzero(reach.max(axis=1) + most >= least)
    for i in asking.tolist():
        bound = reach[i] + most[i]
        may = ids != own[i]
        if least is not None:
            may &= bound >= least[i]
        order = np.flatnonzero(may)
        order = order[np.argsort(-bound[order], kind="stable")]
        best, scores = found[i]
        for a in range(0, len(order), step):
            if len(best) == k and bound[order[a]] < scores[-1]:
                break
            read = order[a : a + step]
            best = np.concatenate([best, read])
            scores = np.concatenate([scores, exact[read] @ queries[i]])
            top = np.lexsort((best, -scores))[:k]
            best, scores = best[top], scores[top]
        found[i] = best, scores
    return found


class Nearest:
    """The k best vectors so far of some queries of one dimension, over all blocks they have met."""

    def __init__(self, own: np.ndarray, queries: np.ndarray, k: int):
        self.own, self.queries, self.k = own, queries, k
        self.ids, self.scores = np.zeros((2, len(own), k), np.int64)
        self.held = np.zeros(len(own), np.int64)
        # The kth score, once there are k.
        self.least = np.full(len(own), -np.inf)

    def meet(self, ids: np.ndarray, *block: np.ndarray, at_once: int) -> None:
        for a in range(0, len(self.own), at_once):
            some = slice(a, a + at_once)
            made = search_block(self.queries[some].astype(np.int64), self.own[some], ids, *block, self.k, least=self.least[some])
            for i, (best, scores) in enumerate(made, a):
                if not len(best):
                    continue
                n = self.held[i]
                both, value = np.concatenate([self.ids[i, :n], ids[best]]), np.concatenate([self.scores[i, :n], scores])
                top = np.lexsort((both, -value))[: self.k]
                self.held[i] = n = len(top)
                self.ids[i, :n], self.scores[i, :n] = both[top], value[top]
                if n == self.k:
                    self.least[i] = value[top[-1]]

    def rows(self, at_once: int) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.own), at_once):
            some = slice(a, a + at_once)
            kept = np.arange(self.k) < self.held[some, None]
            columns = np.repeat(self.own[some], self.held[some]), self.ids[some][kept], self.scores[some][kept]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["query_id", "vec_id", "score"])


def _narrow(exact: np.ndarray) -> np.ndarray:
    """The same integers, as short as they allow."""
    most = max(int(exact.max(initial=0)), -int(exact.min(initial=0)) - 1)
    return exact.astype(next(kind for kind in (np.int16, np.int32, np.int64) if most <= np.iinfo(kind).max))


def _matrix(data: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // (rows * dim)}").reshape(rows, dim)


def _blocks(vectors: DataFrame, size: int, with_cells: bool) -> DataFrame:
    """Vectors (``id``, ``exact``) packed into binary blocks of one dimension each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[int, list[int]]]] = {}

        def block(rows: list[tuple[int, list[int]]]) -> pa.RecordBatch:
            rows.sort()
            ids, exact = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
            parts = [ids, _narrow(exact), *(cells_of(exact) if with_cells else [])]
            return pa.RecordBatch.from_arrays([pa.array([exact.shape[1]], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], names=names)

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = waiting.setdefault(len(x), [])
                rows.append((i, x))
                if len(rows) == size:
                    yield block(waiting.pop(len(x)))
        for rows in waiting.values():
            yield block(rows)

    names = ["dim", "ids", "exact", *(["cells", "low", "width"] if with_cells else [])]
    return vectors.select("id", "exact").mapInArrow(run, ", ".join(["dim int", *(f"{n} binary" for n in names[1:])]))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024, block_vectors: int = BLOCK_VECTORS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: each query's k highest integer inner products.

    All rows are candidates but those with the query's own id; ties go to the
    smaller id.  Vectors that are null or empty or hold a null or non-finite
    component take no part, nor do rows without an id; vectors of another
    length than the query's are none of its candidates.  Fewer than k
    candidates are all returned.  Rows that repeat an id are queries once (by
    the smallest vector) and candidates each.
    """
    name = F.col(f"`{key}`")
    rows = vectors.filter(name.isNotNull() & usable(F.col(f"`{vector}`"))).select(name.cast("long").alias("id"), scaled(F.col(f"`{vector}`"), scale).alias("exact"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = stored(rows, "vectors")
    spark = vectors.sparkSession
    n_vectors, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    # A share of the vectors sends k rows a query: with no more shares than vectors a query, these stay in proportion to the vectors.
    parallel = spark.sparkContext.defaultParallelism
    shares = max(parallel, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n_vectors // max(1, n_queries)))
    blocks = stored(_blocks(rows, block_vectors, True).repartition(shares, F.xxhash64("ids")), "cells")
    asked = rows.filter("asks").groupBy("id").agg(F.min("exact").alias("exact"))
    queries = stored(_blocks(asked, block_queries, False).withColumn("number", F.monotonically_increasing_id()), "queries")
    # One row per block of queries.
    sizes = sorted(map(tuple, queries.select("number", (F.octet_length("ids") / 8 * (F.col("dim") * 8 + 16 * k)).cast("long")).collect()))
    passes: list[list[int]] = []
    held = 0
    for number, size in sizes:
        if not passes or held + size > PASS_BYTES:
            passes.append([])
            held = 0
        passes[-1].append(number)
        held += size
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def nearest(first: int, last: int) -> DataFrame:
        near = _meet(blocks, queries.filter(F.col("number").between(first, last)), k, block_queries)
        return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    if len(passes) <= 1:
        return nearest(passes[0][0], passes[0][-1]) if passes else nearest(0, -1)
    # Each pass is over, and its queries are forgotten, before the next one begins.
    return functools.reduce(DataFrame.union, [stored(nearest(p[0], p[-1]), "nearest") for p in passes])


def _meet(blocks: DataFrame, queries: DataFrame, k: int, at_once: int) -> DataFrame:
    """``query_id``, ``vec_id``, ``score``: of each task, the k best of its vectors for each of the queries, whose bytes its caller bounds."""
    sent = blocks.sparkSession.sparkContext.broadcast([tuple(r) for r in queries.select("dim", "ids", "exact").toArrow().to_pandas().itertuples(index=False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for dim, ids, exact in sent.value:
            own = np.frombuffer(ids, np.int64)
            parts.setdefault(dim, []).append((own, _matrix(exact, len(own), dim)))
        found = {dim: Nearest(*map(np.concatenate, zip(*p, strict=True)), k) for dim, p in parts.items()}
        for batch in batches:
            for i in range(batch.num_rows):
                at = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                dim, ids = at["dim"], np.frombuffer(at["ids"], np.int64)
                if dim in found:
                    exact, cells = _matrix(at["exact"], len(ids), dim).astype(np.int64), np.frombuffer(at["cells"], np.uint8).reshape(-1, dim)
                    found[dim].meet(ids, exact, cells, np.frombuffer(at["low"], np.int64), np.frombuffer(at["width"], np.int64), at_once=at_once)
        for best in found.values():
            yield from best.rows(at_once)

    return blocks.mapInArrow(run, "query_id long, vec_id long, score long")
