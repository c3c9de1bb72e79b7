"""Approximate nearest neighbours by a two-level inverted file that grows with the corpus.

The corpus is split into cells and each cell into lists, four times the square
root of its rows in all; the cells' centres are fitted on a bounded sample, the
lists' centres in one task per cell, so the driver holds about twice the fourth
root of the rows.  A query looks at the lists whose centres are nearest to it.
How many that takes is measured: for a bounded number of corpus rows the exact
neighbours are searched, and as many lists are read as hold the wanted share of them.

Within a list vectors are first compared by codes of one byte per component.
The error of a code is known, so every row that may be among the best is kept
and compared exactly afterwards; only lists that are not read can cost recall.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lotwatch import fixed_values as fixed
from lotwatch.functions.vectors import cosine_distance
from lotwatch.operators.neighbours import DISTANCE_DECIMALS, corpus_rows, nearest_neighbours, packed, query_rows, unit_rows
from lotwatch.operators.versions import first_rows
from lotwatch.session import stored

LISTS_PER_ROOT = 4
# Rows that the centres of the cells are fitted on; those of a cell's lists take so many rows a list.
SAMPLE_ROWS, ROWS_PER_LIST = 20_000, 32
# Rows, about, that meet the centres of their cell's lists in one task, and rows of a block.
TASK_ROWS, QUERY_BLOCK, CODE_BLOCK = 4096, 512, 4096
# Corpus rows that are searched exactly to find how many lists the wanted recall takes.
TRIALS, RECALL = 64, 0.95
LEVELS = 127
# Distances of codes are sums of rounded products.
SLACK = 1e-6


@dataclass(frozen=True)
class Index:
    """An inverted file: ``plan`` and ``centres`` are bounded, the rest are tables in the shared folder."""

    rows: DataFrame  # id, vector
    centres: np.ndarray  # of the cells that have rows
    cells: tuple[int, ...]  # their numbers
    plan: DataFrame  # cell, first (list), lists
    matrices: DataFrame  # cell, dim, matrix: centres of its lists
    members: DataFrame  # cell, part (list), dim, id, code, scale, error
    n_lists: int


def build_index(corpus: DataFrame, k: int = fixed.TOP_K, corpus_id: str = "id", vector: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> Index:
    """Index every usable row of the corpus for searches of ``k`` neighbours; ids are unique.

    Of equal vectors the ``k + 1`` smallest ids are kept: no others can be among
    the best ``k`` of a query, itself left out.  Vectors of another dimension
    than the most frequent one share one list per dimension.
    """
    spark = corpus.sparkSession
    rows = stored(first_rows(corpus_rows(corpus, corpus_id, vector), ["vector"], [F.col("id")], k + 1).drop("rank"), "vectors")
    usual = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim, n = (usual["dim"], usual["count"]) if usual else (0, 0)
    wanted = max(1, round(LISTS_PER_ROOT * math.sqrt(n)))
    sample = rows.filter(F.size("vector") == dim).orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vector").toArrow()
    flat = np.concatenate([np.zeros(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in sample.column("vector").chunks)])
    centres = _centroids(flat.reshape(-1, max(1, dim)), max(1, round(math.sqrt(wanted))))

    dealt = stored(rows.withColumn("cell", _nearest_cells(centres, range(len(centres)), 1)[0]), "dealt")
    sizes = _per_cell(dealt)
    planned, first = [], 0
    for cell, size in sorted(sizes.items()):
        lists = max(1, math.ceil(wanted * size / max(1, n)))
        planned.append((cell, first, lists, min(1.0, ROWS_PER_LIST * lists / size)))
        first += lists
    plan = spark.createDataFrame(planned, "cell int, first int, lists int, chosen double")
    place = F.pmod(F.xxhash64("id", F.lit("lists")), F.lit(1 << 30)) / F.lit(1 << 30)
    fitted = dealt.filter(F.size("vector") == dim).join(F.broadcast(plan), "cell").filter(place < F.col("chosen"))

    def fit(held: pd.DataFrame) -> pd.DataFrame:
        found = _centroids(unit_rows(held.sort_values("id")["vector"].tolist()), int(held["lists"].iloc[0]))
        return pd.DataFrame({"cell": [held["cell"].iloc[0]], "dim": [found.shape[1]], "matrix": [found.tobytes()]})

    matrices = stored(fitted.select("cell", "lists", "id", "vector").groupBy("cell").applyInPandas(fit, "cell int, dim int, matrix binary"), "lists")
    alive = [c for c in range(len(centres)) if c in sizes]
    plan = plan.drop("chosen")
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in ("cell", "part", "dim")] + [
        rows.schema["id"], T.StructField("code", T.BinaryType()), T.StructField("scale", T.DoubleType()), T.StructField("error", T.DoubleType())
    ])
    coded = _meet(dealt, "id", sizes, plan, matrices, _assign, schema)
    return Index(rows, centres[alive], tuple(alive), plan, matrices, stored(coded, "members"), first)


def approximate_neighbours(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = fixed.TOP_K,
    corpus_id: str = "id",
    vector: str = "embedding",
    query_id: str = "query_id",
    own_id: Column | None = None,
    recall: float = RECALL,
    probes: int | None = None,
) -> DataFrame:
    """Neighbours from the lists nearest to each query: ``query_id, id, distance, rank``.

    As many lists are read as hold ``recall`` of the neighbours of :data:`TRIALS`
    corpus rows, or ``probes`` of them from all cells; with as many as there
    are, the result is exact.  Query ids are unique.  Vectors that are null,
    empty or not finite take no part on either side.
    """
    index = build_index(corpus, k, corpus_id, vector)
    asked = stored(query_rows(corpus, queries, corpus_id, vector, query_id, own_id), "asked")
    cells, lists = (max(1, len(index.cells)), probes) if probes else lists_to_read(index, k, recall)
    return search(index, asked, k, cells, lists)


def lists_to_read(index: Index, k: int, recall: float = RECALL, trials: int = TRIALS) -> tuple[int, int]:
    """How many cells and how many of their lists hold ``recall`` of the ``k`` neighbours of some corpus rows."""
    asked = index.rows.orderBy(F.xxhash64("id", F.lit("trial")), "id").limit(trials)
    asked = stored(asked.select(F.col("id").alias("query_id"), F.col("id").alias("own_id"), "vector"), "trials")
    exact = nearest_neighbours(index.rows, asked, k, "id", "vector", own_id=F.col("own_id"))
    hits = stored(index.members.select("id", "cell", "part").join(exact.select("query_id", "id"), "id"), "hits")
    n = max(1, len(index.cells))
    cells = asked.select("query_id", F.posexplode(_nearest_cells(index.centres, index.cells, n)).alias("place", "cell"))
    # A trial has at most ``k`` hits, so what the driver takes is bounded.
    seen = [r["place"] for r in hits.join(cells, ["query_id", "cell"], "left").select("place").collect()]
    if not seen:
        return 1, 1
    places = [n - 1 if p is None else p for p in seen]
    width = 1 + int(np.quantile(places, (1 + recall) / 2, method="higher"))
    ranked = _nearest_lists(index, asked, width, index.n_lists)
    ranks = [r["rank"] for r in hits.join(ranked, ["query_id", "part"], "left").select("rank").collect()]
    return width, int(np.quantile([index.n_lists if r is None else r for r in ranks], recall, method="higher"))


def search(index: Index, asked: DataFrame, k: int, cells: int, probes: int) -> DataFrame:
    """The best ``k`` rows per query (``query_id, own_id, vector``) among its nearest ``probes`` lists of its nearest ``cells`` cells."""
    chosen = _nearest_lists(index, asked, cells, probes).select("query_id", "part").join(asked, "query_id")
    # Rebalancing splits the parts of a list that many rows or queries share; sorted, a task packs one list at a time.
    by_list = lambda rows: rows.hint("rebalance", F.col("part")).sortWithinPartitions("part")
    questions = packed(by_list(chosen), QUERY_BLOCK, ["query_id", "own_id"]).withColumnRenamed("matrix", "q_matrix")
    blocks = _code_blocks(by_list(index.members))
    near = stored(_look(blocks.join(questions, ["part", "dim"]), k), "near")
    bound = first_rows(near, ["query_id"], [F.col("upper"), F.col("id")], k).groupBy("query_id").agg(F.max("upper").alias("bound"))
    kept = near.join(bound, "query_id").filter(F.col("lower") <= F.col("bound")).select("query_id", "id")
    both = kept.join(index.rows, "id").join(asked.select("query_id", F.col("vector").alias("asked")), "query_id")
    distance = F.round(F.coalesce(cosine_distance(F.col("vector"), F.col("asked")), F.lit(1.0)), DISTANCE_DECIMALS)
    return first_rows(both.select("query_id", "id", distance.alias("distance")), ["query_id"], [F.col("distance"), F.col("id")], k)


def _centroids(vectors: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """At most ``n`` unit vectors, by k-means on the sphere."""
    matrix = unit_rows(vectors)
    centres = matrix[:: max(1, len(matrix) // n)][:n].copy()
    for _ in range(rounds):
        member = np.argmax(matrix @ centres.T, axis=1) if len(centres) else np.zeros(0)
        for c in range(len(centres)):
            if (member == c).any():
                centres[c] = unit_rows([matrix[member == c].mean(axis=0)])[0]
    return centres


def _nearest_cells(centres: np.ndarray, names, n: int) -> Column:
    """The ``n`` nearest cells, nearest first; cell 0 for a vector of another dimension."""
    numbers = np.array(list(names), "int32")

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        found = [np.zeros(1, "int32")] * len(vectors)
        at = [i for i, v in enumerate(vectors) if len(numbers) and len(v) == centres.shape[1]]
        if at:
            near = np.argsort(-(unit_rows(np.stack([vectors.iloc[i] for i in at])) @ centres.T), axis=1, kind="stable")
            for i, row in zip(at, near, strict=True):
                found[i] = numbers[row[:n]]
        return pd.Series(found)

    return nearest("vector")


def _per_cell(rows: DataFrame) -> dict[int, int]:
    """Rows per cell; there are about twice the fourth root of the corpus of them."""
    return {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}


def _meet(rows: DataFrame, key: str, sizes: dict[int, int], plan: DataFrame, matrices: DataFrame, work: Callable, schema: T.StructType) -> DataFrame:
    """``work(rows of a cell, centres of its lists)`` in tasks of about :data:`TASK_ROWS` rows each."""
    shares = [(c, math.ceil(n / TASK_ROWS)) for c, n in sizes.items()]
    # One frame a side: the two sides of a cogroup may not share columns.
    mine, theirs = (F.broadcast(rows.sparkSession.createDataFrame(shares, "cell int, shares int")) for _ in range(2))
    left = rows.join(F.broadcast(plan), "cell").join(mine, "cell").withColumn("share", F.pmod(F.xxhash64(key), F.col("shares")))
    right = matrices.join(theirs, "cell").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1).cast("array<bigint>")))
    names = schema.names

    def together(held: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        found = []
        for dim, same in held.groupby(held["vector"].map(len)) if len(held) else ():
            vectors = unit_rows(same["vector"].tolist())
            matrix = np.frombuffer(lists["matrix"].iloc[0], "float64") if len(lists) else np.zeros(0)
            # Vectors of another dimension than the centres go to the cell's first list.
            fits = len(matrix) and lists["dim"].iloc[0] == dim
            likeness = vectors @ matrix.reshape(-1, dim).T if fits else np.ones((len(vectors), 1))
            found.append(work(same, vectors, likeness))
        return pd.concat(found)[names] if found else pd.DataFrame(columns=names)

    return left.groupBy("cell", "share").cogroup(right.groupBy("cell", "share")).applyInPandas(together, schema)


def _assign(held: pd.DataFrame, vectors: np.ndarray, likeness: np.ndarray) -> pd.DataFrame:
    """List and code of each row."""
    scale = np.abs(vectors).max(axis=1) / LEVELS
    codes = np.rint(vectors / np.where(scale > 0, scale, 1.0)[:, None]).astype("int8")
    error = np.linalg.norm(vectors - codes * scale[:, None], axis=1)
    return pd.DataFrame({
        "cell": held["cell"].to_numpy(), "part": held["first"].to_numpy() + likeness.argmax(axis=1), "dim": vectors.shape[1],
        "id": held["id"].to_numpy(), "code": [c.tobytes() for c in codes], "scale": scale, "error": error,
    })


def _nearest_lists(index: Index, asked: DataFrame, cells: int, probes: int) -> DataFrame:
    """``query_id, part, rank``: the ``probes`` nearest lists in the nearest ``cells`` of each query."""
    near = stored(asked.select("query_id", "vector", F.explode(_nearest_cells(index.centres, index.cells, cells)).alias("cell")), "cells")
    schema = T.StructType([asked.schema["query_id"], T.StructField("part", T.IntegerType()), T.StructField("likeness", T.DoubleType())])

    def choose(held: pd.DataFrame, vectors: np.ndarray, likeness: np.ndarray) -> pd.DataFrame:
        best = np.argsort(-likeness, axis=1, kind="stable")[:, :probes]
        row = np.repeat(np.arange(len(held)), best.shape[1])
        return pd.DataFrame({
            "query_id": held["query_id"].to_numpy()[row], "part": held["first"].to_numpy()[row] + best.ravel(), "likeness": likeness[row, best.ravel()]
        })

    lists = _meet(near, "query_id", _per_cell(near), index.plan, index.matrices, choose, schema)
    return first_rows(lists, ["query_id"], [F.desc("likeness"), F.col("part")], probes).drop("likeness")


def _code_blocks(members: DataFrame) -> DataFrame:
    """Members of a list in blocks; of rows sorted by list a task holds one list's."""
    kind = members.schema["id"].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("dim", T.IntegerType()), T.StructField("id", T.ArrayType(kind))]
                          + [T.StructField(c, T.BinaryType()) for c in ("codes", "scales", "errors")])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[tuple[int, int], list[tuple]] = {}

        def block(key: tuple[int, int], held: list[tuple]) -> pd.DataFrame:
            ids, codes, scales, errors = zip(*held, strict=True)
            return pd.DataFrame({"part": [key[0]], "dim": [key[1]], "id": [list(ids)], "codes": [b"".join(codes)],
                                 "scales": [np.array(scales, "float64").tobytes()], "errors": [np.array(errors, "float64").tobytes()]})

        last = None
        for batch in batches:
            for part, dim, *rest in batch.itertuples(index=False, name=None):
                if part != last:
                    for old, held in waiting.items():
                        yield block(old, held)
                    waiting, last = {}, part
                held = waiting.setdefault((part, dim), [])
                held.append(tuple(rest))
                if len(held) == CODE_BLOCK:
                    yield block((part, dim), waiting.pop((part, dim)))
        for key, held in waiting.items():
            yield block(key, held)

    return members.select("part", "dim", "id", "code", "scale", "error").mapInPandas(pack, schema)


def _look(pairs: DataFrame, k: int) -> DataFrame:
    """Rows of a block that may be among the best ``k`` of a query, with bounds of their distance."""
    id_type, query_type = pairs.schema["id"].dataType.elementType, pairs.schema["query_id"].dataType.elementType
    schema = T.StructType([T.StructField("query_id", query_type), T.StructField("id", id_type), T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())])
    kinds = [to_arrow_type(query_type), to_arrow_type(id_type)]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                ids, dim = row["id"], row["dim"]
                asked = np.frombuffer(row["q_matrix"], "float64").reshape(-1, dim)
                codes = np.frombuffer(row["codes"], "int8").reshape(-1, dim).astype("float64")
                distance = 1.0 - (codes @ asked.T) * np.frombuffer(row["scales"], "float64")[:, None]
                error = np.repeat(np.frombuffer(row["errors"], "float64")[:, None] + SLACK, len(asked), axis=1)
                # All are equally far from a zero vector, so the smallest ids are enough.
                order = sorted(range(len(ids)), key=ids.__getitem__)
                for column in np.flatnonzero(~asked.any(axis=1)):
                    error[:, column] = 0.0
                    own = row["own_id"][column]
                    distance[[at for n, at in enumerate(a for a in order if ids[a] != own) if n >= k], column] = np.inf
                owned: dict = {}
                for column, own in enumerate(row["own_id"]):
                    if own is not None:
                        owned.setdefault(own, []).append(column)
                for at, one in enumerate(ids) if owned else ():
                    if one in owned:
                        distance[at, owned[one]] = np.inf
                lower, upper = distance - error, distance + error
                bound = np.partition(upper, k - 1, axis=0)[k - 1] if len(ids) > k else np.full(len(asked), np.inf)
                at, columns = np.nonzero((lower <= bound) & np.isfinite(distance))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["query_id"][c] for c in columns], kinds[0]), pa.array([ids[a] for a in at], kinds[1]),
                     pa.array(lower[at, columns], pa.float64()), pa.array(upper[at, columns], pa.float64())],
                    names=schema.names,
                )

    return pairs.mapInArrow(look, schema)
