"""Nearest neighbours by cosine distance, relevance gate, context, calibration.

Queries and corpus stay in the executors: both are packed into blocks, every
query block meets every corpus block, and NumPy multiplies a pair.  A task keeps
the best ``k`` of each query over all its pairs, so what is shuffled grows with
tasks and queries, never with the number of pairs.  ``inverted.py`` has the
approximate search.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lotwatch import fixed_values as fixed
from lotwatch.functions.text import escape_markdown, markdown_link
from lotwatch.operators.groups import exact_quantiles
from lotwatch.operators.versions import first_rows
from lotwatch.session import stored

# Vectors of a packed block.
QUERY_BLOCK, CORPUS_BLOCK = 512, 4096
# Copies of a vector get equal distances wherever they sit in a block.
DISTANCE_DECIMALS = 9


def usable(vector: Column) -> Column:
    """Vectors with at least one component and none missing or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def unit_rows(vectors) -> np.ndarray:
    matrix = np.asarray(vectors, dtype="float64")
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(lengths > 0, lengths, 1.0)


def packed(rows: DataFrame, size: int, names: Sequence[str]) -> DataFrame:
    """Blocks of rows (``vector`` and ``names``) that share ``part`` and dimension; ids stay arrays.

    A block goes out when it is full or another part begins, so of rows sorted
    by part a task holds one part's.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("dim", T.IntegerType()), *(T.StructField(n, T.ArrayType(kinds[n])) for n in names), T.StructField("matrix", T.BinaryType())]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], list[tuple]] = {}

        def block(key: tuple[int, int], held: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32())]
            columns += [pa.array([[h[i] for h in held]], pa.list_(arrow[n])) for i, n in enumerate(names)]
            matrix = unit_rows([h[-1] for h in held])
            return pa.RecordBatch.from_arrays([*columns, pa.array([matrix.tobytes()], pa.binary())], names=schema.names)

        arrow: dict[str, pa.DataType] = {}
        last = None
        for batch in batches:
            arrow = {n: batch.schema.field(n).type for n in names}
            columns = [batch.column(n).to_pylist() for n in ("part", *names)]
            # A vector stays an array: as a list it would take four times the room.
            vectors = (v.values.to_numpy(zero_copy_only=False).copy() for v in batch.column("vector"))
            for part, *rest in zip(*columns, vectors, strict=True):
                if part != last:
                    for old, held in waiting.items():
                        yield block(old, held)
                    waiting, last = {}, part
                key = (part, len(rest[-1]))
                held = waiting.setdefault(key, [])
                held.append(tuple(rest))
                if len(held) == size:
                    yield block(key, waiting.pop(key))
        for key, held in waiting.items():
            yield block(key, held)

    return rows.select("part", *names, "vector").mapInArrow(pack, schema)


def _search(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best ``k`` rows of the packed corpus per query, over the pairs of blocks that share ``part`` and ``share``."""
    id_type = corpus.schema["id"].dataType.elementType
    query_type = queries.schema["query_id"].dataType.elementType
    schema = T.StructType([T.StructField("query_id", query_type), T.StructField("id", id_type), T.StructField("distance", T.DoubleType())])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, pd.DataFrame] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                asked = np.frombuffer(row["q_matrix"], "float64").reshape(-1, row["dim"])
                held = np.frombuffer(row["matrix"], "float64").reshape(-1, row["dim"])
                distance = np.round(1.0 - held @ asked.T, DISTANCE_DECIMALS)
                ids = np.array(row["id"], dtype=object)
                # Own ids are looked up once a pair of blocks.
                owned: dict = {}
                for column, own in enumerate(row["own_id"]):
                    if own is not None:
                        owned.setdefault(own, []).append(column)
                if owned:
                    for at, one in enumerate(row["id"]):
                        if one in owned:
                            distance[at, owned[one]] = np.inf
                # Everything at least as near as the k-th, so that ties reach the ranking.
                bound = np.partition(distance, k - 1, axis=0)[k - 1] if len(ids) > k else np.full(distance.shape[1], np.inf)
                at, columns = np.nonzero((distance <= bound) & np.isfinite(distance))
                near = pd.DataFrame({"place": columns, "id": ids[at], "distance": distance[at, columns]})
                # A query block is told from others by its vectors and ids.
                key = (row["q_matrix"], tuple(row["query_id"]))
                if key in best:
                    near = pd.concat([best[key], near])
                near = near.sort_values(["place", "distance", "id"]).groupby("place").head(k)
                best[key] = near
        for (_, query_ids), near in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([query_ids[p] for p in near["place"]], kinds[0]), pa.array(near["id"].tolist(), kinds[1]), pa.array(near["distance"], pa.float64())],
                names=["query_id", "id", "distance"],
            )

    kinds = [to_arrow_type(query_type), to_arrow_type(id_type)]
    asked = queries.withColumnRenamed("matrix", "q_matrix")
    return corpus.join(asked, ["part", "dim", "share"]).mapInArrow(nearest, schema)


def nearest_neighbours(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = fixed.TOP_K,
    corpus_id: str = "id",
    vector: str = "embedding",
    query_id: str = "query_id",
    own_id: Column | None = None,
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """The ``k`` nearest corpus rows per query: ``query_id, id, distance, rank``.

    Exact, and the same way at every size.  Ties in distance go to the smaller
    id.  ``own_id`` names, per query, a corpus row that is not to be found (the
    query itself).  Vectors that are null, empty or not finite take no part on
    either side; see :func:`without_vector` for the queries left out.
    """
    rows = corpus_rows(corpus, corpus_id, vector).withColumn("part", F.lit(0))
    asked = query_rows(corpus, queries, corpus_id, vector, query_id, own_id).withColumn("part", F.lit(0))
    return _ranked(rows, asked, k, block)


def corpus_rows(corpus: DataFrame, corpus_id: str, vector: str) -> DataFrame:
    return corpus.filter(usable(F.col(vector))).select(F.col(corpus_id).alias("id"), F.col(vector).cast("array<double>").alias("vector"))


def query_rows(corpus: DataFrame, queries: DataFrame, corpus_id: str, vector: str, query_id: str, own_id: Column | None) -> DataFrame:
    own = F.lit(None).cast(corpus.schema[corpus_id].dataType) if own_id is None else own_id
    wanted = queries.select(F.col(query_id).alias("query_id"), own.cast(corpus.schema[corpus_id].dataType).alias("own_id"), F.col(vector).cast("array<double>").alias("vector"))
    return wanted.filter(usable(F.col("vector")))


def _ranked(rows: DataFrame, asked: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    spark = rows.sparkSession
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Corpus blocks are dealt over the shares of a part; every query block of the part goes to all of them.
    blocks = stored(packed(rows, CORPUS_BLOCK, ["id"]), "corpus").withColumn("share", F.pmod(F.xxhash64("matrix"), F.lit(shares)).cast("int"))
    questions = stored(packed(asked, block, ["query_id", "own_id"]), "queries").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    near = _search(blocks, questions, k)
    return first_rows(near, ["query_id"], [F.col("distance"), F.col("id")], k)


def without_vector(queries: DataFrame, vector: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """The queries that no search can answer, by id."""
    return queries.filter(~usable(F.col(vector))).select(F.col(query_id).alias("query_id"))


def hit_rows(hits: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The corpus rows behind the hits."""
    return rows.join(hits, key)


def relevant_hits(hits: DataFrame, threshold: float = fixed.RELEVANCE_THRESHOLD) -> DataFrame:
    """Hits at most ``threshold`` away."""
    return hits.filter(F.col("distance") <= threshold)


def gate(hits: DataFrame, threshold: float = fixed.RELEVANCE_THRESHOLD) -> DataFrame:
    """Per query: closest distance, number of relevant hits, ``answer`` or ``refuse``."""
    near = F.count_if(F.col("distance") <= threshold)
    return (
        hits.groupBy("query_id")
        .agg(F.min("distance").alias("closest"), near.alias("n_relevant"))
        .withColumn("decision", F.when(F.col("n_relevant") > 0, F.lit("answer")).otherwise(F.lit("refuse")))
    )


def context_per_query(
    hits: DataFrame, threshold: float = fixed.RELEVANCE_THRESHOLD, document: str = "document", separator: str = fixed.CONTEXT_SEPARATOR
) -> DataFrame:
    """Texts of the relevant hits of each query, joined in rank order.

    A query has at most ``k`` hits, so the collected list is short.
    """
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col(document).alias("text"))))
    return relevant_hits(hits, threshold).groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda h: h["text"]), separator).alias("context")
    )


def source_line(record_id: Column, distance: Column, title: Column, base_url: str) -> Column:
    label = F.coalesce(markdown_link(record_id, base_url), F.lit("?"))
    shown = F.translate(F.format_number(distance, 4), ",", "")
    return F.concat(F.lit("  - "), label, F.lit(" (dist="), shown, F.lit("): "), escape_markdown(F.coalesce(title, F.lit("?"))))


def semantic_search(
    corpus: DataFrame,
    queries: DataFrame,
    base_url: str,
    k: int = fixed.TOP_K,
    threshold: float = fixed.RELEVANCE_THRESHOLD,
    record_id: str = "tender_number",
    title: str = "title",
) -> DataFrame:
    """Search report per query: decision, closest distance, context, source lines.

    ``corpus`` is a vector table whose ``metadata`` JSON names record and title.
    """
    # As tables their sizes are known: few hits need not move every text.
    found = stored(nearest_neighbours(corpus, queries, k), "found")
    details = corpus.select(
        "id",
        "document",
        F.get_json_object("metadata", f"$.{record_id}").alias("record_id"),
        F.get_json_object("metadata", f"$.{title}").alias("record_title"),
    )
    # Computed once; context and sources read it again.
    hits = stored(details.join(found, "id"), "hits")
    line = source_line(F.col("record_id"), F.col("distance"), F.col("record_title"), base_url)
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("text"))))
    sources = relevant_hits(hits, threshold).groupBy("query_id").agg(
        F.array_join(F.transform(lines, lambda h: h["text"]), "\n").alias("sources")
    )
    return (
        gate(found, threshold)
        .join(context_per_query(hits, threshold), "query_id", "left")
        .join(sources, "query_id", "left")
    )


def threshold_calibration(hits: DataFrame, is_match: Column, thresholds: Sequence[float]) -> DataFrame:
    """Precision and recall of the gate at each threshold, over labelled hits."""
    judged = hits.select("distance", is_match.alias("is_match"))
    levels = judged.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    passed = F.col("distance") <= F.col("threshold")
    return (
        levels.groupBy("threshold")
        .agg(
            F.count_if(passed & F.col("is_match")).alias("true_hits"),
            F.count_if(passed & ~F.col("is_match")).alias("false_hits"),
            F.count_if(F.col("is_match")).alias("all_matches"),
        )
        .withColumn("precision", F.try_divide(F.col("true_hits"), F.col("true_hits") + F.col("false_hits")))
        .withColumn("recall", F.try_divide(F.col("true_hits"), F.col("all_matches")))
    )


PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def distance_profile(hits: DataFrame, is_match: Column, percentiles: Sequence[float] = PERCENTILES) -> DataFrame:
    """Spread of distances for matching and non-matching probes; percentiles are exact and interpolated.

    The percentiles are selected by counting cells, so no task holds the
    distances of a class.  Hits of which it is unknown whether they match are left out.
    """
    judged = stored(hits.select(is_match.alias("is_match"), "distance").filter(F.col("is_match").isNotNull()), "judged")
    spread = judged.groupBy("is_match").agg(
        F.count(F.lit(1)).alias("n_hits"), F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance"), F.avg("distance").alias("avg_distance")
    )
    shares = {f"p{round(100 * p):02d}": p for p in percentiles}
    return spread.join(exact_quantiles(judged, ["is_match"], "distance", shares).drop("n_values"), "is_match", "left")
