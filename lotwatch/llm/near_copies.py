"""Near-duplicates of a Jaccard similarity of word shingles, with candidates from SimHash and min-hash bands.

Each text has a SimHash fingerprint of its shingles' hashes, and the links of
at most three bits, which ``simhash`` finds, are the first candidates: a text
is compared with the first one of its SimHash component.  Such links hold few
of the pairs whose five-word shingles are 0.8 alike, so others follow: a text's
signature is the least of its shingles' hashes under ``BANDS * ROWS``
permutations, and texts meet where all rows of a band agree.  At the bound of
0.8, 0.9996 of the pairs meet; more above it.

Links only have to connect, so the texts of a meeting are first tried against
its leader: the one that meets most others, which for copies of one original
is the original.  A trial first asks for enough equal places of the signatures,
kept as one byte each (at 0.8: for 66 of 100, three and a half standard
deviations below what is expected), then compares the whole sets of shingles
exactly.

Texts that are left in different components but meet with likely signatures
form clusters, and each cluster's texts are compared whole, all that are in
different components, within the tasks: what leaves a task is a star of links,
never its pairs.  A meeting of more than ``MEET`` such texts is dealt into finer
bands, across the former ones, before; meetings and clusters that are still
larger are compared in pairs of blocks of that size by different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwatch.llm.rows import map_column
from lotwatch.llm.simhash import SEED, components, links, majority
from lotwatch.session import stored

WIDTH = 5
LEAST = 0.8
BANDS, ROWS = 20, 5
PLACES = BANDS * ROWS
# Share of equal signature places, relative to the similarity asked for, from which a pair is compared whole.
LIKELY = 0.825
# Texts compared with each other in one task, and pairs of one text that a task compares whole.
MEET, TRIALS = 512, 256

_random = np.random.default_rng(SEED)
FACTOR = _random.integers(0, 2**64, PLACES, np.uint64) | np.uint64(1)
TERM = _random.integers(0, 2**64, PLACES, np.uint64)


def hashes_of(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of a text's shingles, repeats included.

    Words are runs without ASCII white space, A-Z lower-cased.  A text of
    fewer than ``width`` words, or of none, is one shingle.
    """
    words = (text or "").encode().lower().split()
    hash_of = xxhash.xxh64_intdigest
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    return np.fromiter((hash_of(s, SEED) for s in shingles), np.uint64)


def signatures(texts: list, width: int = WIDTH) -> np.ndarray:
    """The least of each text's shingle hashes under each permutation, as 32 bits."""
    return _signatures_of([hashes_of(t, width) for t in texts])


def _signatures_of(parts: list[np.ndarray]) -> np.ndarray:
    starts = np.cumsum([0, *map(len, parts[:-1])])
    hashes = np.concatenate(parts)
    least = [np.minimum.reduceat(hashes * a + b, starts) for a, b in zip(FACTOR, TERM, strict=True)]
    return (np.stack(least, axis=1) >> np.uint64(32)).astype(np.uint32)


def band_keys(signed: np.ndarray) -> np.ndarray:
    """One number per text and band, of the band and its rows."""
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(signed), 1))
    rows = signed.astype(np.uint64).reshape(-1, BANDS, ROWS)
    for r in range(ROWS):
        key = (key ^ rows[:, :, r]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _signed(rows: DataFrame, width: int) -> DataFrame:
    """``row``, ``sign`` (a byte per place), ``keys``, ``fingerprint`` of ``row``, ``text``."""

    def make(texts: list) -> list:
        if not texts:
            return [[], [], []]
        parts = [hashes_of(t, width) for t in texts]
        full = _signatures_of(parts)
        prints = np.array([majority(p) for p in parts], np.uint64).view(np.int64)
        return [[s.tobytes() for s in full.astype(np.uint8)], list(band_keys(full)), prints]

    kinds = {"sign": (T.BinaryType(), pa.binary()), "keys": (T.ArrayType(T.LongType()), pa.list_(pa.int64())), "fingerprint": (T.LongType(), pa.int64())}
    return map_column(rows.select("row", "text"), "text", make, kinds)


def _by_simhash(signed: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of the first row of each SimHash component with its other rows."""
    different = stored(signed.groupBy("fingerprint").agg(F.min("row").alias("least")), "fingerprints")
    stars = components(links(different.select("fingerprint")))
    named = stored(
        different.join(stars, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")), "roots"
    )
    leaders = named.join(named.groupBy("root").agg(F.min("least").alias("a")), "root").select("fingerprint", "a")
    return signed.select("row", "fingerprint").join(leaders, "fingerprint").filter("row <> a").select("a", F.col("row").alias("b"))


def _meetings(signed: DataFrame) -> DataFrame:
    """``key``, ``row`` of the keys that several rows have, with ``n``, how many."""
    each = signed.select(F.explode("keys").alias("key"), "row")
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return each.join(shared, "key")


def _led(met: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of each row with the leaders of its meetings."""
    often = met.groupBy("row").agg(F.sum("n").alias("often"))
    leaders = met.join(often, "row").groupBy("key").agg(F.max_by("row", F.struct("often", "row")).alias("a"))
    return met.join(leaders, "key").filter("row <> a").select("a", F.col("row").alias("b"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal places of each signature of ``x`` with each of ``y``."""
    return (x[:, None, :] == y[None, :, :]).sum(axis=2)


def _likely(pairs: DataFrame, signed: DataFrame, least: float) -> DataFrame:
    """The pairs whose signatures are alike enough."""
    enough = int(LIKELY * least * PLACES)
    both = pairs.join(signed.select(F.col("row").alias("a"), F.col("sign").alias("x")), "a").join(
        signed.select(F.col("row").alias("b"), F.col("sign").alias("y")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PLACES) for c in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= enough))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _whole(width: int, least: float):
    """Of rows sorted by hub, part and role, the pairs of the hub (role 0) with those it is similar to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for name, role, row, text in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), strict=True):
                found = np.unique(hashes_of(text.as_py(), width))
                if role == 0:
                    hub, own = name, found
                elif name == hub:
                    common = len(np.intersect1d(own, found, assume_unique=True))
                    if common >= least * (len(own) + len(found) - common) - 1e-9:
                        a.append(hub)
                        b.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _linked(pairs: DataFrame, rows: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs whose whole sets of shingles are similar enough.

    Pairs gather at the end that has more of them; its text moves once per
    ``TRIALS`` of them, the other ends' once a pair.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("row")).groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    counted = pairs.join(ends.select(F.col("row").alias("a"), F.col("n").alias("n_a")), "a").join(ends.select(F.col("row").alias("b"), F.col("n").alias("n_b")), "b")
    first = F.col("n_a") >= F.col("n_b")
    parts = F.ceil(F.greatest("n_a", "n_b") / TRIALS)
    dealt = counted.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("row"), parts.alias("parts"))
    dealt = stored(dealt.select("hub", F.pmod(F.xxhash64("row"), "parts").alias("part"), "row"), "trials")
    wanted = dealt.select("hub", "part", F.lit(1).alias("role"), "row").unionByName(dealt.select("hub", "part", F.lit(0).alias("role"), F.col("hub").alias("row")).distinct())
    moved = wanted.hint("merge").join(rows.select("row", "text"), "row").repartition("hub", "part").sortWithinPartitions("hub", "part", "role", "row")
    return moved.select("hub", "role", "row", "text").mapInArrow(_whole(width, least), "a long, b long")


def _least_reached(fits: np.ndarray) -> np.ndarray:
    """For each place, the smallest place that a chain of fitting pairs (a symmetric matrix) leads to."""
    label = np.arange(len(fits))
    while True:
        reached = np.minimum(label, np.where(fits, label[None, :], len(label)).min(axis=1, initial=len(label)))
        reached = reached[reached]
        if (reached == label).all():
            return label
        label = reached


def _stars(row: np.ndarray, fits: np.ndarray) -> pa.RecordBatch:
    label = _least_reached(fits)
    moved = label != np.arange(len(label))
    return pa.RecordBatch.from_arrays([pa.array(row[label[moved]]), pa.array(row[moved])], names=["a", "b"])


def _by_cell(stars_of):
    """Runs over rows sorted by their first two columns; each run is a cell, given to ``stars_of`` as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            cells = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            edges = [0, *(i for i in range(1, len(cells)) if cells[i] != cells[i - 1]), len(cells)]
            for a, b in zip(edges, edges[1:], strict=False):
                if b > a:
                    if held and cells[a] != last:
                        yield stars_of(pa.Table.from_batches(held))
                        held = []
                    held.append(batch.slice(a, b - a))
                    last = cells[a]
        if held:
            yield stars_of(pa.Table.from_batches(held))

    return run


def _apart(cell: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a cell, and which pairs of them are of different roots."""
    row, root = (cell.column(c).to_numpy() for c in ("row", "root"))
    return row, root[:, None] != root[None, :]


def _likely_stars(least: float):
    """Stars over the pairs of different roots in a cell whose signatures are alike enough."""
    enough = int(LIKELY * least * PLACES)

    def stars_of(cell: pa.Table) -> pa.RecordBatch:
        row, apart = _apart(cell)
        if apart.any():
            sign = np.frombuffer(b"".join(cell.column("sign").to_pylist()), np.uint8).reshape(-1, PLACES)
            for i in range(0, len(row), 128):
                apart[i : i + 128] &= _alike(sign[i : i + 128], sign) >= enough
        return _stars(row, apart)

    return _by_cell(stars_of)


def common_shingles(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many shingles each set has in common with each other one: products of some columns at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, (found, column) = owner[shared], np.unique(column[shared], return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.diag([float(len(s)) for s in sets])
    off = ~np.eye(len(sets), dtype=bool)
    for start in range(0, len(found), columns):
        a, b = np.searchsorted(column, (start, start + columns))
        part = np.zeros((len(sets), min(columns, len(found) - start)), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        common += (part @ part.T) * off
    return common


def _exact_stars(width: int, least: float):
    """Stars over the pairs of different roots in a cell whose whole sets of shingles are similar enough."""

    def stars_of(cell: pa.Table) -> pa.RecordBatch:
        row, apart = _apart(cell)
        sets = [np.unique(hashes_of(t.as_py(), width)) for t in cell.column("text")]
        common, size = common_shingles(sets), np.array([len(s) for s in sets])
        return _stars(row, apart & (common >= least * (size[:, None] + size[None, :] - common) - 1e-9))

    return _by_cell(stars_of)


def _several(named: DataFrame) -> DataFrame:
    """The meetings of ``key``, ``row``, ``root`` that more than one component takes part in, with ``left``, their rows."""
    open_keys = named.groupBy("key").agg(F.count(F.lit(1)).alias("left"), F.min("root").alias("one"), F.max("root").alias("other")).filter("left > 1 AND one <> other")
    return named.join(open_keys.select("key", "left"), "key")


def _dealt(rows: DataFrame, group: str, block: Column) -> DataFrame:
    """Rows of ``group`` by pairs of its blocks: ``group``, ``cell`` (a struct) and the other columns."""
    named = rows.withColumn("block", block)
    blocks = named.select(group, "block").distinct()
    pairs = blocks.join(blocks.select(group, F.col("block").alias("other")), group).filter("block <= other")
    # Rows of one large component need no cell of their own.
    pairs = pairs.filter("block.root IS NULL OR other.root IS NULL OR block.root <> other.root")
    cells = pairs.withColumn("cell", F.struct("block", "other"))
    ends = cells.select(group, "cell", F.explode(F.array_distinct(F.array("block", "other"))).alias("block"))
    return named.join(ends, [group, "block"]).drop("block")


def _unconnected(met: DataFrame, roots: DataFrame, signed: DataFrame, least: float) -> DataFrame:
    """Stars ``a``, ``b`` over the likely pairs of one meeting and different components."""
    # Pairs that met alone have been tried.
    named = met.filter("n > 2").join(roots, F.col("row") == F.col("node"), "left").select("key", "row", F.coalesce("root", "row").alias("root"))
    left = stored(_several(named).join(signed.select("row", "sign"), "row"), "unconnected")
    # A row of several large meetings is dealt once.
    bands = [F.xxhash64(F.lit(j), *(F.substring("sign", 1 + j + BANDS * r, 1) for r in range(ROWS))) for j in range(BANDS)]
    large = left.filter(F.col("left") > MEET).select("row", "root", "sign").distinct().select(F.explode(F.array(*bands)).alias("key"), "row", "root")
    finer = _several(large).join(signed.select("row", "sign"), "row")
    every = left.filter(F.col("left") <= MEET).unionByName(finer)
    dealt = _dealt(every, "key", _block("left"))
    cells = dealt.select("key", F.xxhash64("cell").alias("cell"), "row", "root", "sign").repartition("key", "cell").sortWithinPartitions("key", "cell", "row")
    return cells.mapInArrow(_likely_stars(least), "a long, b long").distinct()


def _block(count: str) -> Column:
    """Of rows with ``root`` in a group of ``count``: their block, of ``MEET`` rows or so."""
    return F.struct(F.lit(None).cast("long").alias("root"), F.pmod(F.xxhash64("row"), F.ceil(F.col(count) / MEET)).alias("part"))


def _across(stars: DataFrame, roots: DataFrame, rows: DataFrame, width: int, least: float) -> DataFrame:
    """Links between rows of different components within a likely cluster.

    The blocks of a cluster meet two by two; those of one large component do
    not, so what it costs goes by the rows that are in no large component.
    """
    clusters = components(stars, "a", "b")
    members = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("row"), F.col("root").alias("cluster"))
    named = members.join(roots, F.col("row") == F.col("node"), "left").select("row", "cluster", F.coalesce("root", "row").alias("root"))
    sizes = named.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n"))
    small = sizes.groupBy("cluster").agg(F.sum(F.when(F.col("n") <= MEET, F.col("n")).otherwise(0)).alias("small"))
    counted = stored(named.join(sizes, ["cluster", "root"]).join(small, "cluster"), "clusters")
    large = F.col("n") > MEET
    parts = F.ceil(F.when(large, F.col("n")).otherwise(F.col("small")) / MEET)
    block = F.struct(F.when(large, F.col("root")).alias("root"), F.pmod(F.xxhash64(F.when(large, F.col("row")).otherwise(F.col("root"))), parts).alias("part"))
    dealt = _dealt(counted, "cluster", block).select("cluster", F.xxhash64("cell").alias("cell"), "row", "root")
    cells = dealt.hint("merge").join(rows.select("row", "text"), "row").repartition("cluster", "cell").sortWithinPartitions("cluster", "cell", "row")
    return cells.select("cluster", "cell", "row", "root", "text").mapInArrow(_exact_stars(width, least), "a long, b long")


def similar_rows(rows: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """Stars ``node``, ``root`` of rows (``row`` long, ``text``) that links of similarity ``least`` or more connect."""
    signed = stored(_signed(rows, width), "signed")
    met = stored(_meetings(signed), "met")
    near = stored(_by_simhash(signed), "pairs")
    # Texts that meet no other need not move again.
    meeting = met.select("row").union(near.select("a")).union(near.select("b")).distinct()
    close = stored(rows.select("row", "text").hint("merge").join(meeting, "row", "left_semi"), "close")
    tried = stored(_likely(_ordered(near.unionByName(_led(met))), signed, least), "pairs")
    linked = stored(_linked(tried, close, width, least), "links")
    roots = stored(components(linked, "a", "b"), "roots")
    nodes = stored(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "nodes")
    stars = stored(_unconnected(met, nodes, signed, least), "pairs")
    more = stored(_across(stars, nodes, close, width, least), "links")
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "a", "b")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents with one left of each component: that with the smallest key.

    Rows without a key take part and stay only where their component has none
    with a key; of equal keys, or of none, the one whose text has the smallest
    hash stays.
    """
    numbered = stored(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    rows = numbered.select("row", F.col(f"doc.`{text}`").alias("text"))
    roots = stored(similar_rows(rows, **how), "roots")
    nodes = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    name = F.col(f"doc.`{key}`")
    order = F.struct(name.isNull().alias("none"), name.alias("key"), F.xxhash64(F.col(f"doc.`{text}`")).alias("hash"), "row")
    ranked = stored(numbered.select("row", order.alias("order")).join(nodes, F.col("row") == F.col("node")).select("row", "root", "order"), "ranked")
    first = ranked.groupBy("root").agg(F.min("order").alias("first"))
    going = stored(ranked.join(first, "root").filter("row <> first.row").select("row"), "going")
    return numbered.join(going, "row", "left_anti").select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
