"""Near-duplicates by SimHash fingerprints, with candidates from a pigeonring.

The 64 bits of a fingerprint are four segments in a ring.  If two fingerprints
differ in at most three bits, then from some segment on the differences in one,
two, three and four consecutive segments sum to at most 0, 1, 2 and 3: their
proportional share of the budget.  So the chain's first segment is equal and
the second differs in one of its four nibbles at most.  Fingerprints meet on
the first segment and three nibbles of the second (28 bits, 16 choices), then
on the rest of the chain, and only then are all bits compared.

A choice that more than ``MEET`` different fingerprints share is split by the
same reasoning: of the eight nibbles of the last two segments at most three
differ, so they meet on some five of them as well (48 bits, 56 choices).
Copies have one fingerprint and count once.  What leaves a meeting is not its
pairs but a star from each linked fingerprint to the smallest one it reaches
there, which keeps every link's ends together.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lotwatch.llm.rows import map_column
from lotwatch.session import stored

SEED = 42
MAX_BITS = 3
# Different fingerprints that are compared with each other without a finer split.
MEET = 256


def _nibbles(*places: int) -> int:
    """Mask of nibbles, counted from the highest, around the ring."""
    return sum(0xF << (60 - 4 * (p % 16)) for p in places)


# Choice c starts at segment c // 4 and leaves out nibble c % 4 of the next segment.
COARSE = [_nibbles(*range(4 * s, 4 * s + 4), *(4 * s + 4 + n for n in range(4) if n != left)) for s in range(4) for left in range(4)]
FINE = [[m | _nibbles(*(4 * (c // 4) + 8 + n for n in kept)) for kept in itertools.combinations(range(8), 5)] for c, m in enumerate(COARSE)]
SEGMENT = np.array([_nibbles(*range(4 * s, 4 * s + 4)) for s in range(4)], np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half of some hashes."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 100_000):
        counts += np.unpackbits(hashes[a : a + 100_000].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes)).view(">u8")[0]


def fingerprints_of(texts: Sequence[str | None], width: int = 3) -> np.ndarray:
    """SimHash of each text as int64: a bit is set if it is set in over half of the shingles' hashes.

    Words are runs without ASCII white space, A-Z lower-cased.  A text of
    fewer than ``width`` words is one shingle; one of none has fingerprint 0.
    """
    out = np.zeros(len(texts), np.uint64)
    hash_of = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        if not words:
            continue
        shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
        out[i] = majority(np.fromiter((hash_of(s, SEED) for s in shingles), np.uint64))
    return out.view(np.int64)


def simhash(df: DataFrame, text: str = "text", out: str = "fingerprint", width: int = 3, keep: Sequence[str] | None = None) -> DataFrame:
    """Replace the text by its fingerprint (long).  Null counts as the empty text."""
    return map_column(df, text, lambda texts: [fingerprints_of(texts, width)], {out: (T.LongType(), pa.int64())}, keep)


def linked(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which pairs of unsigned fingerprints keep within the budgets of the chain from segment ``start``, and then of all bits."""
    differing = a ^ b
    total = np.bitwise_count(differing & SEGMENT[start]).astype(np.int16)
    fits = total <= 0
    for step in range(1, 4):
        total += np.bitwise_count(differing & SEGMENT[(start + step) % 4])
        fits &= total <= (step + 1) * MAX_BITS // 4
    return fits & (np.bitwise_count(differing) <= MAX_BITS)


def _stars(values: np.ndarray, start: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """For each value linked here, itself and the smallest value reachable among ``values`` (sorted)."""
    n = len(values)
    label = np.arange(n)
    changed = True
    while changed:
        changed = False
        for a in range(0, n, block):
            for b in range(a, n, block):
                fits = linked(values[a : a + block, None], values[None, b : b + block], start)
                near = np.where(fits, label[None, b : b + block], n).min(axis=1)
                back = np.where(fits, label[a : a + block, None], n).min(axis=0)
                for at, found in ((slice(a, a + block), near), (slice(b, b + block), back)):
                    less = np.minimum(label[at], found)
                    if (less < label[at]).any():
                        label[at] = less
                        changed = True
        if changed:
            label = label[label]
    moved = label != np.arange(n)
    return values[moved], values[label[moved]]


def _links_of_runs(choice: np.ndarray, key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal choice and key; runs of two, nearly all, are compared side by side."""
    edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(choice) != 0)) + 1
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(key)]])
    size = ends - starts
    unsigned = value.view(np.uint64)
    two = starts[size == 2]
    hit = two[linked(unsigned[two], unsigned[two + 1], choice[two] % 16 // 4)]
    left, right = [unsigned[hit + 1]], [unsigned[hit]]
    for a, b in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
        x, y = _stars(unsigned[a:b], int(choice[a]) % 16 // 4)
        left.append(x)
        right.append(y)
    return np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)


def _link_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition sorted by choice, key and fingerprint; a run may cross batches."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
        choice, key, _ = columns
        if not len(key):
            continue
        last = np.flatnonzero((key != key[-1]) | (choice != choice[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        held = [c[cut:] for c in columns]
        if cut:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, _links_of_runs(*(c[:cut] for c in columns)))), names=["u", "v"])
    if held is not None:
        yield pa.RecordBatch.from_arrays(list(map(pa.array, _links_of_runs(*held))), names=["u", "v"])


def _keyed(choice: int, mask: int):
    return F.struct(F.lit(choice).alias("choice"), F.col("fingerprint").bitwiseAND(F.lit(_signed(mask))).alias("key"))


def _meetings(keyed: DataFrame) -> DataFrame:
    """Links of the fingerprints that share a choice and key."""
    together = keyed.repartition("choice", "key").sortWithinPartitions("choice", "key", "fingerprint")
    return together.select("choice", "key", "fingerprint").mapInArrow(_link_sorted, "u long, v long")


def links(fingerprints: DataFrame, meet: int = MEET) -> DataFrame:
    """Stars ``u``, ``v`` that connect just those of the different fingerprints which links connect."""
    coarse = fingerprints.select("fingerprint", F.explode(F.array(*(_keyed(c, m) for c, m in enumerate(COARSE)))).alias("k")).select(
        "k.choice", "k.key", "fingerprint"
    )
    shared = coarse.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = stored(coarse.join(shared, ["choice", "key"]), "meetings")
    # Sixteen rows of masks, whatever the input.
    masks = fingerprints.sparkSession.createDataFrame([(c, [_signed(m) for m in fine]) for c, fine in enumerate(FINE)], "choice int, masks array<long>")
    split = (
        met.filter(F.col("n") > meet)
        .join(F.broadcast(masks), "choice")
        .select("choice", "fingerprint", F.posexplode("masks").alias("part", "mask"))
        .withColumn("key", F.col("fingerprint").bitwiseAND(F.col("mask")))
    )
    # The part of a finer choice goes into its number, above the coarse one's 16.
    split = split.select((F.col("choice") + 16 * (F.col("part") + 1)).cast("int").alias("choice"), "key", "fingerprint")
    return _meetings(met.filter(F.col("n") <= meet).select("choice", "key", "fingerprint").unionByName(split)).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Stars ``node``, ``root`` of the connected components: every node but the root, the smallest.

    Large-star and small-star rounds, each kept as a table, until the edges stay as they are.
    """
    now = stored(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.filter("u <> v")
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lowest.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = stored(small, "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, meet: int = MEET) -> DataFrame:
    """One row per document: ``key``, ``fingerprint`` (long), ``component_id``.

    The component is the smallest key reachable over links of at most three
    differing bits, null only where no row of it has a key.  Documents without
    words have fingerprint 0 and are linked like any other; repeated rows share
    all they have.
    """
    rows = stored(simhash(docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text")), "__text", width=width), "fingerprints")
    different = stored(rows.groupBy("fingerprint").agg(F.min("__key").alias("least")), "fingerprints")
    roots = components(links(different.select("fingerprint"), meet))
    named = stored(
        different.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
            "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
        ),
        "roots",
    )
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(lowest, "root").select("fingerprint", "component_id")
    return rows.join(of, "fingerprint").select(F.col("__key").alias(key), "fingerprint", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents with one left of each component: that whose key is the component's.

    Of rows that repeat that key and text, that with the smallest hash of its
    values is left.  Documents without a
    key cannot be told apart by it and all stay.
    """
    name = F.col(f"`{key}`")
    found = near_duplicates(docs.filter(name.isNotNull()), key, text, **how)
    staying = found.filter(F.col(key) == F.col("component_id")).select(F.col(key).alias("__stay")).distinct()
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), name.alias("__key"), F.xxhash64(F.col(f"`{text}`")).alias("__text"))
    kept = held.join(staying, F.col("__key") == F.col("__stay"), "left_semi")
    hashable = [F.col(f"__row.`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    first = Window.partitionBy("__key", "__text").orderBy(F.xxhash64(*hashable))
    one = kept.withColumn("__n", F.row_number().over(first)).filter("__n = 1").select(*(F.col(f"__row.`{c}`").alias(c) for c in docs.columns))
    return one.unionByName(docs.filter(name.isNull()))
