"""Language of a text by n-gram filters with a bit for each language.

Each learnt language has a Bloom filter of the character n-grams typical of
it.  All filters have one size and the same hash functions and lie side by
side, bit-sliced: a cell holds one bit per language, so the ``HASHES`` cells of
an n-gram, combined by AND, give every language that has it.  The bits of a
text's n-grams are counted per language; from N n-grams a filter that answers
wrongly with rate f gives (bits - N f) / (1 - f) true ones, and the language
with most of these is the text's.

An n-gram is typical of the languages whose rate of it is at least ``SHARE`` of
the highest rate among all.  Learning takes at most ``LEARNT`` documents a
language, chosen by a hash of the id; its counts are made by Spark and the
filters have a fixed size, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lotwatch.llm.rows import map_column, slices
from lotwatch.session import stored

# Documents of a language that learning takes at most.
LEARNT = 2_000
ORDERS = (2, 3, 4)
# Least share of the highest rate, and least count in a language, that make an n-gram typical of it.
SHARE, COMMON = 0.5, 2
CELLS, HASHES = 1 << 21, 3
UNKNOWN = "und"
# Characters of a text that are looked at together: a bound of memory only.
BLOCK = 1 << 18

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SPACE = ord(" ")
_between = regex.compile(r"[^\p{L}\p{M}]+")
_letter = regex.compile(r"\p{L}")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def grams_of(text: str) -> Iterator[np.ndarray]:
    """Hashes of a text's n-grams, block by block.

    Letters are lower-cased; what is between runs of letters counts as one
    space, which an n-gram may begin or end with but not have inside.
    """
    codes = np.frombuffer(f" {_between.sub(' ', text.lower()).strip(' ')} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for start in range(0, len(codes), BLOCK):
        block = codes[start : start + BLOCK + max(ORDERS) - 1].astype(np.uint64)
        space = block == _SPACE
        for n in ORDERS:
            size = min(BLOCK, len(block) - n + 1)
            if size <= 0:
                continue
            hashed, inner = np.full(size, n, np.uint64), np.zeros(size, bool)
            for k in range(n):
                hashed = (hashed + block[k : k + size]) * _FACTOR
                if 0 < k < n - 1:
                    inner |= space[k : k + size]
            if n == 2:
                inner |= space[:size] & space[1 : 1 + size]
            yield _mixed(hashed[~inner])


def cells_of(grams: np.ndarray) -> Iterator[np.ndarray]:
    """The cells of each n-gram, one array per hash function."""
    first, step = grams & np.uint64(0xFFFFFFFF), (grams >> np.uint64(32)) | np.uint64(1)
    for k in range(HASHES):
        yield ((first + np.uint64(k) * step) % np.uint64(CELLS)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """``slices``: a row of cells per 64 languages, bit l of row w for language 64 w + l."""

    languages: tuple[str, ...]
    slices: np.ndarray
    rates: np.ndarray

    @staticmethod
    def of(languages: Sequence[str], slices: np.ndarray) -> Model:
        """The model with the rate of wrong answers that each filter's share of set cells makes."""
        words, bits = slices.shape[0], slices.dtype.itemsize * 8
        filled = [float(((slices[i // bits] >> slices.dtype.type(i % bits)) & slices.dtype.type(1)).mean()) for i in range(len(languages))]
        assert words * bits >= len(languages)
        return Model(tuple(languages), slices, np.array(filled) ** HASHES)

    def hits(self, text: str) -> tuple[int, np.ndarray]:
        """N-grams of a text, and how many of them each language's filter has."""
        bits, kind, n = self.slices.dtype.itemsize * 8, self.slices.dtype.type, 0
        found = np.zeros(len(self.languages), np.int64)
        for grams in grams_of(text):
            n += len(grams)
            cells = list(cells_of(grams))
            for word, row in enumerate(self.slices):
                has = row[cells[0]]
                for c in cells[1:]:
                    has = has & row[c]
                for i in range(word * bits, min(len(found), (word + 1) * bits)):
                    found[i] += np.count_nonzero(has & kind(1 << (i % bits)))
        return n, found

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its share of all languages' corrected counts; of equal ones the first in spelling."""
        if not text or not self.languages or not _letter.search(text):
            return UNKNOWN, 0.0
        n, found = self.hits(text)
        true = np.clip((found - n * self.rates) / (1 - self.rates), 0, None)
        best = int(np.argmax(true))
        return self.languages[best], float(true[best] / true.sum()) if true.sum() else 1 / len(true)


def held_out(key: Column) -> Column:
    """Rows that nothing is learnt from; a null key is none of them, nor learnt from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counts(taught: DataFrame) -> DataFrame:
    """``language``, ``gram``, ``n`` of ``language``, ``text``, counted slice by slice before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                by_language: dict[str, list[np.ndarray]] = {}
                for language, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    by_language.setdefault(language, []).extend(grams_of(text or ""))
                for language, grams in by_language.items():
                    gram, n = np.unique(np.concatenate(grams or [np.zeros(0, np.uint64)]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([language] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n, pa.int64())], names=["language", "gram", "n"])

    return taught.mapInArrow(run, "language string, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", learnt: int = LEARNT) -> Model:
    """Learn from the documents outside the held-out ones that have a key and a language.

    Rows that repeat a key count once in the choice, with the least of their
    languages; their texts all count.  Without any such row there are no languages.
    """
    spark = docs.sparkSession
    name = F.col(f"`{key}`")
    rows = docs.select(name.alias("id"), F.col(f"`{language}`").cast("string").alias("language"), F.col(f"`{text}`").alias("text"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("language").isNotNull() & F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False)) & ~held_out(F.col("id")))
    each = stored(rows.groupBy("id").agg(F.min("language").alias("language")), "ids")
    sizes = each.groupBy("language").agg(F.count(F.lit(1)).alias("size"))
    # Twice as many as wanted, by a hash of the id, go into the ordering; of few rows all.
    draw = F.shiftrightunsigned(F.xxhash64("id"), 11) / float(1 << 53)
    few = each.withColumn("draw", draw).join(F.broadcast(sizes), "language").filter(F.col("draw") * F.col("size") <= 2 * learnt + 1000)
    order = Window.partitionBy("language").orderBy("draw", "id")
    chosen = few.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= learnt).select("id", "language")
    # At most ``learnt`` ids a language.
    counts = stored(_counts(rows.join(F.broadcast(chosen), ["id", "language"]).select("language", "text")), "grams")
    # One row per language.
    totals = {r["language"]: r["total"] for r in counts.groupBy("language").agg(F.sum("n").alias("total")).collect()}
    languages = sorted(totals)
    if not languages:
        return Model((), np.zeros((1, CELLS), np.uint8), np.zeros(0))
    kind = next((k for k in (np.uint8, np.uint16, np.uint32) if len(languages) <= np.dtype(k).itemsize * 8), np.uint64)
    places = spark.createDataFrame([(x, i, float(totals[x])) for i, x in enumerate(languages)], "language string, place int, total double")
    rated = counts.join(F.broadcast(places), "language").select("gram", "place", "n", (F.col("n") / F.col("total")).alias("rate"))
    highest = rated.groupBy("gram").agg(F.max("rate").alias("highest"), F.collect_list(F.struct("place", "n", "rate")).alias("each"))
    typical = F.filter("each", lambda x: (x["n"] >= COMMON) & (x["rate"] >= SHARE * F.col("highest")))
    # At most one bit per language and cell.
    bits = np.dtype(kind).itemsize * 8
    found = highest.select("gram", F.explode(F.transform(typical, lambda x: x["place"])).alias("place"))
    masks = found.groupBy("gram", (F.col("place") / bits).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % bits).cast("int"))).alias("mask"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in cells_of(batch.column(0).to_numpy().view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(1), batch.column(2)], names=["cell", "word", "mask"])

    cells = masks.mapInArrow(spread, "cell long, word int, mask long").groupBy("cell", "word").agg(F.bit_or("mask").alias("mask"))
    table = cells.toArrow()
    filters = np.zeros((-(-len(languages) // bits), CELLS), kind)
    filters[table.column("word").to_numpy(), table.column("cell").to_numpy()] = table.column("mask").to_numpy().view(np.uint64).astype(kind)
    return Model.of(languages, filters)


def predict(df: DataFrame, model: Model, text: str = "text", out: str = "lang_pred", score: str = "score", keep: Sequence[str] | None = None) -> DataFrame:
    """Replace the text by its language and the share that speaks for it.

    ``und`` with score 0 where the text is null or has no letter, or nothing
    was learnt.  Rows are independent; the columns in ``keep`` (all, if not
    given) stay, save those named like an output, which are replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make(texts: list) -> list[Sequence]:
        made = [sent.value.predict(t) for t in texts]
        return [[x for x, _ in made], [y for _, y in made]]

    return map_column(df, text, make, {out: (T.StringType(), pa.string()), score: (T.DoubleType(), pa.float64())}, keep)
