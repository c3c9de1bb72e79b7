"""Quality classifier by positive-unlabelled learning.

Positives are documents labelled good; the unlabelled ones are web text of
either kind.  A linear model over word shapes and repetition minimises the
non-negative unbiased risk

    prior * R_p(+)  +  max(0, R_u(-) - prior * R_p(-))

where ``prior`` is the share of good documents, estimated from the labels.
Where the bracket turns negative (the model has begun to learn the unlabelled
sample by heart) its gradient is reversed.  The logistic loss makes the scores
probabilities.

The fit uses bounded samples of both kinds; everything else covers all rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwatch.llm.rows import map_column, remembering

# Rows the fit takes at most of each kind, chosen by a hash of the id.
POSITIVES, UNLABELLED = 6_000, 12_000

SHAPES = 512
# Bounds of the steps that a measure is cut into.
SHARE = [0.001, 0.01, 0.03, 0.1, 0.2, 0.3, 0.45, 0.6, 0.75, 0.9]
WORD_LENGTH = [3.5, 4, 4.5, 4.8, 5.1, 5.5, 6, 6.5, 7, 8, 10]
WORDS = [1, 5, 15, 40, 100, 200, 400, 800, 2000, 8000]
MEASURES = [("line repeats", SHARE), ("three-word repeats", SHARE), ("different words", SHARE), ("capitals", SHARE), ("digits", SHARE), ("marks", SHARE), ("word length", WORD_LENGTH), ("words", WORDS)]
SIZE = SHAPES + sum(len(bounds) + 1 for _, bounds in MEASURES)
# Bounds of memory only: words whose shapes a worker remembers, and the longest of them.
REMEMBERED_WORDS, REMEMBERED_LENGTH = 60_000, 100


def _shape(word: str) -> int:
    """Number of a word's shape: kinds of characters in order, runs as one, marks as themselves."""
    kinds, last = [], ""
    for c in word:
        kind = "a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else "x" if c.isalpha() else c
        if kind != last or kind not in "aA9x":
            kinds.append(kind)
        last = kind
    return zlib.crc32("".join(kinds).encode()) % SHAPES


class _Shapes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        shape = _shape(word)
        if len(word) <= REMEMBERED_LENGTH:
            self[word] = shape
        return shape


_shapes = _Shapes()


def features(text: str | None) -> np.ndarray:
    """Features of a whole text; the empty text has those of no words."""
    remembering("quality", _shapes.clear)
    text = text or ""
    words, lines = text.split(), text.split("\n")
    out = np.zeros(SIZE, np.float32)
    n = max(1, len(words))
    for shape, count in Counter(map(_shapes.__getitem__, words)).items():
        out[shape] = count / n
    size = max(1, len(text))
    triples = max(1, len(words) - 2)
    # Longer texts repeat more words anyway; a power of the length levels that.
    measures = (
        1 - len(set(lines)) / len(lines),
        max(0.0, 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / triples) if len(words) > 2 else 0.0,
        min(1.0, len(set(words)) / n * (n / 1000) ** 0.15),
        sum(map(str.isupper, words)) / n,
        sum(map(text.count, "0123456789")) / size,
        sum(map(text.count, "!*$%&#@|{}<>=_~^+\\")) / size,
        sum(map(len, words)) / n,
        len(words),
    )
    at = SHAPES
    for (_, bounds), value in zip(MEASURES, measures, strict=True):
        out[at + int(np.searchsorted(bounds, value, "right"))] = 1
        at += len(bounds) + 1
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        z = np.array([features(t) @ self.weights for t in texts], np.float64) + self.bias
        return 1 / (1 + np.exp(-z))


def gradient(w: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Of the non-negative risk by the weights and, last, the bias; a negative bracket is pushed up, alone."""
    narrow = w[:-1].astype(np.float32)
    zp, zu = positive @ narrow + w[-1], unlabelled @ narrow + w[-1]
    sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
    if np.logaddexp(0, zu).mean() >= prior * np.logaddexp(0, zp).mean():
        gp, gu = np.full(len(zp), -prior / len(zp)), su / len(zu)
    else:
        gp, gu = prior * sp / len(zp), -su / len(zu)
    return np.append(gp.astype(np.float32) @ positive + gu.astype(np.float32) @ unlabelled, gp.sum() + gu.sum())


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1000, rate: float = 0.2, decay: float = 1e-6) -> Model:
    """Full-batch Adam on the non-negative risk; without positives every score is the prior."""
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(SIZE, np.float32), float(np.log(prior / (1 - prior))), prior)
    w = np.zeros(SIZE + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        grad = gradient(w, positive, unlabelled, prior)
        grad[:-1] += decay * w[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        w -= rate * (1 - t / (steps + 1)) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Model(w[:-1].astype(np.float32), float(w[-1]), prior)


def held_out(key: Column) -> Column:
    """Rows whose labels are not learnt from; a null key is none of them."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _some(ids: DataFrame, n: int) -> DataFrame:
    return ids.orderBy(F.xxhash64("id"), "id").limit(n)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Learn from at most ``positives`` and ``unlabelled`` rows outside the held-out ones.

    Labels other than 0 and 1, null keys, and labels of absent documents are
    passed over; repeated ids count once in the choice.  Without any label the
    prior is one half.
    """
    spark = docs.sparkSession
    marked = labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label")).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    prior = marked.agg(F.avg("label")).first()[0]
    prior = 0.5 if prior is None else float(prior)
    ids = docs.select(F.col(f"`{key}`").alias("id")).filter(F.col("id").isNotNull() & ~held_out(F.col("id")))
    good = _some(marked.filter("label = 1").select("id").distinct().join(ids.distinct(), "id", "left_semi"), positives)
    some = _some(ids.distinct(), unlabelled)
    # At most positives + unlabelled ids.
    chosen = good.select("id", F.lit(1).alias("kind")).unionByName(some.select("id", F.lit(0).alias("kind")))
    picked = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "id").select("id", "kind", "text")
    vectors = map_column(picked, "text", lambda texts: [[features(t).tobytes() for t in texts]], {"x": (T.BinaryType(), pa.binary())})
    rows = vectors.dropDuplicates(["id", "kind"]).orderBy("kind", "id").collect()
    matrix = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(-1, SIZE)
    kind = np.array([r["kind"] for r in rows], np.int64)
    return minimise(matrix[kind == 1], matrix[kind == 0], prior)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score", keep: Sequence[str] | None = None) -> DataFrame:
    """Replace the text by the probability that it is good.  Null counts as the empty text."""
    return map_column(df, text, lambda texts: [model.scores(texts)], {out: (T.DoubleType(), pa.float64())}, keep)


def keep_good(docs: DataFrame, model: Model, text: str = "text", least: float = 0.3) -> DataFrame:
    """The documents that score at least ``least``, all columns as they are."""
    body, out = ("_" * (1 + max(map(len, docs.columns))) + x for x in ("text", "score"))
    scored = score(docs.withColumn(body, F.col(f"`{text}`")), model, body, out)
    return scored.filter(F.col(out) >= least).drop(out)
