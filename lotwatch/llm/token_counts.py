"""Token totals by source, language and tokenizer version, kept by signed deltas.

A batch of changed documents becomes additive rows: what is new or revised
counts plus, what was known of the same documents counts minus.  Totals are the
sum of the committed deltas, so no batch reads earlier texts.  A batch is
written aside and becomes current with one commit row that names its folder;
a batch id that is committed already changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch.llm.bpe import bpe_encode
from lotwatch.session import stored

# Runs without white space; runs of letters and digits, and single marks.
WORDS = r"[^ \t\r\n]+"
WORDS_AND_MARKS = r"[\p{L}\p{N}]+|[^ \t\r\n\p{L}\p{N}]"

GROUP = ["source", "lang", "tokenizer"]
ENTRY = "doc_id long, source string, lang string, tokenizer string, tokens long, deleted boolean, seq long"

Counter = Callable[[DataFrame], DataFrame]


def pattern_counter(pattern: str) -> Counter:
    """Counts a pattern's matches in ``text``; null has none."""

    def count(df: DataFrame) -> DataFrame:
        matches: Column = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(pattern))
        return df.withColumn("tokens", matches.cast("long")).drop("text")

    return count


def bpe_counter(path: str) -> Counter:
    """Counts the tokens of a byte-level BPE vocabulary."""
    return lambda df: bpe_encode(df, path).withColumn("tokens", (F.octet_length("ids") / 4).cast("long")).drop("ids")


class TokenRollup:
    """Totals below one folder, with one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _commits(self) -> list:
        """One row per committed batch, in order."""
        try:
            found = self.spark.read.schema("batch string, seq long, folder string").parquet(f"{self.path}/commits")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return []
        return found.orderBy("seq").collect()

    def _read(self, part: str, schema: str) -> DataFrame:
        folders = [f"{row['folder']}/{part}" for row in self._commits()]
        reader = self.spark.read.schema(schema)
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def counts(self) -> DataFrame:
        """The current count of each document and tokenizer."""
        latest = self._read("entries", ENTRY).groupBy("doc_id", "tokenizer").agg(F.max_by(F.struct("source", "lang", "tokens", "deleted"), "seq").alias("at"))
        return latest.filter("NOT at.deleted").select("doc_id", "tokenizer", "at.source", "at.lang", "at.tokens")

    def totals(self) -> DataFrame:
        """``source``, ``lang``, ``tokenizer``, ``documents``, ``tokens``; groups that have come to nothing are left out."""
        deltas = self._read("deltas", "source string, lang string, tokenizer string, documents long, tokens long")
        summed = deltas.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return summed.filter("documents <> 0 OR tokens <> 0")

    def apply(self, batch: str, changes: DataFrame, tokenizer: str, counter: Counter, only: DataFrame | None = None) -> bool:
        """Merge changed documents; false if the batch was committed before.

        ``changes`` has ``doc_id``, ``source``, ``lang``, ``text`` and
        ``deleted``.  A document not deleted is inserted or revised; deleting
        an unknown one changes nothing.  Null sources and languages are groups
        of their own; a null ``deleted`` is false.  Of rows that repeat an id
        one counts: not deleted before deleted, then the most tokens, then the
        last source and language.  Rows without an id cannot be told apart or
        found again: they are passed over.  ``only`` has the ``doc_id`` of the
        documents to take, if not all; they are chosen after the counting, so
        that no text is shuffled for it.
        """
        commits = self._commits()
        if any(row["batch"] == batch for row in commits):
            return False
        seq = 1 + max((row["seq"] for row in commits), default=0)
        folder = f"{self.path}/batches/{seq}-{uuid.uuid4().hex}"
        known = self.counts().filter(F.col("tokenizer") == tokenizer)

        deleted = F.coalesce("deleted", F.lit(False))
        rows = changes.filter(F.col("doc_id").isNotNull()).select(
            F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", deleted.alias("deleted"), F.when(~deleted, F.col("text")).alias("text")
        )
        best = F.max(F.struct((~F.col("deleted")).alias("stays"), "tokens", "source", "lang")).alias("at")
        one = counter(rows).groupBy("doc_id").agg(best)
        entries = one.select(
            "doc_id", "at.source", "at.lang", F.lit(tokenizer).alias("tokenizer"), "at.tokens", (~F.col("at.stays")).alias("deleted"), F.lit(seq).cast("long").alias("seq")
        )
        if only is not None:
            entries = entries.join(only.select("doc_id").distinct(), "doc_id", "left_semi")
        entries.write.mode("overwrite").parquet(f"{folder}/entries")
        entries = self.spark.read.schema(ENTRY).parquet(f"{folder}/entries")
        added = entries.filter("NOT deleted").select(*GROUP, F.lit(1).alias("documents"), "tokens")
        taken = known.join(entries.select("doc_id"), "doc_id", "left_semi").select(*GROUP, F.lit(-1).alias("documents"), (-F.col("tokens")).alias("tokens"))
        deltas = added.unionByName(taken).groupBy(*GROUP).agg(F.sum("documents").cast("long").alias("documents"), F.sum("tokens").cast("long").alias("tokens"))
        deltas.write.mode("overwrite").parquet(f"{folder}/deltas")
        commit = self.spark.createDataFrame([(batch, seq, folder)], "batch string, seq long, folder string")
        commit.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return True


def by_batches(rollup: TokenRollup, batches: list[tuple[str, DataFrame, str, Counter]]) -> DataFrame:
    """Apply batches in order and give the totals as a table computed once."""
    for batch, changes, tokenizer, counter in batches:
        rollup.apply(batch, changes, tokenizer, counter)
    return stored(rollup.totals(), "totals")
