"""Exact duplicates by an extendible-hash index in shared files.

Keys are 64-bit hashes of whole texts.  A directory starts with one bucket and
doubles while a bucket holds more keys than its capacity; only the overfull
buckets are split.  Texts meet within bucket and hash, where they are compared
byte by byte, and leave one entry per different text; owner tasks take the
buckets and chain the entries whose hashes collide.  A document is then looked
up by its cell of the directory, its bucket, its hash and along the chain.

Only DataFrame functions are used.  Copies of a text are counted before they
are shuffled, so a text that fills a third of the table costs a row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotwatch.session import fresh_folder, stored

# Different keys in a bucket of the index.
BUCKET_KEYS = 100_000
# The directory doubles at most so often: a million buckets, about 16 MB when broadcast.
# A bucket that is overfull even then stays so; its keys are only more to read.
MAX_DEPTH = 20


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def directory(keys: DataFrame, bucket_keys: int = BUCKET_KEYS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``cell``, ``depth`` and ``bucket`` for every prefix of ``max_depth`` bits that a key ``h`` has.

    All keys begin in one bucket.  The directory doubles as long as a bucket
    holds more than ``bucket_keys`` keys; only such buckets are split.  A bucket
    is named by its first cell.
    """
    cell = F.shiftrightunsigned("h", 64 - max_depth)
    now = stored(keys.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")), "cells").select("cell", "n", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("bucket"))
    for depth in range(1, max_depth + 1):
        over = now.groupBy("bucket").agg(F.sum("n").alias("held")).filter(F.col("held") > bucket_keys).select("bucket", F.lit(True).alias("over"))
        if over.isEmpty():
            break
        split = now.join(over, "bucket", "left").withColumn("depth", F.when(F.col("over"), depth).otherwise(F.col("depth")))
        low = max_depth - depth
        first = F.shiftleft(F.shiftright("cell", low), low)
        now = stored(split.select("cell", "n", "depth", F.when(F.col("over"), first).otherwise(F.col("bucket")).alias("bucket")), "directory")
    return now.select("cell", "depth", "bucket")


def _in_bucket(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with the bucket that the directory has for the first bits of their ``h``."""
    cells = rows.sparkSession.read.parquet(f"{path}/directory")
    # At most 2 ** MAX_DEPTH cells; their depth is the directory's, the same in each row.
    size = cells.select(F.first("bits")).first()
    bits = size[0] if size and size[0] is not None else 0
    cell = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    return rows.join(F.broadcast(cells.select("cell", "bucket")), cell == F.col("cell")).drop("cell")


def build_index(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, bucket_keys: int = BUCKET_KEYS, max_depth: int = MAX_DEPTH, hash_text=text_hash, carry: bool = False
) -> DataFrame:
    """Write the index of all texts below ``path`` (a fresh shared folder, if not given) and read it.

    One row per different text: ``bucket``, ``h``, ``chain`` (number among the
    texts of this hash), ``digest`` (SHA-256), ``keep_id`` (largest key, null
    only if all are), ``group_size``.  Null texts count as empty.  With
    ``carry``, the files of entries hold the whole row that stays too.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text]
    rest = F.struct(F.col(f"`{text}`").isNull().alias("none"), *others)
    rows = docs.select(F.col(f"`{key}`").alias("id"), body.alias("body"), hash_text(body).alias("h"), *([rest.alias("rest")] if carry else []))
    path = path or fresh_folder(spark, "index")
    rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/keys")
    keys = spark.read.parquet(f"{path}/keys")
    # Hashes are even, so few doublings beyond the average load are ever needed.
    max_depth = min(max_depth, (keys.count() // bucket_keys).bit_length() + 3)
    directory(keys, bucket_keys, max_depth).withColumn("bits", F.lit(max_depth)).write.parquet(f"{path}/directory")
    # The directory finds the bucket; grouping by the text itself compares bytes, copies are counted before they move.
    values = [F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    if carry:
        # Of rows that repeat the key, that with the smallest hash; a null key is least.
        hashable = [c for f, c in zip([f for f in docs.schema if f.name != text], (f"rest.c{i}" for i, n in enumerate(docs.columns) if n != text), strict=True) if "map<" not in f.dataType.simpleString()]
        values.append(F.max_by("rest", F.struct("id", F.negative(F.xxhash64(*hashable, "rest.none")))).alias("rest"))
    grouped = _in_bucket(rows, path).groupBy("bucket", "h", "body").agg(*values)
    kept = ["bucket", "h", F.unhex(F.sha2("body", 256)).alias("digest"), "keep_id", "group_size"]
    grouped.select(*kept, *(["body", "rest"] if carry else [])).write.parquet(f"{path}/entries")
    entries = spark.read.parquet(f"{path}/entries").select("bucket", "h", "digest", "keep_id", "group_size")
    chain = Window.partitionBy("bucket", "h").orderBy("digest")
    # A bucket has one owner, whose task holds no more than the bucket's entries.
    chained = entries.repartition("bucket").withColumn("chain", F.row_number().over(chain))
    chained.write.partitionBy("bucket").parquet(f"{path}/buckets")
    return spark.read.schema(chained.schema).parquet(f"{path}/buckets")


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per document: ``key``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the one with the largest key stays; a null key loses to any
    other, and where all are null, all rows are marked kept.  Rows repeated
    whole count in the size of their group and are marked alike.  A document
    finds its entry by cell, bucket and hash, and along the chain by the
    digest of its text.
    """
    path = fresh_folder(docs.sparkSession, "index")
    index = build_index(docs, key, text, path, **how)
    hash_text = how.get("hash_text", text_hash)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("__key"), hash_text(body).alias("h"), F.unhex(F.sha2(body, 256)).alias("digest"))
    found = _in_bucket(rows, path).join(index.select("bucket", "h", "digest", "keep_id", "group_size"), ["bucket", "h", "digest"])
    return found.select(
        F.col("__key").alias(key),
        "keep_id",
        "group_size",
        F.col("__key").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents with one row of each group of equal texts left, all columns as they are.

    They are the rows that the index's entries hold.  Of rows that repeat the
    key that stays, the one with the smallest hash of its values is left.
    """
    path = fresh_folder(docs.sparkSession, "index")
    build_index(docs, key, text, path, carry=True, **how)
    entries = docs.sparkSession.read.parquet(f"{path}/entries")
    of = {text: F.when(~F.col("rest.none"), F.col("body"))}
    return entries.select(*(of.get(c, F.col(f"rest.c{i}")).alias(c) for i, c in enumerate(docs.columns)))
