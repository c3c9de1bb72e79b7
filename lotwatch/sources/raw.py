"""Raw tender documents: one JSON document per file or per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch import fixed_values as fixed
from lotwatch.functions.text import contains_any
from lotwatch.functions.values import once
from lotwatch.operators.versions import last_arrival, latest_version
from lotwatch.schema import RAW_DOCUMENT, RAW_FIELDS

WHITE_SPACE = " \t\r\n\f\v"
_BARE = f"{RAW_DOCUMENT[:-1]}, _corrupt: STRING>"
_WRAPPED = f"STRUCT<data: {RAW_DOCUMENT}, _corrupt: STRING>"
_CORRUPT = {"columnNameOfCorruptRecord": "_corrupt"}


def read_raw(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """All documents below a folder: ``source_file``, ``body`` (the whole text)."""
    return (
        spark.read.text(folder, wholetext=True, pathGlobFilter=pattern)
        .select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("body"))
    )


def read_raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Many documents per file, one per line; the usual layout for large landings."""
    return spark.read.text(folder).select(
        F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("body")
    )


def _framed(body: str) -> Column:
    """Whether a text is in braces but for white space; a whole text is trimmed only if it has some at its ends."""
    text = F.col(body)
    trimmed = F.btrim(text, F.lit(WHITE_SPACE))
    return F.when(text.startswith("{") & text.endswith("}"), F.lit(True)).otherwise(trimmed.startswith("{") & trimmed.endswith("}"))


# Documents of a file of lines: a compressed file is read by one task.
LINES_PER_FILE = 200_000


def land_lines(raw: DataFrame, folder: str) -> None:
    """Append raw documents to a landing of compressed files with one document per line."""
    raw.select("body").write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", LINES_PER_FILE).text(folder)


# What a landing keeps of each document, and the day it was modified on, by which it is partitioned.
LANDED = "source_file string, body string, document_id string, modified timestamp, body_hash bigint, day date"
_FRAME = "id STRING, dateModified STRING"


def with_frame(raw: DataFrame) -> DataFrame:
    """Add what tells changed documents without a full parse: ``document_id``, ``modified``, ``body_hash``, ``day``.

    Read from the outermost fields only.  Where they cannot be read as usual,
    id and date are null, and the document is left to the full parse.
    """
    # Texts that are cut off are not tried: the parser's exceptions cost more than all else.
    whole = F.btrim("body", F.lit(WHITE_SPACE)).endswith("}")
    framed = F.when(whole, F.from_json("body", f"STRUCT<{_FRAME}, data: STRUCT<{_FRAME}>, _corrupt: STRING>", _CORRUPT))
    rows = raw.withColumn("__frame", framed)
    frame = F.col("__frame")
    regular = frame["_corrupt"].isNull() & whole
    wrapped = frame["id"].isNull() & frame["data"].isNotNull()
    of = lambda field: F.when(regular, F.when(wrapped, frame["data"][field]).otherwise(frame[field]))
    rows = rows.withColumns({"document_id": of("id"), "modified": F.try_to_timestamp(of("dateModified")), "body_hash": F.xxhash64("body")})
    return rows.withColumn("day", F.to_date("modified")).drop("__frame")


def land_by_day(raw: DataFrame, folder: str) -> None:
    """Append raw documents to a landing partitioned by the day of modification; undated ones have a partition of their own."""
    rows = with_frame(raw.select("source_file", "body"))
    # Large days are split over several files, small ones are not.
    rows.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(folder)


def read_landing(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a landing partitioned by day."""
    return spark.read.schema(LANDED).parquet(folder)


def changed_since(landed: DataFrame, since: str) -> DataFrame:
    """Documents modified at or after ``since`` (ISO text), and undated ones; of a landing, only those days are read."""
    moment = F.lit(since).cast("timestamp")
    later = F.col("day").isNull() | (F.col("day") >= F.to_date(moment))
    return landed.filter(later).filter(F.col("modified").isNull() | (F.col("modified") >= moment))


def parse_documents(raw: DataFrame) -> DataFrame:
    """Parse, unwrap and judge each document.

    Adds ``doc`` (typed struct), ``tender_id`` and ``reject_reason``.  A document
    wrapped as ``{"data": {...}}`` is unwrapped when it has no id of its own.
    Nothing is dropped here, so good rows and rejects come from one pass.

    One typed parse serves the regular documents, and a second one those without
    an id of their own, which may be wrapped.  Only those in which it met
    something unexpected, and those not in braces, are parsed once more without
    types, to tell a container that is merely empty from one that is wrong.
    Texts not in braces get no typed parse, whose exceptions cost more than it.
    """
    # Each step names its result, so a later one does not repeat it.
    steps = raw.select("*", _framed("body").alias("__framed"))
    framed, typed, wrapped, odd = (F.col(c) for c in ("__framed", "__typed", "__wrapped", "__odd"))
    steps = steps.select("*", F.when(framed, F.from_json("body", _BARE, _CORRUPT)).alias("__typed"))
    steps = steps.select("*", F.when(framed & typed["id"].isNull(), F.from_json("body", _WRAPPED, _CORRUPT)).alias("__wrapped"))
    unexpected = typed.isNull() | typed["_corrupt"].isNotNull() | wrapped["_corrupt"].isNotNull()
    steps = steps.select("*", F.coalesce(unexpected | ~framed, F.lit(True)).alias("__odd"))
    steps = steps.select("*", F.when(odd, F.try_parse_json("body")).alias("__parsed"))
    steps = steps.select("*", _unwrapped(F.col("__parsed")).alias("__loose"))
    rows = steps.select(*raw.columns, once(_judged(typed, wrapped["data"], odd, F.col("__loose"))).alias("judged"))
    return rows.select(
        *raw.columns, "judged.doc", F.col("judged.doc.id").alias("tender_id"), F.col("judged.reject_reason").alias("reject_reason")
    )


def _unwrapped(parsed: Column) -> Column:
    inner = F.try_variant_get(parsed, "$.data", "variant")
    wrapped = F.try_variant_get(parsed, "$.id", "variant").isNull() & inner.isNotNull()
    return F.when(wrapped, inner).otherwise(parsed)


def _judged(typed: Column, inner: Column, odd: Column, loose: Column) -> Column:
    """The document and the reason to reject it, null for a good one."""
    bare = F.struct(*(typed[name].alias(name) for name in RAW_FIELDS))
    regular = F.when(typed["id"].isNull() & inner.isNotNull(), inner).otherwise(bare)
    doc = F.when(odd, F.try_variant_get(loose, "$", RAW_DOCUMENT)).otherwise(regular)
    odd_id = F.try_variant_get(loose, "$.id", "string")
    doc_id = F.when(odd, odd_id).otherwise(F.coalesce(typed["id"], inner["id"]))
    reason = (
        F.when(odd & loose.isNull(), F.lit("unreadable"))
        .when(odd & ~_is_object(loose, "$"), F.lit("not an object"))
        .when(doc_id.isNull(), F.lit("no id"))
        .when(odd & ~_well_formed(loose), F.lit("malformed"))
    )
    return F.struct(doc.alias("doc"), reason.alias("reject_reason"))


def _is_object(loose: Column, path: str) -> Column:
    """An object can be read as a struct of any one field; nothing else can."""
    return F.try_variant_get(loose, path, "struct<id:variant>").isNotNull()


def _empty(loose: Column, path: str) -> Column:
    """Missing, null, or one of the empty values that count as missing."""
    as_text = F.try_variant_get(loose, path, "string")
    return as_text.isNull() | as_text.isin("", "{}", "[]", "0", "false")


def _well_formed(loose: Column) -> Column:
    """Containers that hold something hold the right kind of thing."""
    condition = F.lit(True)
    for name in ("value", "procuringEntity"):
        condition = condition & (_is_object(loose, f"$.{name}") | _empty(loose, f"$.{name}"))
    for name in ("awards", "contracts", "items"):
        condition = condition & _list_of_objects(loose, f"$.{name}")
    awards = F.try_variant_get(loose, "$.awards", "array<variant>")
    return condition & F.coalesce(F.forall(awards, lambda award: _list_of_objects(award, "$.suppliers")), F.lit(True))


def _list_of_objects(loose: Column, path: str) -> Column:
    """Missing or empty, or a list whose elements are objects or null."""
    listed = F.try_variant_get(loose, path, "array<variant>")
    objects = F.forall(listed, lambda x: x.isNull() | F.is_variant_null(x) | _is_object(x, "$"))
    return _empty(loose, path) | F.coalesce(objects, F.lit(False))


def good_documents(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def quarantine(parsed: DataFrame) -> DataFrame:
    """The rejected documents with the reason, text kept for repair."""
    return parsed.filter(F.col("reject_reason").isNotNull()).select("source_file", "tender_id", "reject_reason", "body")


def run_counters(parsed: DataFrame) -> DataFrame:
    """One row per outcome: ``ok`` or a reject reason, with the number of documents."""
    return parsed.groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n_documents")
    )


def touched_documents(documents: DataFrame, touched: DataFrame, key: str = "tender_id") -> DataFrame:
    """Only the documents whose key is listed."""
    return documents.join(touched.select(key).distinct(), key, "left_semi")


def missing_documents(documents: DataFrame, touched: DataFrame, key: str = "tender_id") -> DataFrame:
    """Listed keys that have no document."""
    return touched.select(key).distinct().join(documents.select(key), key, "left_anti")


def is_relevant(prefixes=tuple(fixed.RELEVANT_CPV_PREFIXES), keywords=tuple(fixed.RELEVANT_KEYWORDS)) -> Column:
    """Relevance of a parsed document ``doc``, before it is flattened."""
    codes = F.transform("doc.items", lambda i: i["classification"]["id"])
    pattern = "^(?:" + "|".join(prefixes) + ")"
    by_code = F.coalesce(F.exists(codes, lambda c: F.coalesce(c.rlike(pattern), F.lit(False))), F.lit(False))
    words = F.concat_ws(" ", "doc.title", F.transform("doc.items", lambda i: i["description"]))
    return by_code | contains_any(words, keywords)


def relevant_raw(documents: DataFrame, *lists) -> DataFrame:
    """The relevant ones of nested documents."""
    return documents.filter(is_relevant(*lists))


def change_feed(
    df: DataFrame,
    since=None,
    descending: bool = False,
    limit: int | None = None,
    modified: str = "date_modified",
    key: str = "tender_id",
) -> DataFrame:
    """Rows changed strictly after a cursor, oldest first; or all rows, newest first.

    ``since`` is a datetime or ISO text.  It has no effect when walking newest first.  ``limit`` counts rows of
    the frame passed in, so pass one that is already filtered for relevance.
    """
    if descending:
        ordered = df.orderBy(F.col(modified).desc_nulls_last(), F.col(key).desc())
    else:
        rows = df
        if since is not None:
            rows = df.filter(F.col(modified) > F.lit(str(since)).cast(df.schema[modified].dataType))
        ordered = rows.orderBy(F.col(modified).asc_nulls_last(), F.col(key))
    return ordered.limit(limit) if limit else ordered


def up_to_whole_date(rows: DataFrame, limit: int, modified: str = "date_modified") -> DataFrame:
    """The oldest ``limit`` rows and all others of the last one's date; undated rows are always among them.

    A cut never falls among equal dates.  The last date is found by counting
    rows by day, then by second of one day, then by date within one second, so
    no task orders all dates; what comes to the driver is at most a number per
    day, 86,400 or a million of them.  ``rows`` is read for each count, of
    columns only those that its filters and the date need.
    """
    inside, left = rows.select(F.unix_micros(modified).alias("at")).filter(F.col("at").isNotNull()), limit
    for unit in (86_400_000_000, 1_000_000, 1):
        start = F.col("at") - F.pmod("at", F.lit(unit))
        counts = inside.groupBy(start.alias("start")).agg(F.count(F.lit(1)).alias("n")).collect()
        for last, n in sorted(map(tuple, counts)):
            if n >= left:
                break
            left -= n
        else:
            return rows
        inside = inside.filter(start == last)
    return rows.filter(F.col(modified).isNull() | (F.col(modified) <= F.timestamp_micros(F.lit(last))))


def _latest(incoming: DataFrame, key: str, modified: str | None) -> DataFrame:
    """One row per key: the latest, or without dates the one a hash of the row chooses."""
    if modified is not None:
        return latest_version(incoming, [key], modified, [], by_hash=True)
    return last_arrival(incoming, [key], [], by_hash=True)


def land(landed: DataFrame, incoming: DataFrame, overwrite: bool = False, key: str = "tender_id", modified: str | None = None) -> DataFrame:
    """The landing table after new documents came in, one document per key.

    Documents that have landed stay as they are; with ``overwrite`` the incoming
    ones replace them.  Of versions that come in together the latest counts.
    """
    if overwrite:
        fresh = _latest(incoming, key, modified)
        return landed.join(fresh.select(key), key, "left_anti").unionByName(fresh)
    return landed.unionByName(new_documents(incoming, landed, key, modified))


def new_documents(incoming: DataFrame, landed: DataFrame, key: str = "tender_id", modified: str | None = None) -> DataFrame:
    """Incoming documents whose key has not landed yet, the latest per key."""
    return _latest(incoming.join(landed.select(key), key, "left_anti"), key, modified)
