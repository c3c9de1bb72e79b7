"""WARC archives: writing, reading, and resolving repeated payloads to revisit records.

Headers alone are shuffled by payload digest to find each payload's original
response; the records then meet their decision by a join and are written with
fresh headers.  Archives are text files whose records end in two line ends,
the format's own separator, so Spark's writer commits them like any table.
They are compressed whole.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch.session import stored

# Smaller payloads are never made revisits.
LEAST_REVISIT_BYTES = 100
# Bytes of an archive's records on average, before compression.
ARCHIVE_BYTES = 24_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes long, payload binary"


def resolve(records: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Decide for each record: ``record_type`` and ``refers_to``.

    ``records`` has ``record_id`` (any ordered type), ``payload_digest`` and
    ``payload_bytes``; other columns stay.  Of equal payloads of at least
    ``least`` bytes the record with the smallest id is the response and the
    others revisit it; null ids sort last and refer to it too, and where all
    are null, all are responses.  Rows that repeat the smallest id are responses
    alike.
    """
    columns = [c for c in records.columns if c not in ("record_type", "refers_to")]
    long_enough = F.col("payload_bytes") >= least
    original = (
        records.filter(long_enough)
        .groupBy("payload_digest")
        .agg(F.min("record_id").alias("__original"), F.count(F.lit(1)).alias("__n"))
        .filter("__n > 1")
        .select("payload_digest", "__original")
    )
    # As a table its size is known to the planner, which then moves payloads only if it is large.
    joined = records.join(stored(original, "originals"), "payload_digest", "left")
    again = long_enough & F.col("__original").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("__original"))
    return joined.select(
        *(F.col(f"`{c}`") for c in columns),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("__original")).alias("refers_to"),
    )


def _header(name: str, value: Column) -> Column:
    # A line end inside a value would end the header.
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit("\r\n")), F.lit(""))


def write_archives(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write resolved records as gzip WARC files below ``path``.

    Columns: ``record_id``, ``record_type``, ``target_uri``, ``date``,
    ``payload_digest``, ``refers_to``, ``payload`` (binary or string).  A
    revisit is written without its payload; null values leave out the header.
    """
    is_revisit = F.col("record_type") == "revisit"
    body = F.when(is_revisit, F.lit("").cast("binary")).otherwise(F.coalesce(F.col("payload").cast("binary"), F.lit("").cast("binary")))
    made = records.withColumn("__body", body)
    total, n = made.agg(F.sum(F.octet_length("__body") + 400), F.count(F.lit(1))).first()
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:record:"), F.col("record_id").cast("string"), F.lit(">"))),
        _header("WARC-Date", F.col("date")),
        _header("WARC-Target-URI", F.col("target_uri")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _header("WARC-Profile", F.when(is_revisit, F.lit(PROFILE))),
        _header("WARC-Refers-To", F.concat(F.lit("<urn:record:"), F.col("refers_to").cast("string"), F.lit(">"))),
        _header("Content-Type", F.lit("text/html")),
        _header("Content-Length", F.octet_length("__body")),
        F.lit("\r\n"),
    )
    record = F.concat(head.cast("binary"), F.col("__body")).cast("string")
    per_archive = max(1, archive_bytes * n // total) if n else 1
    lines = made.select(record.alias("value")).write.option("maxRecordsPerFile", per_archive)
    lines.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def parse_archive(data: bytes) -> Iterator[tuple]:
    """Records of an archive: by Content-Length, so payloads may look like records."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}: {lines[0][:40]!r}")
        headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        start, size = end + 4, int(headers["content-length"])
        name = lambda key: h[len("<urn:record:") : -1] if (h := headers.get(key)) else None  # noqa: B023, E731
        digest = headers.get("warc-payload-digest")
        yield (
            name("warc-record-id"),
            headers.get("warc-type"),
            headers.get("warc-target-uri"),
            headers.get("warc-date"),
            digest.partition(":")[2] if digest else None,
            name("warc-refers-to"),
            size,
            data[start : start + size],
        )
        at = start + size + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``; see :data:`RECORD`.  Archives are read one at a time."""
    names = [part.split(" ")[0] for part in RECORD.split(", ")]
    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(0)[i].as_py()
                held: list[tuple] = []
                size = 0
                for record in parse_archive(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    held.append(record)
                    size += len(record[-1])
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def read_digest() -> Column:
    """Digest of a record's full payload: computed anew for a response, the header's for a revisit."""
    return F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("payload_digest"))


def deduplicate_pages(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", date: str | None = None, least: int = LEAST_REVISIT_BYTES) -> None:
    """Write one record per page below ``path``, repeated payloads as revisits.  Null html is the empty payload."""
    body = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    when = F.col(f"`{date}`") if date else F.lit("1970-01-01T00:00:00Z")
    base = pages.select(F.col(f"`{key}`").alias("record_id"), F.col(f"`{url}`").alias("target_uri"), when.alias("date"), body.alias("payload"))
    records = base.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    write_archives(resolve(records, least), path)


def deduplicate_archives(spark: SparkSession, source: str, path: str, least: int = LEAST_REVISIT_BYTES) -> None:
    """Rewrite archives: responses of one payload become revisits of the first, under fresh headers.

    Revisits already there are followed to their response first; one whose
    response is in none of the archives stays as it is.
    """
    records = read_archives(spark, source)
    held = stored(records.select("record_id", "target_uri", "date", "payload_digest", "record_type", "refers_to", "payload"), "records")
    responses = held.filter("record_type = 'response'").withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("record_type", "refers_to")
    fresh = resolve(responses, least)
    moved = fresh.filter("record_type = 'revisit'").select(F.col("record_id").alias("refers_to"), F.col("refers_to").alias("__now"))
    revisits = held.filter("record_type = 'revisit'").join(moved, "refers_to", "left").withColumn("refers_to", F.coalesce("__now", "refers_to")).drop("__now")
    write_archives(fresh.drop("payload_bytes").unionByName(revisits), path)


def resolved_sizes(records: DataFrame) -> DataFrame:
    """Records with revisits' ``payload_bytes`` taken from the response they refer to (null if it is not there)."""
    heads = records.select("record_id", "record_type", "refers_to", "payload_digest", "payload_bytes")
    sizes = heads.filter("record_type = 'response'").groupBy(F.col("record_id").alias("__of")).agg(F.max("payload_bytes").alias("__size"))
    joined = heads.join(sizes, (F.col("record_type") == "revisit") & (F.col("refers_to") == F.col("__of")), "left")
    return joined.withColumn("payload_bytes", F.when(F.col("record_type") == "revisit", F.col("__size")).otherwise(F.col("payload_bytes"))).drop("__of", "__size")

