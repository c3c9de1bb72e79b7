"""The operators applied to whole tables, as named queries."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch.llm import alignment, bpe, conversations, exact_dedup, language, licences, pack, quality, simhash, token_counts, urls, vectors, warc
from lotwatch.session import fresh_folder, stored

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def packed(docs: DataFrame, remembered: int = pack.REMEMBERED_PARTS) -> DataFrame:
    """Pieces of at most 2048 tokens of all documents with their places; the ids are kept as a checksum."""
    pieces = pack.token_pieces(docs, BYTE_BPE, keep=["doc_id"], remembered=remembered)
    return pack.pack(pieces.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", F.crc32("ids").alias("ids_crc32")))


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, folder, "documents"))


def op3_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"), licences.known_digests(spark))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """All documents are inserted; those of several lines are revised without their first line; short ones
    are deleted; what is left is counted by a second tokenizer; and a batch is replayed."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "text", F.lit(False).alias("deleted"))
    words, marks = token_counts.pattern_counter(token_counts.WORDS), token_counts.pattern_counter(token_counts.WORDS_AND_MARKS)
    body = F.regexp_replace("text", r"(?s)^[^\n]*\n", "")
    revised = docs.filter(F.contains("text", F.lit("\n"))).withColumn("text", body)
    rollup = token_counts.TokenRollup(spark, fresh_folder(spark, "tokens"))
    rollup.apply("crawl", docs, "words-1", words)
    rollup.apply("revise", revised, "words-1", words)
    gone = rollup.counts().filter("tokenizer = 'words-1' AND tokens < 50").select("doc_id")
    gone = stored(gone, "short").select("doc_id", *(F.lit(None).cast("string").alias(c) for c in ("source", "lang", "text")), F.lit(True).alias("deleted"))
    rollup.apply("delete", gone, "words-1", words)
    left = docs.withColumn("text", F.when(F.contains("text", F.lit("\n")), body).otherwise(F.col("text")))
    rollup.apply("second", left, "words-and-marks-1", marks, only=rollup.counts())
    rollup.apply("revise", revised, "words-1", words)
    return stored(rollup.totals(), "totals")


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_folder(spark, "warc")
    warc.deduplicate_pages(table(spark, folder, "pages"), path)
    heads = stored(warc.read_archives(spark, path).withColumn("payload_digest", warc.read_digest()).drop("payload"), "heads")
    return warc.resolved_sizes(heads).select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


def op6_topk(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    encoded = bpe.bpe_encode(docs, BYTE_BPE, keep=["doc_id"]).select(
        "doc_id",
        "ids",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
    )
    decoded = bpe.bpe_decode(encoded, BYTE_BPE)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.fit(docs, table(spark, folder, "labels"))
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


URL_RULES = [
    urls.Rule("org/", "allow"),
    urls.Rule("example.org/es/", "block"),
    urls.Rule("example.org/en/1", "block"),
    urls.Rule("com/fr/", "allow"),
    urls.Rule("com/de/", "block"),
]


def op9_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"), URL_RULES)


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op11_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language.predict(docs, language.fit(docs), keep=["doc_id"])
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"), BYTE_BPE, PIECE_BPE)


def op13_conversations(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return conversations.with_missing(conversations.repair(conversations.damage(rows)), rows)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_licences": op3_licences,
    "op4_token_counts": op4_token_counts,
    "op5_warc": op5_warc,
    "op6_topk": op6_topk,
    "op7_bpe": op7_bpe,
    "op8_quality": op8_quality,
    "op9_urls": op9_urls,
    "op10_simhash": op10_simhash,
    "op11_language": op11_language,
    "op12_alignment": op12_alignment,
    "op13_conversations": op13_conversations,
}

# The rules of op3 in SQL, written out apart from the operator; only the known texts are the same.
_KEPT = r"""list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT (
    (regexp_matches(lower(x), '^[^\p{L}\p{N}(©&]*copyright[ \t]*[:,]?[ \t]*(\(c\)|©|&copy;)')
     OR regexp_matches(lower(x), '^[^\p{L}\p{N}(©&]*copyright[ \t]*[:,]?[ \t]*(by[ \t]+)?[\[<{]?(1[89]\d\d|20\d\d|yyyy|year)')
     OR regexp_matches(lower(x), '^[^\p{L}\p{N}(©&]*(\(c\)|©|&copy;)[ \t]*(copyright|[\[<{]?(1[89]\d\d|20\d\d|yyyy|year))'))
    AND len(list_intersect(regexp_split_to_array(x, '[^\p{L}\p{N}]+'), ['is', 'are', 'was', 'were', 'be', 'been', 'has', 'have', 'had', 'must', 'shall', 'should', 'may',
        'might', 'can', 'could', 'will', 'would', 'do', 'does', 'did', 'applies', 'apply', 'protects', 'protect', 'means', 'you', 'we', 'this'])) = 0
    OR trim(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g')) = 'all rights reserved'))"""
_SPELT = rf"regexp_replace(replace(lower(array_to_string({_KEPT}, chr(10))), '©', ' copyright '), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
for _given, _one in (
    ("licence", "license"), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"), ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("judgement", "judgment"),
    ("favour", "favor"), ("programme", "program"),
):
    _SPELT = f"replace({_SPELT}, '{_given}', '{_one}')"
_LINES = f"list_filter(list_transform(string_split({_SPELT}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_KNOWN = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licences.KNOWN)

ORACLES: dict[str, str] = {
    "op3_licences": f"""
        WITH k AS (
            SELECT min(licence) AS licence, sha256(array_to_string({_LINES}, ' ')) AS digest FROM (VALUES {_KNOWN}) t(licence, text) GROUP BY 2
        ),
        d AS (SELECT doc_id, {_LINES} AS lines FROM documents),
        hits AS (
            SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices, count(*) AS notice_lines
            FROM (SELECT doc_id, sha256(unnest(lines)) AS digest FROM d) JOIN k USING (digest) GROUP BY doc_id
        )
        SELECT d.doc_id, sha256(array_to_string(lines, ' ')) AS canonical_sha256, k.licence,
               coalesce(notices, '') AS notices, coalesce(notice_lines, 0) AS notice_lines
        FROM d LEFT JOIN k ON k.digest = sha256(array_to_string(lines, ' ')) LEFT JOIN hits USING (doc_id)
    """,
    "op4_token_counts": r"""
        WITH d AS (
            SELECT source, lang, CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE coalesce(text, '') END AS body
            FROM documents WHERE doc_id IS NOT NULL
        ),
        c AS (
            SELECT *, len(regexp_extract_all(body, '[^ \t\r\n]+')) AS words,
                   len(regexp_extract_all(body, '[\p{L}\p{N}]+|[^ \t\r\n\p{L}\p{N}]')) AS marks FROM d
        ),
        kept AS (SELECT * FROM c WHERE words >= 50),
        each AS (
            SELECT source, lang, 'words-1' AS tokenizer, words AS tokens FROM kept
            UNION ALL SELECT source, lang, 'words-and-marks-1', marks FROM kept
        )
        SELECT source, lang, tokenizer, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens FROM each GROUP BY ALL
    """,
    "op6_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM s
        WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER best <= 10
    """,
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        s AS (SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest,
                     min(page_id) OVER (PARTITION BY body) AS original FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> original THEN original END AS refers_to
        FROM s
    """,
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
