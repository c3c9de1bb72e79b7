"""The named queries once more, as DuckDB SQL over the same tables.

Written independently of the Spark side: each states the result from the raw
tables, so that the two can be compared row by row.
"""

from __future__ import annotations

LATEST = """
li AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                 ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn
    FROM lineitem) WHERE rn = 1)"""

VIEW = LATEST + """,
t AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS tender_id,
         'o-' || l_orderkey || '-' || l_linenumber AS tender_number,
         l_extendedprice AS awarded_amount, s_name AS supplier_name, n_name AS buyer_name,
         p_name AS title, p_type AS cpv_main, p_brand AS cpv_description, o_orderdate AS date_created
  FROM li JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey)"""

ITEMS = """
i AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS tender_id, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS item_id,
         p_name AS description, p_type AS cpv, l_quantity AS quantity,
         l_extendedprice / l_quantity AS unit_amount, l_extendedprice AS line_total
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

ORDERS = """
o AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS tender_id, 'o-' || o_orderkey AS tender_number,
         'Order ' || o_orderpriority AS title, o_orderstatus AS status, 'Customer ' || o_custkey AS buyer_name,
         CAST(NULL AS VARCHAR) AS buyer_region,
         CASE WHEN o_orderstatus <> 'P' THEN 'Clerk ' || o_orderstatus END AS supplier_name,
         o_orderpriority AS cpv_main, o_orderpriority AS cpv_description, o_totalprice AS budget_amount,
         'UAH' AS budget_currency, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS awarded_amount,
         'UAH' AS awarded_currency, o_orderdate AS date_created
  FROM orders)"""

NOT_MASKED = "supplier_name IS NOT NULL AND supplier_name NOT ILIKE '%#000000007%'"

PLACES = """
words AS (
  SELECT k, md5(w) AS h FROM (SELECT k, unnest(regexp_extract_all(lower(txt), '[\\p{{L}}\\p{{N}}]+')) AS w FROM ({source}))),
sums AS (
  SELECT k, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % 64 AS place,
         sum(CASE WHEN CAST(('0x' || substr(h, 9, 1)) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS s
  FROM words GROUP BY ALL),
unit AS (
  SELECT k, place, CAST(CAST(s AS DOUBLE) / sqrt(sum(CAST(s AS DOUBLE) * s) OVER (PARTITION BY k)) AS FLOAT) AS weight
  FROM sums WHERE s <> 0)"""

PROBES = """
parts AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS place FROM embeddings),
means AS (SELECT label, place, avg(x) AS x FROM parts GROUP BY ALL),
probes AS (SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY place) AS q FROM means GROUP BY label),
ranked AS (
  SELECT query_id, vec_id AS id, label, round(list_cosine_distance(q, embedding::DOUBLE[]), 9) AS distance
  FROM probes, embeddings),
hits AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM ranked)"""

ISO2 = "strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S')"
ANSWERS = """
a AS (
  SELECT o_orderkey AS answer_id, own,
         'Order_' || o_orderkey AS head, CASE WHEN o_orderstatus <> 'P' THEN own ELSE 'no id' END AS cited,
         o_custkey AS kg, o_orderstatus, o_orderpriority, o_custkey % 5 AS sample_size,
         'A' || o_custkey AS other
  FROM (SELECT *, 'UA-' || strftime(o_orderdate, '%Y-%m-%d') || '-' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') || '-a' AS own
        FROM orders))"""


def _link(x: str) -> str:
    return f"'[' || {x} || '](https://example.org/tender/' || {x} || ')'"


_BODY = "{head} || {won} || {cited} || ', вага ' || kg || ' кг, ' || {links} || ' 15 км.'"
_RAW_TEXT = _BODY.format(
    head="head", won="' *won* '", cited="cited", links="'[site](https://example.org/x) and www.example.com/y'"
)
_ESCAPED = _BODY.format(
    head="replace(head, '_', '\\_')", won="' \\*won\\* '",
    cited="CASE WHEN o_orderstatus = 'F' THEN " + _link("own") + " ELSE cited END",
    links="'\\[site](https://example.org/x) and www.example.com/y'",
)
# Known ids: status O has none; P knows ids but cites none; F cites a known one.
_UNGROUNDED = "CASE WHEN o_orderpriority = '5-LOW' THEN '15 км; ' || kg || ' кг' ELSE '15 км' END"
# Sorted: texts compare by character; "15 км" against "<kg> кг".
_UNGROUNDED_SORTED = (
    "CASE WHEN o_orderpriority <> '5-LOW' THEN '15 км' "
    "WHEN kg || ' кг' < '15 км' THEN kg || ' кг' || {sep} || '15 км' ELSE '15 км' || {sep} || kg || ' кг' END"
)
_PROOF = (
    "CASE WHEN own < other THEN " + _link("own") + " || ', ' || " + _link("other")
    + " ELSE " + _link("other") + " || ', ' || " + _link("own") + " END"
)

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

_ROUTE = """
CASE WHEN regexp_matches(x, 'why\\?|ente\\.|same') THEN 'followup'
     WHEN regexp_matches(x, 'schw|ring') THEN 'investigation:splitting'
     WHEN regexp_matches(x, 'thand|elle') THEN 'investigation:monopoly'
     WHEN regexp_matches(x, 'ción|ment') THEN 'investigation:overpricing'
     WHEN starts_with(x, 'is ') OR starts_with(x, 'le ') OR starts_with(x, 'der ') THEN 'vector'
     WHEN contains(x, 'über') OR contains(x, 'que') OR contains(x, 'hand') THEN 'vector'
     WHEN contains(x, 'the') OR contains(x, 'und') OR contains(x, 'los') OR contains(x, 'la ') THEN 'sql'
     ELSE 'vector' END"""

_MERGED = LATEST  # merging the parts in any order gives the newest version of all rows

_DEVIATION = """
m AS (SELECT cpv_main, median(awarded_amount) AS med, count(awarded_amount) AS n FROM {rows} WHERE cpv_main IS NOT NULL GROUP BY 1)
SELECT {columns}, cpv_main, awarded_amount,
       CASE WHEN n >= 2 THEN round((awarded_amount - med) / nullif(med, 0) * 100, 6) END AS price_deviation_pct
FROM {rows} LEFT JOIN m USING (cpv_main)"""

_SPLITTING = f"""WITH {VIEW}
SELECT buyer_name, supplier_name, count(*) AS n_contracts, round(sum(awarded_amount), 2) AS total_amount,
       min(awarded_amount) AS min_amount, max(awarded_amount) AS max_amount, CAST(0 AS BIGINT) AS evidence_page,
       string_agg(tender_number, ', ' ORDER BY tender_number) AS tender_numbers
FROM t WHERE awarded_amount BETWEEN 90000 AND 99999 AND buyer_name IS NOT NULL AND {NOT_MASKED} {{extra}}
GROUP BY buyer_name, supplier_name HAVING count(*) >= 3
ORDER BY n_contracts DESC, total_amount DESC, buyer_name, supplier_name LIMIT 20"""


def _ranking(rows: str, where: str) -> str:
    return f"""
w AS (SELECT * FROM {rows} WHERE {where})
SELECT supplier_name, count(*) AS n_wins, round(sum(awarded_amount), 2) AS total_amount,
       round(round(sum(awarded_amount), 2) / (SELECT round(sum(awarded_amount), 2) FROM w), 6) AS share_of_total
FROM w GROUP BY supplier_name ORDER BY n_wins DESC, total_amount DESC, supplier_name LIMIT 20"""


_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _TABLES)

ORACLES: dict[str, str] = {
    # --- reports
    "splitting_scan": _SPLITTING.format(extra=""),
    "splitting_one_buyer": _SPLITTING.format(extra="AND buyer_name ILIKE '%nation_7%'"),
    "supplier_concentration": f"""WITH {VIEW},
        w AS (SELECT * FROM t WHERE buyer_name ILIKE '%nation_7%' AND {NOT_MASKED})
        SELECT supplier_name, count(*) AS n_wins, round(sum(awarded_amount), 2) AS total_amount,
               round(round(sum(awarded_amount), 2) / (SELECT round(sum(awarded_amount), 2) FROM w), 6) AS share_of_total,
               CAST(0 AS BIGINT) AS evidence_page, string_agg(tender_number, ', ' ORDER BY tender_number) AS tender_numbers
        FROM w GROUP BY supplier_name ORDER BY n_wins DESC, total_amount DESC, supplier_name LIMIT 20""",
    "supplier_ranking_masked": f"WITH {VIEW}, "
    + _ranking("t", f"supplier_name <> 'Supplier#000000003' AND {NOT_MASKED}"),
    "category_hedge_ranking": f"WITH {VIEW}, "
    + _ranking("t", f"(starts_with(cpv_main, 'PROMO') OR cpv_description ILIKE '%red%' OR title ILIKE '%red%') AND {NOT_MASKED}"),
    "repeat_supplier": f"WITH {VIEW} SELECT buyer_name, supplier_name, count(*) AS n_rows FROM t WHERE {NOT_MASKED} "
    "GROUP BY ALL HAVING count(*) >= 2",
    "item_statistics": f"""WITH {ITEMS}
        SELECT round(avg(unit_amount), 6) AS avg_unit_amount, max(unit_amount) AS max_unit_amount, count(*) AS sample_size,
               round(median(unit_amount), 6) AS median_unit_amount
        FROM i WHERE description ILIKE '%red%' AND unit_amount IS NOT NULL""",
    "item_overpricing": f"""WITH {ITEMS}, {ORDERS},
        s AS (SELECT round(avg(unit_amount), 6) AS a, median(unit_amount) AS m, max(unit_amount) AS x, count(*) AS n
              FROM i WHERE description ILIKE '%red plate%' AND unit_amount IS NOT NULL)
        SELECT tender_number, description, round(unit_amount, 6) AS unit_amount, a AS avg_unit_amount,
               round(m, 6) AS median_unit_amount, n AS sample_size, round(unit_amount / m, 6) AS ratio_to_median
        FROM i JOIN s ON true JOIN o USING (tender_id) WHERE description ILIKE '%red plate%' AND unit_amount = x""",
    "item_price_outliers": f"""WITH {ITEMS},
        s AS (SELECT round(avg(unit_amount), 6) AS a, count(*) AS n FROM i WHERE description ILIKE '%red%')
        SELECT tender_id, item_id, description, round(unit_amount, 6) AS unit_amount, a AS avg_unit_amount, n AS sample_size
        FROM i JOIN s ON true WHERE description ILIKE '%red%' AND unit_amount > a * 1.3
        ORDER BY i.unit_amount DESC, tender_id, item_id LIMIT 20""",
    "small_sample_caveat": f"""WITH {ITEMS}, g AS (SELECT description, cpv, count(*) AS n FROM i GROUP BY ALL)
        SELECT CAST(min(n) AS DOUBLE) AS min_sample_size, min(n) < 30 AS is_small_sample FROM g""",
    "category_total_no_fanout": f"""WITH {ORDERS}
        SELECT cpv_main, round(sum(awarded_amount), 2) AS total_amount,
               round(sum(awarded_amount), 2) / count(awarded_amount) AS avg_amount, count(*) AS n_tenders FROM o GROUP BY cpv_main""",
    "fanout_semijoin": f"""WITH {ORDERS}, {ITEMS}
        SELECT round(sum(awarded_amount), 2) AS total_amount,
               round(sum(awarded_amount), 2) / count(awarded_amount) AS avg_amount, count(*) AS n_tenders
        FROM o WHERE starts_with(cpv_main, '1-') OR tender_id IN (SELECT tender_id FROM i WHERE description ILIKE '%RED p%')""",
    "category_avg_and_top": f"""WITH {ORDERS}, c AS (SELECT * FROM o WHERE starts_with(cpv_main, '1-')),
        top AS (SELECT buyer_name, awarded_amount FROM c WHERE awarded_amount IS NOT NULL ORDER BY awarded_amount DESC, tender_id LIMIT 1)
        SELECT (SELECT round(sum(awarded_amount), 2) / count(awarded_amount) FROM c) AS average_amount, buyer_name,
               awarded_amount AS max_single_payment FROM top""",
    "category_year_count": f"""WITH {VIEW} SELECT count(*) AS n_tenders FROM t WHERE year(date_created) = 1997
        AND (starts_with(cpv_main, 'PROMO') OR cpv_description ILIKE '%red%' OR title ILIKE '%red%')""",
    "market_stats": f"""WITH {ORDERS}
        SELECT count(*) AS n_tenders, count(awarded_amount) AS n_awarded, strftime(min(date_created), '%Y-%m-%d') AS first_day,
               strftime(max(date_created), '%Y-%m-%d') AS last_day,
               (SELECT count(*) FROM lineitem JOIN part ON l_partkey = p_partkey) AS n_items FROM o""",
    "tender_analysis": f"""WITH {ORDERS}, one AS (SELECT * FROM o WHERE tender_number = 'o-7'),
        s AS (SELECT round(sum(awarded_amount), 2) / count(awarded_amount) AS a FROM o
              WHERE cpv_main = (SELECT cpv_main FROM one) AND tender_number <> 'o-7')
        SELECT tender_number, title, status, buyer_name, buyer_region, supplier_name, cpv_main, cpv_description, budget_amount,
               budget_currency, awarded_amount, awarded_currency, round(a, 4) AS category_avg,
               round(awarded_amount / a, 6) AS ratio, coalesce(awarded_amount / a >= 1.3, false) AS is_anomaly,
               false AS supplier_masked, replace(format('{{:,.2f}}', awarded_amount), ',', ' ') AS awarded_text FROM one, s""",
    "tender_analysis_all": f"""WITH {ORDERS},
        s AS (SELECT cpv_main, round(sum(awarded_amount), 2) AS total, count(awarded_amount) AS n FROM o GROUP BY 1),
        l AS (SELECT *, (total - coalesce(awarded_amount, 0)) / nullif(n - (awarded_amount IS NOT NULL)::INT, 0) AS a FROM o LEFT JOIN s USING (cpv_main))
        SELECT tender_number, a AS category_avg, CASE WHEN a > 0 THEN awarded_amount / a END AS ratio,
               coalesce(awarded_amount / a >= 1.3, false) AS is_anomaly,
               coalesce(lower(supplier_name) LIKE '%clerk o%', false) AS supplier_masked FROM l""",
    "price_deviation": f"WITH {VIEW}, " + _DEVIATION.format(rows="t", columns="tender_number"),
    "resume_cursor": "SELECT strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS cursor FROM events",
    "staleness_check": """SELECT round((epoch_us(TIMESTAMP '2024-02-01 08:30:00') - epoch_us(max(ts))) / 3600000000.0, 6) AS hours_since_sync,
        (epoch_us(TIMESTAMP '2024-02-01 08:30:00') - epoch_us(max(ts))) / 3600000000.0 > 30 AS is_stale FROM events""",
    "result_preview": f"""WITH {ORDERS} SELECT tender_number, budget_amount, (SELECT count(*) > 30 FROM o) AS is_truncated
        FROM o ORDER BY budget_amount DESC, tender_number LIMIT 30""",
    "known_evidence_ids": f"""SELECT DISTINCT supplier_name, trim(unnest(string_split(tender_numbers, ','))) AS tender_number
        FROM ({_SPLITTING.format(extra="AND buyer_name ILIKE '%nation_7%'")})""",
    "ad_hoc_union": f"""WITH {ORDERS}, {ITEMS}
        SELECT 'tender' AS kind, cpv_main AS label, count(*) AS n_rows FROM o WHERE awarded_amount >= 50000 GROUP BY cpv_main
        UNION SELECT 'item', cpv, count(*) FROM i WHERE line_total >= 50000 GROUP BY cpv""",
    # --- filters
    "masked_flag": """SELECT s_suppkey, s_name <> 'Supplier#000000003' AND contains(s_name, '#000000007') AS is_masked,
        CASE WHEN s_name = 'Supplier#000000003' THEN false ELSE NOT contains(s_name, '#000000007') END AS is_party FROM supplier""",
    "category_names": """SELECT CASE 29 + p_size % 8
          WHEN 30 THEN 'office supplies, paper' WHEN 31 THEN 'generators, electrical equipment, batteries'
          WHEN 33 THEN 'medical equipment, medicines, pharmaceuticals'
          WHEN 34 THEN 'transport, unmanned aerial vehicles, aircraft'
          WHEN 35 THEN 'security, fire and rescue equipment, electronic protection' END AS category,
        count(*) AS n_parts FROM part GROUP BY 1""",
    "key_list_lookup": f"""WITH {ORDERS} SELECT tender_number, budget_amount FROM o
        WHERE tender_number IN ('o-1', 'o-5', 'o-9', 'o-12345')""",
    "relevance_filter": f"""WITH {ORDERS}, {ITEMS} SELECT tender_id, title FROM o WHERE title ILIKE '%urgent%' OR tender_id IN
        (SELECT tender_id FROM i WHERE starts_with(cpv, 'PROMO') OR description ILIKE '%red plate%')""",
    "relevance_filter_raw": f"""WITH {LATEST} SELECT l_orderkey || '-' || l_linenumber AS tender_id FROM li
        WHERE l_linenumber = 3 OR (l_discount > 0 AND (l_returnflag = 'N' OR starts_with(CAST(l_partkey AS VARCHAR), '11')))""",
    # --- versions and merges
    "latest_version_dedup": f"WITH {LATEST} SELECT * FROM li",
    "item_arrival_dedup": """SELECT * EXCLUDE (rn), l_partkey * 100000 + l_suppkey AS arrival FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
          ORDER BY l_partkey * 100000 + l_suppkey DESC, l_shipdate DESC, l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1""",
    "duplicate_key_check": "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "upsert_merge": f"WITH {_MERGED} SELECT * FROM li",
    "incremental_equals_full": f"WITH {_MERGED} SELECT * FROM li",
    "deviation_after_merge": f"""WITH {_MERGED}, r AS (SELECT l_orderkey, l_linenumber, p_type AS cpv_main, l_extendedprice AS awarded_amount
        FROM li JOIN part ON l_partkey = p_partkey), """ + _DEVIATION.format(rows="r", columns="l_orderkey, l_linenumber"),
    "replace_children_merge": """SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn
        FROM lineitem WHERE l_shipdate >= '1998-06-01'
          OR l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= '1998-06-01')) WHERE rn = 1""",
    "union_by_name": """SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
        UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier""",
    # --- feed, landing, streaming
    "change_feed_ascending": "SELECT * FROM events WHERE ts > '2024-01-15' ORDER BY ts, event_id LIMIT 2000",
    "change_feed_newest": "SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500",
    "landing_skip_existing": "SELECT doc_id, lang, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "landing_overwrite": """SELECT doc_id, lang, CASE WHEN lang <> 'en' THEN 'revised' ELSE source END AS source FROM documents
        WHERE lang <> 'en' OR doc_id IN (SELECT doc_id FROM labels)""",
    "raw_landing_roundtrip": f"""WITH {LATEST}
        SELECT CASE WHEN l_discount = 0 THEN 'unreadable' WHEN l_tax = 0 THEN 'not an object' WHEN l_discount = 0.1 THEN 'no id'
                    WHEN l_tax = 0.08 THEN 'malformed' ELSE 'ok' END AS outcome, count(*) AS n_documents FROM li GROUP BY 1""",
    "store_incremental_deviation": f"""WITH {LATEST}, r AS (SELECT l_orderkey || '-' || l_linenumber AS tender_id,
          CASE WHEN l_discount > 0 THEN l_returnflag END AS cpv_main,
          CASE WHEN l_tax > 0 OR l_linestatus <> 'O' THEN l_extendedprice END AS awarded_amount FROM li), """
    + _DEVIATION.format(rows="r", columns="tender_id"),
    "run_update_ties": "SELECT CAST(event_id AS VARCHAR) AS tender_id, date_trunc('day', ts) AS date_modified, event_type AS cpv_main FROM events",
    "run_update_undated": """SELECT CAST(event_id AS VARCHAR) AS tender_id, CASE WHEN event_type <> 'error' THEN date_trunc('day', ts) END AS date_modified,
        'up_to_date' AS last_status FROM events""",
    "run_update_rejects": """SELECT CASE WHEN event_type = 'click' THEN 'unreadable' ELSE 'ok' END AS outcome,
        CAST(event_id AS VARCHAR) AS document FROM events""",
    "run_status": """WITH n AS (SELECT count(*) FILTER (event_type <> 'click') AS good, count(*) FILTER (event_type = 'click') AS bad FROM events)
        SELECT CAST(1 AS BIGINT) AS batch_seq, CAST(1 AS BIGINT) AS batch_id, 'no_baseline' AS status, CAST(0 AS BIGINT) AS n_tenders,
               CAST(0 AS BIGINT) AS n_rejected, CAST(0 AS BIGINT) AS n_items, CAST(0 AS BIGINT) AS n_duplicates
        UNION ALL SELECT 2, 1, 'ok', 2 * good, 2 * bad, 2 * good, good FROM n UNION ALL SELECT 3, 2, 'up_to_date', 0, 0, 0, 0""",
    "quality_report": "SELECT CAST(0 AS BIGINT) AS n_duplicate_keys, count(*) AS n_tenders, count(*) AS n_items FROM events",
    "embed_all": "SELECT CAST(event_id AS VARCHAR) AS id, true AS has_vector FROM events",
    "two_streams_one_table": "SELECT event_id, event_type, value FROM events",
    "line_stream_store": f"""WITH {LATEST}, r AS (SELECT l_orderkey || '-' || l_linenumber AS tender_id,
          CASE WHEN l_discount > 0 THEN l_returnflag END AS cpv_main,
          CASE WHEN l_tax > 0 OR l_linestatus <> 'O' THEN l_extendedprice END AS awarded_amount FROM li), """
    + _DEVIATION.format(rows="r", columns="tender_id"),
    "price_deviation_dirty": """WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS tender_id, o_orderstatus AS cpv_main,
          CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN NULL WHEN o_custkey % 7 = 0 THEN 0 WHEN o_custkey % 7 = 1 THEN -12.5
               WHEN o_custkey % 7 = 2 THEN 1e-300 ELSE CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) END::DOUBLE AS awarded_amount FROM orders), """
    + _DEVIATION.format(rows="r", columns="tender_id"),
    "report_states": """SELECT * FROM (VALUES ('nobody', 'empty', false), ('monopoly', 'missing_parameter', NULL),
        ('prices', 'ok', true)) t(report, status, names_no_party) WHERE EXISTS (SELECT 1 FROM orders)""",
    "vector_knn_all_lists": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
        d AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_distance(q.v, c.v), 9) AS distance
              FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d)
        SELECT query_id, rank, id, round(distance, 6) AS distance FROM r WHERE rank <= 5""",
    "touched_rows": "SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "missing_rows": """SELECT DISTINCT l_orderkey FROM lineitem
        WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
    "stream_ingest_events": """SELECT event_id, CASE WHEN event_type = 'error' THEN ts + INTERVAL 1 DAY ELSE ts END AS ts, event_type,
        CASE WHEN event_type = 'error' THEN value + 1 ELSE value END AS value FROM events""",
    # --- nested documents
    "json_flatten_tenders": f"""WITH {LATEST}
        SELECT l_orderkey || '-' || l_linenumber AS tender_id, 'o-' || l_orderkey || '-' || l_linenumber AS tender_number,
               'Line ' || l_linenumber AS title, l_linestatus AS status, NULL::VARCHAR AS procurement_method,
               NULL::VARCHAR AS procurement_method_type, NULL::VARCHAR AS main_procurement_category,
               CASE WHEN l_returnflag <> 'N' THEN l_shipdate - INTERVAL 2 HOUR END AS date_created,
               l_shipdate - INTERVAL 2 HOUR AS date_modified, NULL::TIMESTAMP AS notice_publication_date,
               CASE WHEN l_discount > 0 THEN l_returnflag END AS cpv_main,
               CASE WHEN l_discount > 0 THEN l_linestatus END AS cpv_description,
               CAST(CASE WHEN l_discount > 0 THEN 2 ELSE 0 END AS BIGINT) AS n_items,
               l_extendedprice AS budget_amount, 'UAH' AS budget_currency, l_tax > 0 AS vat_included,
               CASE WHEN l_tax > 0 OR l_linestatus <> 'O' THEN l_extendedprice END AS awarded_amount,
               CASE WHEN l_tax > 0 OR l_linestatus = 'O' THEN CASE WHEN l_returnflag = 'A' THEN 'USD' ELSE 'UAH' END
                    ELSE 'EUR' END AS awarded_currency,
               0::BIGINT AS n_bids, 2::BIGINT AS n_awards, 1::BIGINT AS n_contracts,
               'Supplier ' || (l_suppkey + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS supplier_name,
               CAST(l_suppkey + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS VARCHAR) AS supplier_edrpou,
               'Buyer ' || l_returnflag AS buyer_name, NULL::VARCHAR AS buyer_edrpou, NULL::VARCHAR AS buyer_kind,
               'Kyiv' AS buyer_region, NULL::VARCHAR AS buyer_country,
               l_orderkey || '-' || l_linenumber || '.json' AS source_file FROM li""",
    "json_flatten_items": f"""WITH {LATEST}
        SELECT l_orderkey || '-' || l_linenumber AS tender_id, l_linenumber || p AS item_id, 'Part ' || l_partkey AS description,
               l_returnflag AS cpv, l_linestatus AS cpv_description, l_quantity AS quantity, 'piece' AS unit_name,
               NULL::VARCHAR AS unit_code, CASE WHEN p = 'a' THEN l_extendedprice END AS unit_amount, 'UAH' AS unit_currency,
               CASE WHEN p = 'a' THEN l_extendedprice * l_quantity END AS line_total, NULL::VARCHAR AS delivery_region,
               l_shipdate - INTERVAL 2 HOUR AS delivery_end_date, l_orderkey || '-' || l_linenumber || '.json' AS source_file,
               CAST(p = 'b' AS BIGINT) AS position
        FROM li, (VALUES ('a'), ('b')) AS v(p) WHERE l_discount > 0""",
    "quarantine": f"""WITH {LATEST}
        SELECT CASE WHEN l_discount = 0 THEN 'unreadable' WHEN l_tax = 0 THEN 'not an object' WHEN l_discount = 0.1 THEN 'no id'
                    WHEN l_tax = 0.08 THEN 'malformed' ELSE 'ok' END AS outcome, count(*) AS n_documents FROM li GROUP BY 1""",
    "json_props": """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, NULL::VARCHAR AS deeper,
        'none' AS missing FROM events""",
    "pick_last_active": f"""WITH {LATEST} SELECT l_orderkey, l_linenumber,
        CASE WHEN l_tax = 0 THEN NULL WHEN l_linestatus = 'O' THEN 'second' WHEN l_returnflag = 'A' THEN 'first' ELSE 'third' END AS picked FROM li""",
    "coerce_types": f"""SELECT 'o-' || o_orderkey AS tender_id,
        CASE WHEN regexp_matches(x, '{NUMBER}') AND isfinite(TRY_CAST(x AS DOUBLE)) THEN TRY_CAST(x AS DOUBLE) END AS awarded_amount,
        CASE WHEN o_orderstatus <> 'P' THEN o_orderdate - INTERVAL 3 HOUR END AS date_created,
        o_custkey AS n_bids, NULL::VARCHAR AS title
        FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN '' WHEN '2-HIGH' THEN '1_000' WHEN '3-MEDIUM' THEN 'NaN' WHEN '5-LOW' THEN '1e999'
              ELSE CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) END AS x FROM orders)""",
    # --- text
    "route_questions": f"""SELECT conv_id, turn, {_ROUTE} AS route
        FROM (SELECT conv_id, turn, lower(trim(text)) AS x FROM conversations WHERE role = 'user')""",
    "route_summary": f"""SELECT {_ROUTE} AS route, count(*) AS n_questions
        FROM (SELECT lower(trim(text)) AS x FROM conversations WHERE role = 'user') GROUP BY 1""",
    "route_questions_default": """SELECT conv_id, turn, role,
        ['followup', 'investigation:splitting', 'investigation:monopoly', 'investigation:overpricing', 'sql', 'vector', 'vector', 'vector'][conv_id % 8 + 1] AS route
        FROM conversations""",
    "empty_in_empty_out": "SELECT * FROM (VALUES ('tenders', 0::BIGINT, 29), ('items', 0::BIGINT, 14), ('deviation', 0::BIGINT, 30)) t(table_name, n_rows, n_columns)",
    "role_prefixes": "WITH " + PLACES.format(source="SELECT 'passage' || doc_id AS k, 'passage: ' || text AS txt FROM documents UNION ALL SELECT 'query' || item_id, 'query: ' || text FROM benchmark")
    + """ SELECT regexp_extract(k, '[a-z]+') AS role, CAST(regexp_extract(k, '[0-9]+') AS BIGINT) AS id, CAST(place AS INTEGER) AS place, CAST(weight AS DOUBLE) AS weight FROM unit""",
    "chunk_text": """SELECT c_custkey, 'Buyer: ' || c_name || ' (' || n_name || ')' || chr(10) || 'Segment: '
        || coalesce(nullif(c_mktsegment, 'BUILDING'), 'не вказано') || chr(10) || 'Balance: ' || format('{:.2f}', c_acctbal) || ' ' AS chunk
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "metadata_json": """SELECT o_orderkey, '{"o_orderkey":' || o_orderkey
        || CASE WHEN o_orderstatus <> 'P' THEN ',"status":"' || o_orderstatus || '"' ELSE '' END
        || ',"created":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00"'
        || ',"o_orderpriority":"' || o_orderpriority || '"}' AS metadata FROM orders""",
    "split_documents": """WITH RECURSIVE cut AS (
          SELECT doc_id, -1 AS position, NULL::VARCHAR AS piece, text AS rest FROM documents
          UNION ALL
          SELECT doc_id, position + 1, CASE WHEN length(rest) <= 4096 THEN rest ELSE substr(rest, 1, stop) END,
                 CASE WHEN length(rest) > 4096 THEN ltrim(substr(rest, stop + 1), chr(10)) END
          FROM (SELECT *, CASE WHEN back = 0 OR 4096 - back < 2048 THEN 4096 ELSE 4096 - back END AS stop
                FROM (SELECT *, strpos(reverse(substr(rest, 1, 4096)), chr(10)) AS back FROM cut WHERE rest IS NOT NULL)))
        SELECT doc_id, position, piece FROM cut WHERE position >= 0""",
    "strip_links": r"""SELECT page_id, regexp_replace(regexp_replace(html, '\[([^\]]*)\]\((?:https?://|www\.)[^)]*\)', '\1', 'g'),
        '\b(?:https?://|www\.)\S+', '', 'g') AS plain FROM pages""",
    "escape_markdown": r"""SELECT doc_id, replace(replace(replace(replace(text, '_', '\_'), '*', '\*'), '`', '\`'), '[', '\[') AS escaped
        FROM documents""",
    "markdown_to_plain": r"""SELECT doc_id, lang || ' (' || source || ') ' || regexp_replace(
        regexp_replace(replace(replace(replace(replace(text, '_', '\_'), '*', '\*'), '`', '\`'), '[', '\['),
                       '\[([^\]]*)\]\(([^)]*)\)', '\1 (\2)', 'g'), '\\([_*`\[])', '\1', 'g') AS plain FROM documents""",
    "link_known_ids": f"WITH {ANSWERS} SELECT answer_id, {_ESCAPED} AS linked FROM a",
    "evidence_backstop": f"""WITH {ANSWERS} SELECT answer_id, {_RAW_TEXT}
        || CASE WHEN o_orderstatus = 'P' THEN chr(10) || chr(10) || '📎 Тендери: ' || {_PROOF} ELSE '' END AS backed FROM a""",
    "ungrounded_numbers": f"WITH {ANSWERS} SELECT answer_id, {_UNGROUNDED_SORTED.format(sep=chr(39) + '; ' + chr(39))} AS ungrounded FROM a",
    "answer_audit": f"""WITH {ANSWERS} SELECT answer_id, {_UNGROUNDED_SORTED.format(sep="'; '")} AS ungrounded, sample_size < 3 AS is_small_sample,
        CASE WHEN sample_size < 3 THEN 'ℹ️ Small sample, N=' || sample_size || chr(10) || chr(10) ELSE '' END
        || '⚠️ Not found in the evidence: ' || {_UNGROUNDED_SORTED.format(sep="', '")} || chr(10) || chr(10)
        || replace(head, '_', '\\_') || ' \\*won\\* ' || CASE WHEN o_orderstatus = 'F' THEN {_link('own')} ELSE cited END
        || ', вага ' || kg || ' кг, site and  15 км.'
        || CASE WHEN o_orderstatus = 'P' THEN chr(10) || chr(10) || '📎 Тендери: ' || {_PROOF} ELSE '' END AS audited FROM a""",
    "money_and_date_format": """SELECT o_orderkey, replace(format('{:,.2f}', o_totalprice), ',', ' ') AS money,
        strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS instant,
        (epoch_us(TIMESTAMP '2002-01-01') - epoch_us(o_orderdate)) / 3600000000.0 AS hours FROM orders""",
    "money_compact": """SELECT o_orderkey, CASE WHEN x >= 1e6 THEN format('{:.1f}', x / 1e6) || ' млн'
        ELSE replace(format('{:,.0f}', x), ',', ' ') END AS compact FROM (SELECT o_orderkey, o_totalprice * 4 AS x FROM orders)""",
    "clean_parameters": """SELECT p_partkey, CASE WHEN p_brand NOT IN ('Brand#1', 'Brand#2') THEN p_name END AS parameter FROM part""",
    "restrictive_specs": r"""SELECT doc_id, regexp_matches(text, '(?i)the [a-z]+tion[ .,]|le [a-z]+ment[ .,]|der [a-z]+en[ .,]')
        AND NOT regexp_matches(lower(text), 'oder|ouor') AS is_restrictive FROM documents""",
    # --- vectors
    "vector_knn": f"WITH {PROBES} SELECT query_id, rank, id, round(distance, 6) AS distance FROM hits WHERE rank <= 5",
    "vector_gate": f"""WITH {PROBES} SELECT query_id, round(min(distance), 6) AS closest, count(*) FILTER (distance <= 0.65) AS n_relevant,
        CASE WHEN min(distance) <= 0.65 THEN 'answer' ELSE 'refuse' END AS decision FROM hits WHERE rank <= 5 GROUP BY query_id""",
    "context_assembly": f"""WITH {PROBES} SELECT query_id, string_agg(text, chr(10) || '---' || chr(10) ORDER BY rank) AS context
        FROM hits JOIN documents ON id = doc_id WHERE rank <= 5 AND distance <= 0.75 GROUP BY query_id""",
    "threshold_calibration": f"""WITH {PROBES}, h AS (SELECT distance, label = query_id AS hit FROM hits WHERE rank <= 20),
        c AS (SELECT threshold, count(*) FILTER (distance <= threshold AND hit) AS true_hits,
                     count(*) FILTER (distance <= threshold AND NOT hit) AS false_hits, count(*) FILTER (hit) AS all_matches
              FROM h, (VALUES (0.55::DOUBLE), (0.6), (0.65), (0.7), (0.75)) AS v(threshold) GROUP BY threshold)
        SELECT *, round(true_hits / nullif(true_hits + false_hits, 0), 6) AS precision, round(true_hits / nullif(all_matches, 0), 6) AS recall FROM c""",
    "distance_profile": f"""WITH {PROBES} SELECT label = query_id AS is_match, count(*) AS n_hits, round(min(distance), 6) AS min_distance,
        round(max(distance), 6) AS max_distance, round(avg(distance), 6) AS avg_distance,
        {", ".join(f'round(quantile_cont(distance, {p / 100}), 6) AS p{p:02d}' for p in (5, 25, 50, 75, 95))} FROM hits WHERE rank <= 20 GROUP BY 1""",
    "embed_documents": "WITH " + PLACES.format(source="SELECT doc_id AS k, text AS txt FROM documents")
    + " SELECT k AS doc_id, CAST(place AS INTEGER) AS place, CAST(weight AS DOUBLE) AS weight FROM unit",
    "reembed_touched": """WITH src AS (SELECT doc_id AS k, lang || ': ' || text || CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
          THEN ' revised' ELSE '' END AS txt FROM documents), """ + PLACES.format(source="SELECT * FROM src")
    + """ SELECT CAST(src.k AS VARCHAR) AS id, md5(txt) AS document_md5, CAST(count(place) AS INTEGER) AS n_places
        FROM src LEFT JOIN unit ON src.k = unit.k GROUP BY src.k, txt""",
    "semantic_search": "WITH d AS (SELECT * FROM (WITH " + PLACES.format(source="SELECT doc_id AS k, text AS txt FROM documents")
    + " SELECT k, place, weight::DOUBLE / sqrt(sum(weight::DOUBLE * weight::DOUBLE) OVER (PARTITION BY k)) AS w FROM unit)), q AS (SELECT * FROM (WITH "
    + PLACES.format(source="SELECT item_id AS k, text AS txt FROM benchmark")
    + """ SELECT k, place, weight::DOUBLE / sqrt(sum(weight::DOUBLE * weight::DOUBLE) OVER (PARTITION BY k)) AS w FROM unit)),
        dots AS (SELECT q.k AS query_id, d.k AS id, sum(q.w * d.w) AS s FROM q JOIN d USING (place) GROUP BY ALL),
        pairs AS (SELECT item_id AS query_id, doc_id AS id, round(1 - coalesce(s, 0), 9) AS distance
                  FROM benchmark CROSS JOIN documents LEFT JOIN dots ON query_id = item_id AND id = doc_id),
        hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pairs),
        top AS (SELECT * FROM hits JOIN documents ON id = doc_id WHERE rank <= 5)
        SELECT query_id, round(min(distance), 6) AS closest, count(*) FILTER (distance <= 0.35) AS n_relevant,
               CASE WHEN min(distance) <= 0.35 THEN 'answer' ELSE 'refuse' END AS decision,
               string_agg(text, chr(10) || '---' || chr(10) ORDER BY rank) FILTER (distance <= 0.35) AS context,
               string_agg('  - [D-' || id || '](https://example.org/tender/D-' || id || ') (dist=' || format('{:.4f}', distance) || '): ' || lang,
                          chr(10) ORDER BY rank) FILTER (distance <= 0.35) AS sources
        FROM top GROUP BY query_id""",
    # --- tables
    "table_schema": f"""SELECT c.table_name, column_name,
        CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END AS column_type,
        n_rows FROM information_schema.columns c JOIN ({_COUNTS}) n ON c.table_name = n.table_name""",
    "row_counts": _COUNTS,
}
