"""WARC archives and URL verdicts."""

import gzip
import hashlib
import math
import re
from collections import Counter

import pytest
from compare import compare, duck
from pyspark.sql import functions as F

from lotwatch.llm import urls, warc
from lotwatch.llm.queries import QUERIES, URL_RULES
from lotwatch.session import fresh_folder

FOLDER = "/root/testdata/sf0.001"
LONG = "é" * 60
TRICKY = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3
PAGES = [
    (5, "http://a/1", LONG), (3, "http://a/2", LONG), (9, None, LONG), (3, "http://a/2", LONG), (4, "http://a/3", "short"), (6, "x\r\ny", "short"),
    (7, "u", None), (8, "u", ""), (None, "u", LONG), (10, "u", TRICKY), (11, "u", TRICKY), (12, "u", "z" * 3_000_000),
]


def _pages(spark, rows=PAGES):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumn("record_type", F.lit("clash")).withColumn("payload", F.lit(1)).withColumn("host", F.lit(None).cast("string"))


def test_archives_hold_each_payload_once(spark):
    path = fresh_folder(spark, "warc")
    warc.deduplicate_pages(_pages(spark), path)
    found = warc.read_archives(spark, path).collect()
    assert len(found) == len(PAGES)
    for r in found:
        if r["record_type"] == "response":
            assert hashlib.sha256(bytes(r["payload"])).hexdigest() == r["payload_digest"]
        else:
            assert bytes(r["payload"]) == b""
    got = sorted((r["record_id"] or "", r["record_type"], r["refers_to"] or "") for r in found)
    want = [
        ("", "revisit", "3"), ("10", "response", ""), ("11", "revisit", "10"), ("12", "response", ""), ("3", "response", ""), ("3", "response", ""),
        ("4", "response", ""), ("5", "revisit", "3"), ("6", "response", ""), ("7", "response", ""), ("8", "response", ""), ("9", "revisit", "3"),
    ]
    assert got == want
    assert {r["target_uri"] for r in found if r["record_id"] == "6"} == {"x y"}
    sizes = {r["record_id"]: r["payload_bytes"] for r in warc.resolved_sizes(warc.read_archives(spark, path)).collect()}
    assert sizes["5"] == 120 and sizes["11"] == len(TRICKY) and sizes["7"] == 0


def test_rewritten_archives_follow_revisits(spark):
    first, second = fresh_folder(spark, "warc"), fresh_folder(spark, "warc")
    rows = [("b", LONG, "response", None), ("c", LONG, "response", None), ("d", None, "revisit", "c"), ("e", None, "revisit", "gone")]
    records = spark.createDataFrame(rows, "record_id string, payload string, record_type string, refers_to string")
    digest = F.sha2(F.coalesce("payload", F.lit(LONG)), 256)
    warc.write_archives(records.select("*", F.lit("u").alias("target_uri"), F.lit(None).cast("string").alias("date"), digest.alias("payload_digest")), first, archive_bytes=1)
    warc.deduplicate_archives(spark, first, second)
    found = {r["record_id"]: (r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, second).collect()}
    assert found == {"b": ("response", None), "c": ("revisit", "b"), "d": ("revisit", "b"), "e": ("revisit", "gone")}


def test_empty_archives(spark):
    path = fresh_folder(spark, "warc")
    warc.deduplicate_pages(_pages(spark).limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


def test_a_broken_archive_is_an_error():
    with pytest.raises(ValueError, match="no record"):
        list(warc.parse_archive(b"HTTP/1.1\r\n\r\n"))
    assert list(warc.parse_archive(gzip.decompress(gzip.compress(b"")))) == []


def test_op5(spark):
    assert compare(spark, duck(FOLDER), FOLDER, "op5_warc") == ""


def _address(url):
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return ("", "") if not found else ("".join(c.lower() if "A" <= c <= "Z" else c for c in found[1]), found[2])


def _rule(host, path, rules=URL_RULES):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.text), r.text), default=None)


def _best_split(name, counts, total):
    """All splits tried, of the same scores."""
    if not name:
        return 0.0, []
    options = []
    for at in range(len(name)):
        before, words = _best_split(name[:at], counts, total)
        last = name[at:]
        score = before + ((math.log10(counts[last]) if last in counts else 1.0 - len(last)) - math.log10(total))
        options.append((score, -at, [*words, last]))
    score, _, words = max(options)
    return score, words


def _viterbi(name, counts, total):
    """Every start of a last word is tried, known or not, at any length."""
    best = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        word = lambda s: math.log10(counts[name[s:end]]) if name[s:end] in counts else 1.0 - (end - s)  # noqa: E731, B023
        best.append(max((round(best[s][0] + word(s) - math.log10(total), 9), -s) for s in range(end)))
    tokens, end = [], len(name)
    while end:
        tokens.append(name[-best[end][1] : end])
        end = -best[end][1]
    return tokens[::-1]


def test_unknown_names_of_any_length():
    for n in (5, 20, 21, 25, 60):
        assert urls.split_name("q" * n, {}, 1000) == ["q" * n] == _viterbi("q" * n, {}, 1000)
    counts = {"cheap": 50, "pills": 40}
    name = "x" * 33 + "cheap" + "y" * 25 + "pills"
    known = {(i, j): counts[name[i:j]] for i in range(len(name)) for j in range(i + 1, len(name) + 1) if name[i:j] in counts}
    assert urls.split_name(name, known, 200) == _viterbi(name, counts, 200) == ["x" * 33, "cheap", "y" * 25, "pills"]


def test_names_are_split_into_their_likeliest_words(spark):
    counts = {"cheap": 50, "pills": 40, "pill": 30, "s": 5, "che": 2, "ap": 2, "the": 900, "rapist": 1, "therapist": 3}
    total = sum(counts.values())
    for name in ("cheappills", "therapist", "thecheap", "zzz", "pillszz", "a", "sss", "xthe"):
        known = {(i, j): counts[name[i:j]] for i in range(len(name)) for j in range(i + 1, len(name) + 1) if name[i:j] in counts}
        assert urls.split_name(name, known, total) == _best_split(name, counts, total)[1]
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    hosts = spark.createDataFrame([("www.cheappills.com",), ("",), ("-.-",), ("a" * 300 + ".the",)], "host string")
    found = {r["host"]: r["tokens"] for r in urls.split_hosts(hosts, words).collect()}
    assert found["www.cheappills.com"] == ["www", "cheap", "pills", "com"] and set(found) == {"www.cheappills.com", "a" * 300 + ".the"}
    assert found["a" * 300 + ".the"] == ["a" * 300, "the"]


def _brute(pages):
    """Verdicts from counts in plain Python over the operator's tokens."""
    addresses = [_address(u) for _, u, _ in pages]
    return addresses, [_rule(*a) for a in addresses]


def test_op9_by_brute_force(spark):
    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()]
    _check(spark, pages, QUERIES["op9_urls"](spark, FOLDER).collect())


def test_odd_urls_and_repeated_rows(spark):
    odd = ["HTTP://WWW.Example.ORG/es/x?q", "a://b://example.org/es/", "://org", "://org/", "no scheme", "", None, "x://example.org/en/12#f", "x://xexample.org/en/12",
           "x://com/de/", "x://a.com/fr/\n/y", "x://a.com?fr/", "x://a.com", "é://É.net/" + "p/" * 20_000]
    pages = [(i, u, "<p>free stuff</p><script>evil()</script>" if i % 2 else None) for i, u in enumerate(odd)] * 2 + [(None, "x://freestuff.net/de/1", "")]
    _check(spark, pages, urls.judge(_pages(spark, pages), URL_RULES).collect())
    assert urls.judge(_pages(spark, pages).limit(0), URL_RULES).count() == 0
    assert {r["verdict"] for r in urls.judge(_pages(spark, pages[:3]), []).collect()} == {"allow"}


def _check(spark, pages, rows):
    addresses, rules = _brute(pages)
    words = Counter()
    for _, _, html in pages:
        text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ", html or "")
        words.update(w for w in re.split(r"[^\w]|[\d_]", text.lower()) if w)
    total = sum(words.values()) or 1
    tokens = []
    for host, path in addresses:
        own = []
        for label in re.split(r"[^\w]|_", host):
            own += ["h:" + w for w in _viterbi(label, words, total)]
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in path)
        tokens.append(own + ["p:" + w for w in re.split(r"[^\w]|_", lower) if w])
    counts, seen = {"allow": Counter(), "block": Counter()}, Counter()
    for rule, own in zip(rules, tokens, strict=True):
        if rule:
            seen[rule.verdict] += 1
            counts[rule.verdict].update(own)
    vocabulary = max(1, len(counts["allow"].keys() | counts["block"].keys()))
    size = {v: sum(c.values()) + vocabulary for v, c in counts.items()}
    want = []
    for (page, _, _), (host, path), rule, own in zip(pages, addresses, rules, tokens, strict=True):
        odds = math.log((seen["allow"] + 1) / (seen["block"] + 1))
        odds += sum(math.log((counts["allow"][t] + 1) / size["allow"]) - math.log((counts["block"][t] + 1) / size["block"]) for t in own)
        want.append((str(page), host, path, rule.text if rule else "", rule.verdict if rule else ("allow" if odds >= -1e-9 else "block")))
    got = [(str(r["page_id"]), r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in rows]
    assert sorted(got) == sorted(want)
