"""URL verdicts from rules, and from a model of names for what the rules leave open.

Host names run words together.  A unigram model of the words in the pages'
own text splits them by Viterbi; multinomial naive Bayes over the tokens of
host and path then scores a URL, learnt from the URLs that the rules decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwatch.session import stored

# Spans up to this length are looked up one by one, longer words by their beginnings of this length.
SPAN = 20
SMOOTHING = 1.0
EVEN = 1e-9

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``host/path`` with its verdict: fits the host and its subdomains where the path begins alike."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct of ``text`` and ``verdict`` of the longest fitting rule, or null; equal rules count once, the last in spelling first."""
    if not rules:
        return F.lit(None).cast("struct<length:int,text:string,verdict:string>")
    fitting = [
        F.when(
            ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)),
            F.struct(F.lit(len(r.text)).alias("length"), F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    return F.array_max(F.array(*fitting))


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """``word``, ``n``: words in the visible text of all pages, lower-cased."""
    visible = F.regexp_replace(F.col(f"`{html}`"), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    word = F.explode(F.split(F.lower(visible), r"[^\p{L}]+"))
    return pages.select(word.alias("word")).filter(F.length("word") > 0).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def split_name(name: str, known: dict[tuple[int, int], float], total: float) -> list[str]:
    """Viterbi: the split of most likely words.

    ``known`` has the counts of spans that are words.  An unknown span of n
    letters, whatever n, counts 10 / 10^n: the best one that ends somewhere
    begins where the score so far and the place add up to most.  Of equal
    splits the one whose last word is longest wins.
    """
    words: dict[int, list[int]] = {}
    for start, end in known:
        words.setdefault(end, []).append(start)
    each = math.log10(total)
    best, back, ahead = [0.0], [0], (0.0, 0)
    for end in range(1, len(name) + 1):
        options = [(best[start] + math.log10(known[start, end]) - each, -start) for start in words.get(end, ())]
        if (-ahead[1], end) not in known:
            options.append((ahead[0] + 1.0 - end - each, ahead[1]))
        elif other := [(best[s] + s + 1.0 - end - each, -s) for s in range(end) if (s, end) not in known]:
            options.append(max(other))
        score, at = max(options)
        best.append(score)
        back.append(-at)
        ahead = max(ahead, (score + end, -end))
    tokens, end = [], len(name)
    while end:
        tokens.append(name[back[end] : end])
        end = back[end]
    return tokens[::-1]


def split_hosts(hosts: DataFrame, words: DataFrame, longest: int = SPAN) -> DataFrame:
    """``host``, ``tokens``: every different host's labels split into words, in order.

    Spans of the labels meet the words by a join, so neither list is held by a task.
    """
    parts = stored(hosts.select("host", F.posexplode(F.split("host", r"[^\p{L}\p{N}]+")).alias("place", "label")).filter(F.length("label") > 0), "labels")
    labels = parts.select("label").distinct()
    span = F.explode(F.sequence(F.lit(0), F.length("label") - 1)).alias("start")
    spans = labels.select("label", F.length("label").alias("size"), span).select(
        "label", "start", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("size"), F.col("start") + longest))).alias("end")
    )
    spans = spans.withColumn("word", F.expr("substring(label, start + 1, end - start)"))
    words = stored(words, "words")
    total = float(words.agg(F.sum("n")).first()[0] or 1)
    # Longer words are looked up by their beginnings.
    long = words.filter(F.length("word") > longest).select(F.col("word").alias("whole"), "n", F.substring("word", 1, longest).alias("word"))
    longer = spans.filter(F.col("end") - F.col("start") == longest).join(long, "word").filter(F.expr("substring(label, start + 1, length(whole)) = whole"))
    hits = spans.join(words, "word").select("label", "start", "end", "n").unionByName(
        longer.select("label", "start", (F.col("start") + F.length("whole")).alias("end"), "n")
    )
    found = hits.groupBy("label").agg(F.collect_list(F.struct("start", "end", "n")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            tokens = [
                split_name(name, {(x["start"], x["end"]): x["n"] for x in spans or ()}, total)
                for name, spans in zip(names, batch.column(1).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.string()))], names=["label", "tokens"])

    split = labels.join(found, "label", "left").mapInArrow(run, "label string, tokens array<string>")
    ordered = F.array_sort(F.collect_list(F.struct("place", "tokens")))
    return parts.join(split, "label").groupBy("host").agg(F.flatten(F.transform(ordered, lambda x: x["tokens"])).alias("tokens"))


def _tokens(host_tokens: Column, path: Column) -> Column:
    named = F.transform(F.coalesce(host_tokens, F.array().cast("array<string>")), lambda t: F.concat(F.lit("h:"), t))
    walked = F.transform(F.filter(F.split(F.translate(path, UPPER, LOWER), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 0), lambda t: F.concat(F.lit("p:"), t))
    return F.concat(named, walked)


def bayes_odds(rows: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """The rows (``row``, ``verdict``, ``tokens``) without a verdict, with ``odds``: log-odds of ``allow`` against ``block``.

    Learnt from the rows that have a verdict.  Tokens are counted exactly in a
    distributed table, and the vocabulary is as large as that.  A token that is
    not in it has the classes' smoothed share alone.
    """
    taught = rows.filter(F.col("verdict").isNotNull())
    of = lambda v: F.count(F.when(F.col("verdict") == v, True))
    counts = stored(taught.select("verdict", F.explode("tokens").alias("token")).groupBy("token").agg(of("allow").alias("allow"), of("block").alias("block")), "counts")
    sizes = counts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("allow"), F.lit(0)).alias("allow"), F.coalesce(F.sum("block"), F.lit(0)).alias("block")).first()
    seen = taught.agg(of("allow").alias("allow"), of("block").alias("block")).first()
    prior = math.log((seen["allow"] + smoothing) / (seen["block"] + smoothing))
    vocabulary = smoothing * max(1, sizes["n"])
    unseen = math.log((sizes["block"] + vocabulary) / (sizes["allow"] + vocabulary))
    weights = counts.select("token", F.log((F.col("allow") + smoothing) / (F.col("block") + smoothing)).alias("weight"))
    open_rows = rows.filter(F.col("verdict").isNull())
    each = open_rows.select("row", F.explode("tokens").alias("token"))
    sums = each.join(weights, "token").groupBy("row").agg(F.sum("weight").alias("sum"))
    odds = F.lit(prior) + F.size("tokens") * F.lit(unseen) + F.coalesce("sum", F.lit(0.0))
    return open_rows.join(sums, "row", "left").withColumn("odds", odds).drop("sum")


def judge(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: ``key``, ``host``, ``path``, ``rule``, ``verdict``.

    The longest fitting rule decides; else naive Bayes, where even odds allow.
    A null url or one without ``://`` has empty host and path, fits no rule,
    and is judged by the classes' share alone.  Repeated rows count as often
    as they occur.  Null html adds no words.
    """
    address = F.col(f"`{url}`")
    read = pages.select(F.col(f"`{key}`").alias("__key"), host_of(address).alias("host"), path_of(address).alias("path"))
    decided = stored(read.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules)), "urls")
    hosts = split_hosts(decided.select("host").distinct(), word_counts(pages, html))
    rows = stored(
        decided.join(hosts, "host", "left").select(
            "__key", "host", "path", F.col("rule.text").alias("rule"), F.col("rule.verdict").alias("verdict"), _tokens(F.col("tokens"), F.col("path")).alias("tokens"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "tokens",
    )
    # Sums of logarithms differ in the last bits by their order; what is even within those allows.
    judged = bayes_odds(rows).withColumn("verdict", F.when(F.col("odds") >= -EVEN, "allow").otherwise("block"))
    out = ["__key", "host", "path", "rule", "verdict"]
    return rows.filter(F.col("verdict").isNotNull()).select(*out).unionByName(judged.select(*out)).withColumnRenamed("__key", key)
