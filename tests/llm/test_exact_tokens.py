"""Tokens that shared a cell of the former 2^18, and words of more than twenty letters."""

from pyspark.sql import functions as F

from lotwatch.llm import urls


def test_a_token_does_not_take_the_counts_of_another(spark):
    cell = F.pmod(F.xxhash64(F.concat(F.lit("p:"), "word")), F.lit(1 << 18))
    words = spark.range(5000).select(F.concat(F.lit("w"), F.col("id")).alias("word"))
    a, b = words.groupBy(cell.alias("cell")).agg(F.sort_array(F.collect_list("word")).alias("w")).filter("size(w) > 1").orderBy("cell").first()["w"][:2]
    pages = [(i, "x://x.org/keep") for i in range(6)] + [(10 + i, f"x://y.org/{a}/{a}/{a}") for i in range(5)] + [(20, f"x://z.net/{b}"), (21, f"x://z.net/{a}")]
    rules = [urls.Rule("x.org/", "allow"), urls.Rule("y.org/", "block")]
    found = urls.judge(spark.createDataFrame([(i, u, "") for i, u in pages], "page_id long, url string, html string"), rules)
    verdicts = {r["page_id"]: r["verdict"] for r in found.collect()}
    assert len(verdicts) == len(pages) and verdicts[20] == "allow" and verdicts[21] == "block"


def test_long_words_are_found_in_host_names(spark):
    word = "donaudampfschifffahrtsgesellschaft"
    words = spark.createDataFrame([(word, 5), ("news", 9), ("donau", 9), ("net", 3)], "word string, n long")
    hosts = spark.createDataFrame([(f"{word}news.net",), (f"news{word}.net",)], "host string")
    found = {r["host"]: r["tokens"] for r in urls.split_hosts(hosts, words).collect()}
    assert found == {f"{word}news.net": [word, "news", "net"], f"news{word}.net": ["news", word, "net"]}
