import random

from pyspark.sql import functions as F

from buildlore.llm import url_filter as U


def plain(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, default
    _, rule, v = max(fits)
    return host, path, rule, v


URLS = [
    "http://a.example.net/en/1?x=/de/", "https://EXAMPLE.net/EN/1", "http://example.com/de/#t", "http://m.example.org/fr/", "http://xexample.com/de/", "http://net",
    "http://net/", "http://a.net?b", "no scheme", "", None, "a://b://c/d", "http:///x", "http://É.net/\n/x", "http://example.com:80/de/", "http://a..net/", "http://net./",
]


def rows(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").selectExpr("*", "'x' AS host", "'y' AS rule", "'z' AS key")


def rule_table(spark, rules):
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def test_rules_and_odd_urls(spark):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(rows(spark, URLS), rule_table(spark, U.RULES)).collect()}
    assert got == {i: plain(u, U.RULES) for i, u in enumerate(URLS)}


def test_no_rules_bad_rules_no_pages(spark):
    got = U.judge(rows(spark, URLS[:2]), rule_table(spark, [(None, "/", "block"), ("", "/", "block"), ("net", "/", "maybe")])).collect()
    assert [r.verdict for r in got] == ["allow"] * 2
    assert U.judge(rows(spark, []), rule_table(spark, U.RULES)).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    rng = random.Random(5)
    universe = [f"k{i}" for i in range(5000)]
    listed = set(rng.sample(universe, 700))
    keys = spark.createDataFrame([(k,) for k in universe + [None]], "key string").repartition(4)
    levels = U.build_cascade(spark.createDataFrame([(k,) for k in listed], "key string"), keys)
    assert len(levels) > 1
    told = {r.key: r.yes for r in keys.select("key", U.contains(F.col("key"), levels).alias("yes")).collect()}
    assert told == {k: k in listed for k in universe} | {None: False}
    assert sum(x.bits for x in levels) / len(listed) < 40
