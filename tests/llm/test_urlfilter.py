from pyspark.sql import functions as F

from spindrift.llm.urlfilter import RULES, judge_urls, rule_table

URLS = ["http://a.net/x", "HTTP://A.Example.NET/en/1?q#f", "http://example.net/EN/", "https://shop.example.com/de/", "http://example.com/de", "ftp://x.org/fr/z", "org/fr/", None, "", "http://", "://net/", "http://net", "http://net/", "http://notexample.net/en/", "http://a.org?/fr/", "http://a.net:80/x", "http://a.b.c.d.example.net/en/", "mailto:x://y.net/q", "http://a..net/", "http://ÉÀ.NET/"]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def check(spark, rules):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] + [(0, URLS[0], "x", "y")], "page_id long, url string, host string, verdict string")
    got = judge_urls(df, rule_table(spark, rules)).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(URLS[r["page_id"]], rules), URLS[r["page_id"]]


def test_equals_brute_force(spark):
    check(spark, RULES)
    check(spark, [("net", "", "block"), ("b.c.d.example.net", "/e", "allow"), ("example.net", "/en/", "block"), ("", "", "block")][:3])


def test_edge_tables(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert judge_urls(pages, none).first()["verdict"] == "allow"
    assert judge_urls(pages.limit(0), rule_table(spark, RULES)).count() == 0
    both = rule_table(spark, [("net", "/", "allow"), ("net", "/", "block"), ("net", "/", "block"), (None, "/", "block")])
    assert judge_urls(pages, both).select("verdict", F.col("rule")).collect() == [("block", "net/")]


def test_very_long_urls(spark):
    hosts = ["a." * 100_000 + "net", "b" * 200_000 + ".example.net", "." * 150_000, "x.y." * 10_000 + "org"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("/", "/en/", "/fr/" + "z" * 200_000, "?q")]
    df = spark.createDataFrame(list(enumerate(urls)) * 2, "page_id long, url string")
    got = judge_urls(df, rule_table(spark, RULES)).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(urls[r["page_id"]], RULES)
