"""URL rules: every case against a plain reading, odd URLs, and a list longer than its filter."""

import re

from pyspark.sql import functions as F

from wafermill.llm import urlfilter
from wafermill.llm.urlfilter import bloom_filter, judge_urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("EXAMPLE.org", "", "block"), (None, "/x", "block"), ("", "/y", "block"), ("net", "/", "block")]
LISTED = [("bad.example", "/"), ("half.example", "/shop"), ("half.example", "/shop")]
URLS = [
    "http://a.net/x", "http://net", "http://net/", "https://www.example.net/en/1?q=/de/", "https://example.net/enough", "http://EXAMPLE.com/de/", "http://notexample.com/de/",
    "http://x.org/fr/1#a", "http://example.org", "http://sub.example.org/fr/z", "http://bad.example/a", "http://very.bad.example/", "http://bad.example", "http://half.example/shopping", "http://half.example/sho",
    "nothing", "", None, "://", "http://", "http:///path", "a://b://c/d", "http://a.net?x/y", "http://.net/x", "http://user@a.net:80/x", "http://x.net/\n?q", "ftp://A.B.NET/Ü/é", "http://" + "a." * 2000 + "net/" + "p" * 50_000,
]
SCHEMA = "page_id bigint, url string, host string, rule string, html string"


def slow(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = lambda h, p: h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p or "")
    rules = [(len(h) + len(p), len(h), h.lower() + p, v) for h, p, v in RULES if fits(h, p)]
    listed = any(fits(h, p) for h, p in LISTED)
    best = max(rules, default=None)
    return host, path, best[2] if best else None, best[3] if best else ("block" if listed else "allow"), listed


def frames(spark):
    return spark.createDataFrame(RULES, "host string, path string, verdict string"), spark.createDataFrame(LISTED, "host string, path string")


def test_every_case(spark):
    rows = [(i, u, "x", "y", "z") for i, u in enumerate(URLS)] + [(0, URLS[0], "x", "y", "z"), (None, URLS[3], None, None, None)]
    got = judge_urls(spark.createDataFrame(rows, SCHEMA).repartition(4), *frames(spark)).collect()
    want = [(i, *slow(u)) for i, u, *_ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    rules, listed = frames(spark)
    pages = spark.createDataFrame([(1, "http://a.net/x", "", "", "")], SCHEMA)
    assert judge_urls(pages.where("false"), rules, listed).collect() == []
    got = judge_urls(pages, rules.where("false"), listed.where("false")).first()
    assert (got["verdict"], got["rule"], got["host"]) == ("allow", None, "a.net")


def test_false_positives_are_removed(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "MOST_BLOCKS", 2)
    listed = spark.range(3000).select(F.concat(F.lit("h"), "id", F.lit(".example")).alias("host"), F.lit("/").alias("path"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), "id", F.lit(".example/")).alias("url"))
    got = judge_urls(pages, frames(spark)[0].where("false"), listed)
    assert got.where("verdict = 'block'").agg(F.min("page_id"), F.max("page_id"), F.count("*")).first()[:] == (0, 2999, 3000)
    keys = spark.range(100).select(F.col("id").cast("string").alias("_key"))
    assert bloom_filter(keys, 4).count() <= 4
