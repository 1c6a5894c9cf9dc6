"""URL rules against a plain search of the longest that fits."""

from __future__ import annotations

import random
import re

from rollsmith.llm.queries import URL_RULES
from rollsmith.llm.urls import judge_urls, rule_table

SCHEMA = "page_id long, url string, host int, key string, rule string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :]).group()


def judged(url, rules, default="allow"):
    host, path = parts(url)
    known = {}
    for verdict, h, p in rules:
        if h is not None and verdict is not None:
            h, p = h.lower(), p or ""
            known[h, p] = max(verdict, known.get((h, p), verdict))
    fits = [(len(h + p), len(h), h + p, v) for (h, p), v in known.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


def held(spark, urls, rules, default="allow"):
    pages = spark.createDataFrame([(i % 50 or None, u, 1, "k", "r") for i, u in enumerate(urls)], SCHEMA).repartition(3)
    got = judge_urls(pages, rule_table(spark, rules), default=default)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = [(i % 50 or None, *judged(u, rules, default)) for i, u in enumerate(urls)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


EDGES = [None, "", "no scheme", "://", "http://", "http://org", "http://ORG/", "http://a.org?x=/", "x://org/a://b", "http://example.org/es/1", "http://EXAMPLE.org/en/12", "http://notexample.org/es/1", "http://a.b.example.org/es/", "http://example.org./es/",
         "http://example.org:80/es/", "http://u@example.com/de/x", "http://com/fr/", "http://xcom/de/", "http://.com/de/", "http://é.com/de/É\n?", "http://com/DE/", "http://org\n/x", "http://a.com/" + "x" * 50000, "HTTP://A.Com/de/#a"]


def test_edges_with_the_rules_of_the_query(spark):
    held(spark, EDGES + EDGES[:6], URL_RULES)


def test_many_nested_rules(spark):
    random.seed(5)
    host = lambda: ".".join(random.choice(["a", "b", "a-", "a0", "é"]) for _ in range(random.randint(1, 4)))
    path = lambda: random.choice(["", "/"]) + "".join(random.choice(["a", "b", "/", "\U0001f600"]) for _ in range(random.randint(0, 4)))
    rules = [(random.choice(["allow", "block", "check"]), host(), path()) for _ in range(150)] + [("block", "", "/a"), ("allow", "B", None)]
    urls = [f"http://{host()}/{path()}" for _ in range(500)] + [f"http://a.a/{path()}" for _ in range(300)]
    held(spark, urls, rules, "unknown")


def test_no_rules_and_no_pages(spark):
    held(spark, EDGES[:8], [], "block")
    held(spark, [], URL_RULES)


def test_no_python_worker(spark):
    urls = spark.range(4).selectExpr("id as page_id", "concat('http://a.org/', id) as url")
    plan = judge_urls(urls, rule_table(spark, URL_RULES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan
