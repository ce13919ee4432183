import random

import pytest

from loomframe.llm import url_filter
from loomframe.llm.queries import URL_RULES

PAGES = "page_id long, url string, html string, host string, rule string"


def brute(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return (host, path, *(best or (None, "allow")))


def urls():
    fixed = [
        None, "", "no scheme", "://", "http://", "http://NET", "http://net/", "http://a.NET/x?y", "https://example.net/en/1", "https://sub.example.net/en", "http://xexample.net/en/",
        "ftp://EXAMPLE.com/de/a#b", "http://example.com/DE/", "x://y.org/fr/?", "http://y.org#/fr/", "http://u:p@a.org:80/fr/", "a://b://c.net/", "http://net/?://x", "HTTP://.net/", "http://é.net/",
    ]
    r = random.Random(4)
    return fixed + [f"http://{r.choice(['', 'a.', 'a.b.'])}{r.choice(['example.net', 'net', 'org', 'example.com'])}/{r.choice(['en/', 'de/', 'fr/', 'fr', ''])}{r.choice(['x', '', '?q', '#z'])}" for _ in range(200)]


@pytest.mark.parametrize("mask", [2**64 - 1, 1])
def test_verdicts_match_brute_force(spark, mask):
    rules = [*URL_RULES, ("a.net/en/x", "allow"), ("b.net/", "block"), ("com/", "allow")]
    rows = [(i, u, None, "x", "y") for i, u in enumerate(urls())]
    got = url_filter.judge_urls(spark.createDataFrame(rows, PAGES), rules, mask=mask).collect()
    assert {r["page_id"]: tuple(r)[1:] for r in got} == {i: brute(u, rules) for i, u, *_ in rows}


def test_index_of_many_rules(tmp_path):
    rules = [(f"h{i}.example/{i % 7}/", "block" if i % 2 else "allow") for i in range(2000)]
    (tmp_path / "i").write_bytes(url_filter.build_index(rules, mask=0xFF))
    index = url_filter.Index(str(tmp_path / "i"))
    at = index.find([r for r, _ in rules] + ["h1.example/9/"])
    assert at[-1] == -1 and all(index.string(k) == r and bool(index.block[k]) == (v == "block") for k, (r, v) in zip(at, rules, strict=False))


def test_edges(spark):
    empty = spark.createDataFrame([], PAGES)
    assert url_filter.judge_urls(empty, URL_RULES).count() == 0
    one = spark.createDataFrame([(None, "http://a.net/", None, None, None)] * 2, PAGES)
    assert [r["verdict"] for r in url_filter.judge_urls(one, URL_RULES).collect()] == ["block", "block"]
    assert [r["verdict"] for r in url_filter.judge_urls(one, [], default="block").collect()] == ["block", "block"]
    with pytest.raises(ValueError, match="not a rule"):
        url_filter.build_index([("net", "block")])


def test_very_long_urls(spark):
    rules = [*URL_RULES, ("b.c.d.e.net/x/", "allow")]
    hosts = ["." * 1_000_000 + "net", "a." * 500_000 + "b.c.d.e.net", "x" * 1_000_000 + ".org"]
    rows = [(i, f"http://{h}/x/{'p' * 1000}", None, "x", "y") for i, h in enumerate(hosts)] + [(9, "http://a.net/" + "en/" * 400_000, None, "x", "y")]
    got = url_filter.judge_urls(spark.createDataFrame(rows, PAGES), rules).collect()
    assert {r["page_id"]: tuple(r)[1:] for r in got} == {i: brute(u, rules) for i, u, *_ in rows}


def test_an_index_too_large_is_refused(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_INDEX", 10)
    with pytest.raises(ValueError, match="bytes"):
        url_filter.judge_urls(spark.createDataFrame([], PAGES), URL_RULES)
