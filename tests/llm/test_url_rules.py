"""URL rules: the index against all rules run on all URLs."""

import re

import pytest
from llm_cases import CLASHES, SF

from codeaudit.llm import url_rules as u


def slow(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if c in u.UPPER else c for c in host)
    rule = None
    for v, r in u.SITE_RULES:
        h, slash, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            rule = max(rule or (0, "", ""), (len(r), r, v))
    if rule:
        return host, path, rule[1], rule[2]
    return host, path, None, "block" if any(re.search(p, host + path) for p, _ in u.SPAM_PATTERNS) else "allow"


URLS = [None, "", "no scheme", "://", "http://", "HTTP://EXAMPLE.NET/en/x", "http://example.net/en", "x://net/",
        "http://net", "http://a.net?/b", "http://a.net#/b", "http://www.example.com/de/1?x=://y", "ftp://org/fr/",
        "http://ÄB.org/fr/é", "http://blog.casino-win.org/x", "http://casino-win.org/fr/x", "http://mycasino-win.org/",
        "http://net.example.org/", "http://x.org/wp-login.php", "http://x.org/wp-login.php?a", "http://a/b\nc://d/e",
        "http://spam-farm.example.org", "http://user@x.net:80/p", "http://x.orgnet/"]


def test_against_brute_force(spark):
    urls = URLS + [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()] + URLS
    extra = "".join(f", `{c}` string" for c in CLASHES)
    pages = spark.createDataFrame([(i, x, *["z"] * len(CLASHES)) for i, x in enumerate(urls)],
                                  "page_id bigint, url string" + extra)
    got = {r.page_id: r for r in u.judge(pages, u.rule_table(spark)).collect()}
    assert len(got) == len(urls)
    for i, x in enumerate(urls):
        r = got[i]
        assert (r.host, r.path, r.rule, r.verdict) == slow(x), x
    assert u.judge(pages.limit(0), u.rule_table(spark)).count() == 0


def test_rarest_token_and_refusal(spark):
    places = spark.createDataFrame([("a.common/x", 5), ("common.rare/", 2)], "place string, times bigint")
    rules = u.rule_table(spark, [], [("common.*rare", ["common", "rare"]), ("gone", ["gone", "common"])])
    got = {r.rule: r.token for r in u.rarest_token_index(rules, places).collect()}
    assert got == {"common.*rare": "rare", "gone": "gone"}
    with pytest.raises(ValueError):
        u.rule_table(spark, [], [("x.*", [])])
