import random

from quoteflow.llm import urlfilter
from quoteflow.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, host string, path string, rule string, row int, verdict int, labels int, shapes int, best int"


def plain(url, rules, otherwise="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest] or [len(rest)])]
    fit = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else otherwise


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(k, u, *[None] * 8) for k, u in enumerate(urls)], SCHEMA)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, urlfilter.rule_table(spark, rules)).collect()}


def test_random_urls(spark):
    rnd = random.Random(4)
    hosts = ["a.net", "net", "x.Example.NET", "example.com", "m.example.com", "notexample.com", "org", "b.org", ".net", "net.", "", "xnet", "a..org", "example.com:80", "É.org"]
    paths = ["", "/", "/en/", "/en", "/EN/", "/de/x", "/fr/a/b", "//fr/", "/en/?q=/de/", "#/en/", "?/de/", "/fr\nx/y"]
    urls = [rnd.choice(["http://", "HTTPS://", "://", "", "x:/", "a://b://"]) + rnd.choice(hosts) + rnd.choice(paths) for _ in range(600)] + [None, "", "://"]
    rules = [*URL_RULES, ("allow", "m.example.com", "/"), ("block", "m.example.com", "/"), ("block", "", "/"), ("block", "b.org", ""), ("allow", "org", "/f")]
    for use in (URL_RULES, rules):
        got = judged(spark, urls, use)
        assert got == {k: plain(u, use) for k, u in enumerate(urls)}


def test_repeats_nulls_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")] * 3 + [(None, None)], "page_id long, url string")
    got = urlfilter.judge(pages, urlfilter.rule_table(spark, URL_RULES)).collect()
    assert [r.verdict for r in got if r.page_id == 1] == ["block"] * 3 and len(got) == 4
    none = urlfilter.judge(pages, urlfilter.rule_table(spark, URL_RULES).where("false"), otherwise="block").collect()
    assert {(r.rule, r.verdict) for r in none} == {(None, "block")} and len(none) == 4
    assert urlfilter.judge(pages.where("false"), urlfilter.rule_table(spark, URL_RULES)).collect() == []
