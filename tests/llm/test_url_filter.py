"""URL rules, path templates and labelled purity."""

import pytest

from fundamentals_spark.llm import url_filter as U


def judged(spark, urls, **kw):
    rows = [(k, u, "x", "h") for k, u in enumerate(urls)] if not isinstance(urls[0], tuple) else [(k, u, label, "h") for k, (u, label) in enumerate(urls)]
    kind = "string" if not isinstance(urls[0], tuple) else "boolean"
    out = U.url_filter(spark.createDataFrame(rows, f"page_id long, url string, label {kind}, host string"), **kw)
    return {r["page_id"]: r for r in out.collect()}


def test_hosts_paths_and_rules(spark):
    urls = [
        "HTTP://WWW.Example.NET/en/Ä?q=1", "http://example.net", "http://example.net/", "https://a.example.net/de/x#t", "https://notexample.net/en/", "https://example.com/de/1", "https://x.example.com/dex/1", "http://b.org/fr/",
        "http://net/q", "a://b://c/d", None, "no scheme", "", "http:///path", "x\ny://h\no/p\nq?z", "http://example.net/en",
    ]
    got = judged(spark, urls)
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"]) for k in range(len(urls))] == [
        ("www.example.net", "/en/Ä", "example.net/en/"), ("example.net", "", None), ("example.net", "/", "net/"), ("a.example.net", "/de/x", "net/"), ("notexample.net", "/en/", "net/"), ("example.com", "/de/1", "example.com/de/"),
        ("x.example.com", "/dex/1", None), ("b.org", "/fr/", "org/fr/"), ("net", "/q", "net/"), ("b:", "//c/d", None), ("", "", None), ("", "", None), ("", "", None), ("", "/path", None), ("h\no", "/p\nq", None), ("example.net", "/en", "net/"),
    ]
    assert {r["verdict"] for r in got.values()} <= {"allow", "block"} and got[0]["verdict"] == "allow" and got[2]["verdict"] == "block"


def test_templates_generalise_and_are_judged_by_purity(spark):
    bad = [(f"http://h.test/item/{w}{k}/buy", True) for k, w in enumerate("abcdefghijklmnopqrstuvwxyz" * 3)]
    good = [(f"http://h.test/news/2020/{k}.html", False) for k in range(60)]
    unknown = [("http://h.test/item/unseen/buy", None), ("http://h.test/news/2021/77.html", None), ("http://other.test/item/a/buy", None)]
    got = judged(spark, bad + good + unknown, label_col="label", rules=())
    n = len(bad) + len(good)
    assert got[n]["verdict"] == "block" and got[n + 1]["verdict"] == got[n + 2]["verdict"] == "allow"
    assert got[n]["template"] == got[0]["template"] and got[n + 1]["template"] == got[n - 1]["template"] != got[n]["template"]
    assert got[n]["purity"] > U.REJECT > got[n + 2]["purity"] > got[n + 1]["purity"]


def test_branches_merge_only_where_alike():
    like = [("de", {1: 30, 2: 10}, 0, 0), ("fr", {1: 33, 2: 9}, 0, 0), ("img", {7: 50}, 0, 0)]
    assert U.merge_branches(like) == {"de": "*", "fr": "*", "img": "img"}
    labels = [("de", {1: 50}, 50, 50), ("fr", {1: 40}, 40, 40), ("en", {1: 60}, 60, 0)]
    assert U.merge_branches(labels) == {"de": "*", "fr": "*", "en": "en"}
    assert U.merge_branches([("a", {1: 1}, 0, 0)]) == {"a": "a"}


def test_purity_by_hand(spark):
    """One host, one template: prior from the host, whose prior is the overall rate."""
    got = judged(spark, [("http://a.test/p", True)] * 4 + [("http://a.test/p", None)] * 10, label_col="label", rules=())
    weight = U.PRIOR + U.SILENT * 10
    host = (4 + weight * 1.0) / (4 + weight)
    assert got[0]["purity"] == pytest.approx((4 + weight * host) / (4 + weight), abs=1e-6) and len(got) == 14


def test_deep_paths_empty_tables_and_repeats(spark):
    deep = "http://h.test/" + "/".join(f"s{k}" for k in range(3000))
    got = judged(spark, [deep, deep, "http://h.test/a/b/"])
    assert got[0]["template"].count("/") == U.LEVELS + 1 and got[0]["template"] == got[1]["template"]
    empty = spark.createDataFrame([], "page_id long, url string")
    assert U.url_filter(empty).count() == 0
