"""URL filter: listed rules, parsing, mined rules against counting by hand."""

import random
import re
from collections import Counter
from itertools import combinations

import pytest

from turnlens.llm import url_filter
from turnlens.llm.url_filter import judge_urls, mined_rules, url_items

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)],
                                 "page_id long, url string, items string, tokens string")


def listed(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for what, rule in RULES:
        name, rest = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            if best is None or len(rule) > len(best[1]):
                best = what, rule
    return host, path, best


URLS = ["http://a.example.net/en/1", "https://B.Example.NET/en", "http://x.net", "http://x.net/", "http://x.net?q=1", "net/",
        "http://example.com/de/5?x=1&y=2#z", "http://notexample.com/de/5", "http://www.org/fr/3", "http://org/fr/", None, "",
        "http://example.com/en/1://example.net/en/2", "ftp://ÄB.net/é?ü#f", "://", "http://u:p@x.net:80/a", "http://x.net/#/en/",
        "http://" + "a." * 2000 + "net/" + "b" * 20_000]


def test_listed_rules_and_parsing(spark):
    for r in judge_urls(pages(spark, URLS * 2)).collect():
        host, path, best = listed((URLS * 2)[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1])
        assert r["verdict"] == best[0] if best else r["verdict"] in ("allow", "block")


def mine(baskets, support, confidence):
    """Rules by counting every token set."""
    n, sets, marked = len(baskets), Counter(), Counter()
    for items, verdict in baskets:
        for k in range(1, len(items) + 1):
            for c in combinations(sorted(items), k):
                sets[c] += 1
                marked[c, verdict] += 1
    rules = {(c, v): (m / sets[c], m / n) for (c, v), m in marked.items() if m >= support * n and m / sets[c] >= confidence}
    return {(c, v): s for (c, v), s in rules.items()
            if not any(w == v and set(d) < set(c) and t[0] >= s[0] for (d, w), t in rules.items())}


def test_mined_rules(spark):
    urls = [f"http://{h}.example.{t}/{p}/{i}" for i in range(40) for h, t, p in
            [("www", "net", "de"), ("m", "net", "en"), ("www", "org", "fr"), ("spam-farm", "com", "de"), ("blog", "net", "fr")]]
    df = pages(spark, urls)
    rows = judge_urls(df).join(df.select("page_id", url_items(df["url"]).alias("i")), "page_id").where("rule IS NOT NULL")
    labelled = rows.select(rows["i"].alias("items"), "verdict")
    got = {(tuple(r["tokens"]), r["verdict"]): (round(r["confidence"], 9), round(r["support"], 9))
           for r in mined_rules(labelled, 0.05, 0.8).collect()}
    baskets = [(r["items"], r["verdict"]) for r in labelled.collect()]
    assert got == {k: (round(a, 9), round(b, 9)) for k, (a, b) in mine(baskets, 0.05, 0.8).items()}
    assert (("p:en",), "allow") in got and (("p:de",), "block") in got


def test_mined_verdicts(spark):
    urls = [f"http://a.example.{t}/{p}/{i}" for i in range(30) for t, p in [("net", "de"), ("net", "en"), ("com", "de"), ("org", "fr")]]
    got = judge_urls(pages(spark, urls + ["http://b.org/de/1", "http://c.gov/en/2", "http://d.gov/x"])).where("page_id >= 120")
    assert [r["verdict"] for r in got.orderBy("page_id").collect()] == ["block", "allow", "allow"]


def test_empty_table(spark):
    assert judge_urls(pages(spark, URLS).where("false")).count() == 0


def test_long_urls_that_recur(spark):
    """Twenty-five tokens in every URL: one class, a second's work, and the same verdicts as any of its tokens alone."""
    import time
    words = "/".join(f"w{chr(97 + i)}" for i in range(22))
    urls = [f"http://a.example.{t}/{p}/{words}/{i}" for i in range(40) for t, p in [("net", "de"), ("net", "en"), ("org", "fr")]]
    start = time.time()
    got = judge_urls(pages(spark, urls + ["http://b.gov/en/wa", "http://b.gov/de", "http://b.gov/wb/wc"])).where("page_id >= 120")
    assert [r["verdict"] for r in got.orderBy("page_id").collect()] == ["allow", "block", "allow"]
    assert time.time() - start < 60


def test_rules_of_tokens_that_go_together(spark):
    """Tokens of the same rows give the same rules as counting every token set."""
    r = random.Random(4)
    rows = []
    for i in range(300):
        t = [f"h:{c}" for c in "abc" if r.random() < 0.6] + (["p:x", "p:y"] if r.random() < 0.5 else []) + ["h:all", "q:all"]
        rows.append((sorted(t), "allow" if "p:x" in t and r.random() < 0.9 or r.random() < 0.2 else "block"))
    df = spark.createDataFrame(rows, "items array<string>, verdict string")
    got = {(tuple(x["tokens"]), x["verdict"]): (round(x["confidence"], 9), round(x["support"], 9)) for x in mined_rules(df, 0.03, 0.6).collect()}
    assert got == {k: (round(a, 9), round(b, 9)) for k, (a, b) in mine(rows, 0.03, 0.6).items()} and (("p:y",), "allow") in got


def test_too_many_independent_tokens(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "LONGEST", 3)
    rows = [(sorted({f"h:{c}" for c in "abcdef"} - {f"h:{'abcdef'[i % 7]}"} if i % 7 < 6 else {f"h:{c}" for c in "abcdef"}), "block") for i in range(70)]
    df = spark.createDataFrame(rows, "items array<string>, verdict string")
    with pytest.raises(ValueError, match="raise min_support"):
        mined_rules(df, 0.05, 0.6)
