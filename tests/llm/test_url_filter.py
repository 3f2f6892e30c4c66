import itertools
import math
import random

import pytest

from scholia.llm import shared, url_filter


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = path = ""
    k = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k]), rest[k:]
    path = rest[: next((k for k, c in enumerate(rest) if c in "?#"), len(rest))]
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    fit = [r for r in rules if f".{host}".endswith("." + r.split("/", 1)[0]) and path.startswith("/" + r.split("/", 1)[1])]
    rule = max(fit, key=len, default=None)
    return host, path, rule, rules.get(rule)


URLS = [
    None, "", "no scheme/en/", "http://", "HTTP://COM/en/x", "https://a.Example.COM/en/71?q#f", "http://example.com/en/6", "http://notexample.com/en/7", "x://net/de/8", "x://example.net/de/8",
    "x://q.example.net/de/81#top", "x://example.net?/de/8", "x://org#/es/", "x://my.org/es/", "x://org/ES/", "a://b://c.com/en/", "x://É.com/en/\nline", "x://com/en", "x:// com/en/ y", "//com/en/",
]


def test_hosts_paths_and_listed_rules(spark):
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate([*URLS, URLS[4]])] + [(None, URLS[5], "x")], "page_id long, url string, host string")
    for row in url_filter.judged(df).collect():
        url = URLS[5] if row.page_id is None else [*URLS, URLS[4]][row.page_id]
        host, path, rule, verdict = plain(url)
        assert (row.host, row.path, row.rule, row.verdict, row.mined_rule) == (host, path, rule, verdict or "allow", None), url
    assert url_filter.judged(df.limit(0), url_filter.mine(spark.createDataFrame(made(300), "url string, bad boolean"))).count() == 0


def made(n=900):
    rnd = random.Random(4)
    rows = []
    for k in range(n):
        host, section, tail = rnd.choice(["good", "spam", "mixed"]), rnd.choice(["shop", "news", "blog"]), rnd.choice(["?ref=a", "", "#top"])
        bad = host == "spam" and rnd.random() < 0.95 or host == "mixed" and section == "shop" or rnd.random() < 0.05
        rows.append((f"http://{host}.site.test/{section}/{k}.html{tail}", bool(bad)))
    return rows


def strong(rows, bags, most_length, confidence, lift, least_z, support=0.02):
    """All token combinations up to a length that pass, the shortest only, by plain counting."""
    n, bad = len(rows), sum(b for _, b in rows)
    every = sorted({t for bag, _ in bags for t in bag if sum(t in x for x, _ in bags) <= url_filter.MOST_SHARE * n})
    good = []
    for size in range(1, most_length + 1):
        for left in map(frozenset, itertools.combinations(every, size)):
            hits = [b for bag, b in bags if left <= bag]
            k, m, base = sum(hits), len(hits), bad / n
            if k >= max(20, support * n) and k >= confidence * m and k / m >= lift * base and k - m * base >= least_z * math.sqrt(m * base * (1 - base)):
                good.append(left)
    return sorted(sorted(x) for x in good if not any(y < x for y in good))


@pytest.mark.parametrize("broadcast", [0, 1 << 30])
def test_mined_rules(spark, monkeypatch, broadcast):
    monkeypatch.setattr(shared, "MOST_BROADCAST", broadcast)
    rows = made()
    df = spark.createDataFrame([*rows, ("http://x.test/", None)], "url string, bad boolean")
    mined = url_filter.mine(df, support=0.02, confidence=0.8)
    got = sorted(r.tokens for r in mined.collect())
    bags = [(frozenset(r[0]), b) for r, b in zip(df.where("bad is not null").select(url_filter.tokens(df["url"])).collect(), [b for _, b in rows])]
    assert got == strong(rows, bags, 3, 0.8, url_filter.LIFT, url_filter.LEAST_Z)
    assert ["host:spam"] in got and ["host:mixed", "path:shop"] in got
    for r in mined.collect():
        hits = [b for bag, b in bags if set(r.tokens) <= bag]
        assert (r.n, r.bad) == (len(hits), sum(hits)) and r.anchor in r.tokens
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows)] * 2, "page_id long, url string")
    judged = url_filter.judged(pages, mined).collect()
    assert len(judged) == 2 * len(rows)
    for r in judged:
        fits = sorted(" & ".join(x) for x in got if set(x) <= bags[r.page_id][0])
        assert (r.verdict, r.mined_rule) == (("block", fits[0]) if fits else ("allow", None))


def test_many_rules_and_long_ones(spark):
    """Hundreds of rules, and one of four tokens."""
    rows = [(f"http://h{k % 1200}.test/s{k % 1200}/{k}", k % 1200 < 300) for k in range(1200 * 25)]
    five = [(f"http://a.b/{x}?" + "&".join(sorted(set("pqrs") - ({y} if y else set()))) + ("" if y else f"&t={x}"), y is None) for x in range(40) for y in (None, "p", "q", "r", "s")]
    mined = url_filter.mine(spark.createDataFrame(rows + five, "url string, bad boolean"), support=0.0001, confidence=0.8)
    got = [set(r.tokens) for r in mined.collect()]
    assert sum(any(t.startswith("host:h") for t in x) for x in got) >= 300
    assert {"query:p", "query:q", "query:r", "query:s"} in got


def test_shuffled_labels_give_no_rule(spark):
    """What chance alone would find is kept out, at every base rate of bad urls."""
    for seed, share in ((1, 0.1), (2, 0.25), (3, 0.45)):
        rnd = random.Random(seed)
        rows = [(u, rnd.random() < share) for u, _ in made(1500)]
        assert url_filter.mine(spark.createDataFrame(rows, "url string, bad boolean")).count() == 0


@pytest.mark.parametrize("rows", [[], [("http://a.b/c", False)], [(None, True)] * 30, [("http://a.b/c", None)], [("http://a.b/c", True)] * 30])
def test_nothing_to_mine(spark, rows):
    assert url_filter.mine(spark.createDataFrame(rows, "url string, bad boolean")).count() == 0


def test_labels_reach_pages_by_the_paths_number(spark):
    pages = spark.createDataFrame([("http://x/en/5?p=1",), ("http://x/en/6.html",), ("http://x/en/",), (None,), ("http://x/99999999999999999999",), ("http://x/8/",)], "url string")
    labels = spark.createDataFrame([(5, 0, 0), (5, 1, 0), (6, 1, 1), (7, 1, 0), (8, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, url_filter.labelled_urls(pages, labels).collect())) == [("http://x/8/", False), ("http://x/en/5?p=1", True), ("http://x/en/6.html", True)]
