import random

import pytest

from lexhaven.llm import urls

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]


def split_by_rule(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [rest.index(c) for c in "/?#" if c in rest]
    at = min(ends, default=len(rest))
    host, tail = rest[:at], rest[at:]
    for mark in "?#":
        tail = tail.split(mark, 1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail


def by_hand(url, rules):
    host, path = split_by_rule(url)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules
            if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda f: f[:2], default=None)
    return (host, path, *(best[2:] if best else (None, "allow")))


def compare(spark, given, rules):
    df = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judged(df, table).collect()}
    assert got == {i: by_hand(u, rules) for i, u in enumerate(given)}


def test_edges(spark):
    compare(spark, [
        None, "", "no scheme", "http://", "http://example.com", "http://EXAMPLE.com/en/a?b#c", "x://www.example.com/en/", "http://a.www.example.com/en/x",
        "http://notexample.com/en/", "http://example.com.net/es/1", "http://ÀB.net/es/", "http://.com/", "http://com./", "http://a..com/", "http://u@com:80/x",
        "http://net?/es/", "http://a://net/es/", "http://net/es", "http://example.com/en/\nline", "http://x\ny.com/a\nb", "http://long.net/es/" + "z" * 50_000,
    ], RULES)


def test_random_rules_against_all_pairs(spark):
    rng = random.Random(5)
    host = lambda: ".".join(rng.choice(["a", "b", "ab", "com"]) for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 5)))
    rules = {(host(), rng.choice(["", path()])): rng.choice(["allow", "block"]) for _ in range(150)} | {("", "/bb"): "block"}
    given = [f"http://{host()}{path()}?q" for _ in range(1500)] + ["http://a.b/ab"] * 700
    compare(spark, given, [(h, p, v) for (h, p), v in rules.items()])


def test_rules_reach_all_ranges_of_their_intervals():
    cuts = sorted((k.encode(), p.encode(), s) for k in ("com/", "com/a/", "com/a/b/", "net/") for p in ("", "/a", "/b") for s in (-1, 1))
    for key in ("com/", "com/a/", "com/a/b/", "net/", ""):
        for path in ("", "/", "/a", "/b/c"):
            reached = urls.ranges_of(cuts, key, path)
            for k in ("com/", "com/a/", "com/a/b/", "com/b/", "net/", "net/x/"):
                for p in ("", "/a", "/a/x", "/b/c", "/c"):
                    for salt in (-2, 0, 2):
                        if k.startswith(key) and p.startswith(path):
                            assert urls.range_of(cuts, k, p, salt) in reached


def test_tables(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    df = spark.createDataFrame([("http://a.com/", 1, "h", "v", "k", 2), (None, 1, "h", "v", "k", 2)], "url string, page_id int, host string, verdict string, key string, range int")
    got = urls.judged(df, none, default="block").collect()
    assert sorted((r["host"], r["rule"], r["verdict"], r["key"], r["range"]) for r in got) == [("", None, "block", "k", 2), ("a.com", None, "block", "k", 2)]
    assert urls.judged(df.limit(0), none).count() == 0
    both = spark.createDataFrame([("A.com", None, "allow"), ("a.COM", "", "block"), (None, "/x", "allow")], none.schema)
    assert {r["verdict"] for r in urls.judged(df, both).collect() if r["host"]} == {"block"}
    with pytest.raises(ValueError):
        urls.judged(df.select("url", "page_id", "page_id"), none)
