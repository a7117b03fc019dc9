import random
import re

from tallymark.llm import urlfilter as u


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        m = re.match(r"([^/?#]*)(/[^?#]*)?", url.split("://", 1)[1], re.S)
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2] or ""
    fits = [(len(h + p), h + p, v) for v, h, p in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    glob = lambda g, s: re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g), s, re.S)
    return host, path, None, "block" if any(glob(h, host) and glob(p, path) for h, p in u.WILDCARDS) else "allow"


def test_matches_brute_force(spark):
    r = random.Random(8)
    fixed = [None, "", "example.org/es/", "://", "://x", "http://example.org", "http://EXAMPLE.org/es/1?x#y", "https://a.example.org/en/17", "http://org/", "http://.org/", "http://xorg/", "http://a.com#/fr/", "http://a.com/fr/?/de/", "http://a.com/de", "http://tracker1.net/x", "http://tracker12.net/x", "http://x.net/a.exe", "http://x.net/a.EXE", "x://y://z.com/de/", "http://spam.org/ok", "http://a.net/" + "q" * 100_000, "http://é.com/fr/ü", "http://a.net/.org/es/", "http://my-casino.net:80/"]
    bits = ["http://", "://", "example", ".org", ".com", "org", "com", "/", "/es/", "/en/1", "/fr/", "/de/", "spam", "adult", "casino", "/wp-login", ".exe", "tracker", "1.", "?", "#", "X", "é", "."]
    urls = fixed + ["".join(r.choices(bits, k=r.randint(1, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(i, x, "h", "z") for i, x in enumerate(urls)] + [(None, "http://a.org/", "h", "z")], "page_id long, url string, html string, host string")
    for row in u.judge(df).collect():
        url = "http://a.org/" if row.page_id is None else urls[row.page_id]
        assert tuple(row)[1:] == brute(url), url


def test_many_rules_span_words(spark):
    rules = [("block", f"h{k}.net", f"/p{k}/") for k in range(100)]
    df = spark.createDataFrame([(k, f"http://a.h{k}.net/p{k if k % 2 else k + 1}/x") for k in range(100)], "page_id long, url string")
    got = {r.page_id: r.rule for r in u.judge(df, rules, ()).collect()}
    assert got == {k: f"h{k}.net/p{k}/" if k % 2 else None for k in range(100)}


def test_empty(spark):
    assert u.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []
