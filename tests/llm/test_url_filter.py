import random
import re

from tidemark.llm.url_filter import PAGE_RULES, Automaton, UrlRule, filter_urls


def expected(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.action if best else "allow"


def test_urls(spark):
    rng = random.Random(1)
    hosts = ["example.org", "EXAMPLE.org", "a.example.org", "xexample.org", "org", "b.com", "com", "x.com:80", "u@b.com", "é.org", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?q=/es/", "/fr/#a", "/de/x", "?/de/", "#/es/", "/a/x.example.org/es/", "/x.com/de/", "/" + "long/" * 3000]
    urls = [f"{rng.choice(['http', 'https', ''])}://{h}{p}" for h in hosts for p in paths] + [None, "", "nothing", "a://b://c.org/", "mailto:a@b.org/"]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls * 2)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(df, PAGE_RULES).collect()}
    assert got == {i: expected(u, PAGE_RULES) for i, u in enumerate(urls * 2)}


def test_many_rules_and_empty(spark):
    rules = [UrlRule("block" if i % 2 else "allow", f"h{i}.net", f"/p{i % 7}") for i in range(150)]
    urls = [f"http://h{i}.net/p{i % 5}x" for i in range(150)]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(df, rules).collect()] == [expected(u, rules) for u in urls]
    assert filter_urls(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in filter_urls(df, [], default="block").collect()} == {"block"}


def test_very_long_urls():
    """Bytes are stepped only while a glob is open, with the same result."""
    import time

    automaton = Automaton([r.glob for r in PAGE_RULES] + ["**end"])
    texts = [(".a.example.org/es/" + "x" * 300 + "end").encode(), (".a.example.org/en/" + "y" * 400).encode(), b".b.net/" + b"z" * 200, b""]
    assert automaton.run(texts).tolist() == [[True, True, False, False, False, True], [True] + [False] * 5, [False] * 6, [False] * 6]
    automaton = Automaton([r.glob for r in PAGE_RULES])
    began = time.perf_counter()
    assert automaton.run([b".example.org/es/" + b"x" * 10_000_000, b".q.org/" + b"/" * 5_000_000]).tolist() == [[True, True, False, False, False], [True, False, False, False, False]]
    assert time.perf_counter() - began < 5


def test_globs():
    globs = ["a*c", "**x", "?b?", "é?", "*", "a**/b", ""]
    texts = ["ac", "abbc", "a/c", "x", "a/x", "abc", "ébc", "éü", "", "b", "a/b/b", "a//b", "ééé"]
    fits = Automaton(globs).run([t.encode() for t in texts])
    for g, row in zip(globs, fits.T):
        pattern = re.sub(r"\\\*\\\*|\\\*|\\\?", lambda m: {"\\*\\*": ".*", "\\*": "[^/]*", "\\?": "."}[m[0]], re.escape(g))
        assert [bool(re.fullmatch(pattern, t, re.S)) for t in texts] == row.tolist(), g
